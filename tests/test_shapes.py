"""Refused inputs raise before any job."""

import numpy as np
import pytest

from axisframe.operators import broadcast as B
from axisframe.operators import contract as C
from axisframe.operators import index as I
from axisframe.operators import losses as L
from axisframe.operators import reduce as R
from axisframe.operators import reshape as S
from axisframe.operators import split as P
from axisframe.operators import window as W
from axisframe.sources import build
from axisframe.tensor import ShapeError

REFUSED = {
    "matmul inner sizes": lambda a, v: C.matmul(a, a),
    "matmul of a scalar": lambda a, v: C.matmul(R.reduce(a, "sum"), v),
    "mm rank": lambda a, v: C.mm(a, v),
    "einsum rank": lambda a, v: C.einsum("ijk,k->ij", a, v),
    "broadcast sizes": lambda a, v: B.binary(a, v, "add", positional=True),
    "broadcast_to target": lambda a, v: B.broadcast_to(v, {"i": 5}),
    "reshape count": lambda a, v: S.reshape(a, {"p": 5, "q": 2}),
    "reshape division": lambda a, v: S.reshape(a, {"p": 5, "q": -1}),
    "transpose twice": lambda a, v: S.transpose(a, ["i", "i"]),
    "squeeze size": lambda a, v: S.squeeze(a, "i"),
    "axis range": lambda a, v: R.reduce(a, "sum", 5),
    "axis twice": lambda a, v: R.reduce(a, "sum", ["i", 0]),
    "odd glu": lambda a, v: B.glu(a, "i"),
    "top k over size": lambda a, v: W.top_k(a, 9),
    "pool window": lambda a, v: W.pool(v, 9, spatial=1),
    "split division": lambda a, v: P.split(v, 4),
    "concat sizes": lambda a, v: P.concatenate([a, S.transpose(a)], 0),
    "stack shapes": lambda a, v: P.stack([a, S.transpose(a)]),
    "index range": lambda a, v: I.getitem(a, 7),
    "too many indices": lambda a, v: I.getitem(v, 0, 0),
    "reduction word": lambda a, v: L.loss("mse", a, a, "average"),
    "bce sizes": lambda a, v: L.loss("bce", a, v),
    "rearrange names": lambda a, v: S.rearrange(a, "i j -> i k"),
    "rearrange division": lambda a, v: S.rearrange(a, "(p q) j -> p q j", p=2),
    "ragged literal": lambda a, v: build.array_literal(a.spark, [[1, 2], [3]]),
    "reflect too far": lambda a, v: S.pad(v, {"i": (9, 0)}, "reflect"),
    "quantile share": lambda a, v: R.quantile(a, 1.5, "i"),
}


@pytest.mark.parametrize("name", REFUSED)
def test_refused(spark, name):
    a = build.array_literal(spark, np.arange(12).reshape(3, 4).tolist(), ["i", "j"])
    v = build.array_literal(spark, list(range(6)), ["i"])
    with pytest.raises(ShapeError):
        REFUSED[name](a, v)


def test_empty_results_keep_their_schema(spark):
    v = build.array_literal(spark, [3, 1, 2], ["i"])
    assert build.arange(spark, 5, 1).df.count() == 0
    assert I.slice_dim(v, "i", 2, 1).sizes == (0,)
    assert W.top_k(v, 0)[0].df.count() == 0


def test_absent_cells_count(spark):
    t = build.Tensor(spark.createDataFrame([(0, 0, -2.0), (1, 1, 5.0)], "i long, j long, value double"), ("i", "j"), (2, 3), 0.0)
    rows = {r["i"]: r["value"] for r in R.reduce(t, "max", "j").df.collect()}
    assert rows == {0: 0.0, 1: 5.0}
    assert {r["i"]: r["value"] for r in R.reduce(t, "mean", "j").df.collect()} == {0: -2 / 3, 1: 5 / 3}
