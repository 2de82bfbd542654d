"""Every operator gives the same on a sparse tensor and on the same tensor with all cells written out."""

import duckdb
import pytest
from pyspark.sql import functions as F

from axisframe.functions.catalogue import BINARY, UNARY
from axisframe.operators import broadcast as B
from axisframe.operators import contract as C
from axisframe.operators import index as I
from axisframe.operators import losses as L
from axisframe.operators import reduce as R
from axisframe.operators import split as P
from axisframe.operators import window as W
from axisframe.plans import absent
from axisframe.plans.common import QUERIES, SQL
from axisframe.tensor import Tensor

from .test_queries import DATA, rows


def sparse(spark, cells, sizes, fill=0.0):
    names = ["i", "j", "k"][: len(sizes)]
    df = spark.createDataFrame([(*at, float(v)) for at, v in cells.items()], ", ".join([*(f"{n} long" for n in names), "value double"]))
    return Tensor(df, names, sizes, fill)


@pytest.fixture(scope="module")
def pair(spark):
    a = sparse(spark, {(0, 0): 1, (0, 1): 1, (1, 2): -2, (3, 3): 0.5, (2, 1): 3}, (4, 4))
    b = sparse(spark, {(0, 0): 1, (1, 2): 2, (1, 3): 4, (2, 1): 3}, (4, 4))
    return a, b


def cells(t):
    out = {}
    for r in t.dense().df.collect():
        v = float(r["value"]) if r["value"] is not None else None
        out[tuple(r[d] for d in sorted(t.dims))] = "nan" if v != v else v if v is None else round(v, 9) + 0.0
    return out


def same(f, *tensors):
    """f gives the same of sparse tensors, of dense ones, and of a sparse one with dense ones."""
    want = cells(f(*(t.dense() for t in tensors)))
    assert cells(f(*tensors)) == want
    if len(tensors) > 1:
        assert cells(f(tensors[0], *(t.dense() for t in tensors[1:]))) == want


def all_same(forms, *tensors):
    """As `same` for many forms at once: one job for the sparse ones and one for the dense ones."""
    def together(ts):
        out = None
        for i, f in enumerate(forms):
            t = f(*ts).dense()
            keys = F.concat_ws(",", F.lit(i), *sorted(t.dims)).alias("at")
            one = t.df.select(keys, F.round(F.col("value").cast("double"), 9).alias("value"))
            out = one if out is None else out.unionByName(one)
        return {r["at"]: "nan" if r["value"] is not None and r["value"] != r["value"] else r["value"] and r["value"] + 0.0 for r in out.collect()}

    assert together(tensors) == together([t.dense() for t in tensors])


@pytest.mark.parametrize("fill", [0.0, 0.25])
def test_unary(spark, fill):
    all_same([lambda t, n=n: B.elementwise(t, n) for n in sorted(UNARY)], sparse(spark, {(0,): 0.5, (2,): -0.75}, (4,), fill))


def test_binary(pair):
    names = sorted(BINARY)
    all_same([lambda x, y, n=n: B.binary(x, y, n) for n in names], *pair)
    all_same([lambda x, n=n: B.binary(x, 2, n) for n in names] + [lambda x, n=n: B.binary(2, x, n) for n in names], pair[0])


def test_figures(spark):
    a, b = sparse(spark, {(0,): 1, (1,): 1}, (3,)), sparse(spark, {(0,): 1}, (3,))
    total = lambda t: R.item(R.reduce(t, "sum"))
    assert total(B.binary(a, b, "equal")) == 2
    assert total(B.binary(a, 1, "add")) == 5
    assert total(B.clip(a, 0.5)) == 2.5
    assert total(B.elementwise(sparse(spark, {}, (3,)), "exp")) == 3
    assert R.item(L.loss("mse", a, b)) == pytest.approx(1 / 3)
    assert R.item(C.cosine_similarity(a, b)) == pytest.approx(0.5**0.5)
    assert R.item(L.loss("bce_with_logits", sparse(spark, {}, (2,)), sparse(spark, {}, (2,)))) == pytest.approx(0.6931471805599453)
    e1, e2 = sparse(spark, {(0,): 1}, (3,)), sparse(spark, {(1,): 1}, (3,))
    assert cells(C.cross(e1, e2)) == {(0,): 0, (1,): 0, (2,): 1}
    assert cells(B.glu(sparse(spark, {(0,): 2}, (2,)))) == {(0,): 1}
    assert len(cells(B.where(e1, e2, a))) == 3


def test_broadcast(spark, pair):
    a, b = pair
    v = sparse(spark, {(1,): 2, (3,): -1}, (4,)).rename(i="j")
    one = Tensor(v.df.select(F.lit(0).cast("long").alias("i"), "j", "value"), ("i", "j"), (1, 4), 0.0)
    for x in (v, one, v.rename(j="i")):
        names = ("add", "equal", "multiply", "maximum", "power")
        all_same([lambda p, q, n=n: B.binary(p, q, n) for n in names] + [lambda p, q, n=n: B.binary(q, p, n) for n in names], a, x)
    same(lambda p, q: B.binary(p, q.rename(j="m"), "subtract"), a, v)
    same(B.where, a, b, v)
    same(lambda c, x: B.where(c, x, 3.0), a, v)
    same(lambda c, x, y: B.select([B.binary(c, 0, "greater"), y], [x, 5.0], -1.0), a, b, v)
    same(lambda t, lo, hi: B.clip(t, lo, hi), a, v, b)
    same(lambda t, m: B.masked_fill(t, m, 9.0), a, b)
    same(lambda t, m: B.masked_fill(t, B.binary(m, 0, "equal"), 9.0), a, v)
    same(lambda t, m: B.masked_select(t, B.binary(m, 0, "equal")), a, b)
    same(lambda t: B.dropout(B.binary(t, 1, "add"), 0.4, 3), a)
    same(lambda t: B.alpha_dropout(t, 0.4, 3), a)
    empty = sparse(spark, {}, (1,))
    same(lambda t, x: B.binary(t, x, "add"), v.rename(j="i"), empty)


def test_contractions_and_losses(spark, pair):
    a, b = pair
    v = sparse(spark, {(1,): 2}, (4,))
    same(lambda x, y: C.matmul(B.binary(x, 1, "add"), y), a, b)
    same(lambda x, y: C.einsum("ij,kj->ik", B.elementwise(x, "exp"), y), a, b)
    same(lambda x, w, c: C.linear(x, w, c), a, b.rename(i="o", j="j"), v)
    same(lambda x, y: C.cosine_similarity(x, y), a, b)
    same(lambda x, y: C.cosine_similarity(x, y, "j"), a, v.rename(i="j"))
    same(lambda x, y: C.addmm(x, x, y, 2, 3), a, b)
    same(C.attention, a, b, b)
    three = lambda t: t.with_df(t.df.filter("j < 3"), sizes=(4, 3))
    same(lambda x, y: C.cross(three(x), three(y)), a, b)
    same(lambda x, y: C.cross(B.binary(three(x), 1, "add"), three(y)), a, b)
    same(lambda x: B.glu(x), a)
    for name in L.POINTWISE:
        x = a if not name.startswith("bce") or name == "bce_with_logits" else B.elementwise(a, "sigmoid")
        all_same([lambda p, q, n=name, h=h: L.loss(n, p, q, h) for h in ("none", "mean", "sum")], x, b)
    same(lambda x, y: L.cross_entropy(x, y, "none"), a, b)
    same(lambda x, y: L.cross_entropy(x, y, "none"), a, v)
    same(lambda x, y: L.nll_loss(x, y), a, v)
    kernel = sparse(spark, {(0, 0, 0): 1, (1, 0, 2): 2}, (2, 1, 3)).rename(i="o", j="c", k="w")
    image = Tensor(a.df.select("i", F.lit(0).cast("long").alias("c"), "j", "value"), ("i", "c", "j"), (4, 1, 4), 0.0)
    same(lambda x, k, c: W.convolve(x, k, padding=1, bias=c), image, kernel, sparse(spark, {(1,): 3}, (2,)))


def test_reductions(spark, pair):
    a, b = pair
    hows = [h for h in R.aggregates() if h not in ("std1", "var1", "approx_distinct")]
    for axis in (None, "i", "j"):
        all_same([lambda t, h=h, x=axis: R.reduce(t, h, x) for h in hows], a)
        all_same([lambda t, h=h, x=axis: R.reduce(B.binary(t, 1, "add"), h, x, keepdims=True) for h in hows], a)
    same(lambda t: R.norm(t, 3, "j"), a)
    same(lambda x, y: R.reduce(B.binary(x, y, "equal"), "mean", "j"), a, b)
    assert R.item(R.reduce(sparse(spark, {}, (3,)), "sum")) == 0


def test_indices(spark, pair):
    a, _ = pair
    at = sparse(spark, {(1,): 2}, (3,)).rename(i="n")
    same(lambda t, p: I.take(t, p, "j"), a, at)
    same(lambda t, p: I.take_along(t, p, "j"), a, sparse(spark, {(0, 0): 1, (2, 0): 3}, (4, 1)))
    same(lambda t, u: I.dynamic_update_slice(t, u, {"i": 1, "j": 1}), a, sparse(spark, {(0, 0): 8}, (2, 2)))
    same(lambda x, y: P.concatenate([x, B.binary(y, 1, "add")], 0), a, a)


@pytest.mark.parametrize("name", [n for n in QUERIES if QUERIES[n].__module__ == absent.__name__])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    near = lambda t: [tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in rows(t)]
    assert near(QUERIES[name](spark, DATA).toArrow()) == near(con.execute(SQL[name]).to_arrow_table())
