"""Draws and sketches: exact totals, errors within what is stated, and no row for each draw."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from axisframe.operators import sketches as K
from axisframe.sources import build
from axisframe.tensor import Tensor


def weights(spark, p):
    rows, columns = np.nonzero(p)
    return Tensor(spark.createDataFrame(pd.DataFrame({"s": rows, "c": columns, "value": p[rows, columns]})), ("s", "c"), p.shape, 0.0)


@pytest.mark.parametrize("n", [0, 1, 7, 1000, 10**12])
def test_draws(spark, monkeypatch, n):
    monkeypatch.setattr(build, "BLOCK", 5)
    rng = np.random.default_rng(1)
    p = rng.random((6, 23)) * (rng.random((6, 23)) < 0.6)
    p[4] = 0
    p[3] = 0
    p[3, 9] = 2.0
    out = build.sample_multinomial(weights(spark, p), n, seed=4)
    got = np.zeros(p.shape)
    rows = out.df.toPandas()
    got[rows["s"], rows["c"]] = rows["value"]
    assert got.sum(axis=1).tolist() == [n, n, n, n, 0, n] and got[3, 9] == n
    share = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-9)
    assert (abs(got - n * share) <= 6 * np.sqrt(n * share * (1 - share)) + 5).all()
    again = build.sample_multinomial(weights(spark, p), n, seed=4).df.toPandas()
    assert sorted(map(tuple, again.to_numpy())) == sorted(map(tuple, rows.to_numpy()))
    plan = out.df._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan


def test_draws_have_the_variance_of_a_multinomial(spark):
    p = np.tile([0.5, 0.3, 0.2], (2000, 1))
    got = np.zeros(p.shape)
    rows = build.sample_multinomial(weights(spark, p), 40, seed=1).df.toPandas()
    got[rows["s"], rows["c"]] = rows["value"]
    assert got.mean(axis=0) == pytest.approx(40 * p[0], abs=0.4)
    want = 40 * (np.diag(p[0]) - np.outer(p[0], p[0]))
    assert np.cov(got.T) == pytest.approx(want, abs=1.0)


def sketch_rows(spark):
    rng = np.random.default_rng(2)
    data = pd.DataFrame({"a": rng.integers(0, 3, 30_000), "b": rng.integers(0, 20, 30_000), "v": rng.lognormal(size=30_000), "who": rng.integers(0, 5000, 30_000)})
    return data, spark.createDataFrame(data).repartition(4)


def test_rolled_up_sketches_keep_their_error(spark):
    data, df = sketch_rows(spark)
    halves = [K.sketched(df.filter(F.col("who") % 2 == h), ["a", "b"], "v", "who") for h in (0, 1)]
    one, two = K.added(halves[0], halves[1], ["a", "b"]), K.added(halves[1], halves[0], ["a", "b"])
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    for whole in (one, two):
        for kept in (["a"], ["b"], []):
            for r in K.distinct_items(K.quantiles(K.rolled_up(whole, kept), shares)).collect():
                own = data[np.logical_and.reduce([data[k] == r[k] for k in kept])] if kept else data
                v = np.sort(own["v"].to_numpy())
                assert r["n"] == len(v) and r["q"][0] == v[0] and r["q"][-1] == v[-1]
                places = np.searchsorted(v, r["q"]) / len(v)
                assert abs(places - shares).max() <= 3 * K.rank_error() + 1 / len(v)
                assert r["distinct_items"] == pytest.approx(own["who"].nunique(), rel=0.08)
    counts = lambda t: sorted((r["a"], r["n"], r["distinct_items"]) for r in K.distinct_items(K.rolled_up(t, ["a"])).select("a", "n", "distinct_items").collect())
    assert counts(one) == counts(two)


def test_sketches_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (2, None)], "a long, v double")
    got = {r["a"]: (r["n"], r["q"]) for r in K.quantiles(K.sketched(df, ["a"], "v"), [0.0, 0.5, 1.0]).collect()}
    assert got == {1: (0, [None] * 3), 2: (1, [5.0] * 3)}
    assert K.rolled_up(K.sketched(df.limit(0), ["a"], "v"), ["a"]).count() == 0
