"""Running totals, places, scans and windows against numpy; a group with most of the rows is spread over the ranges."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from axisframe.operators import hof, lookup, segments
from axisframe.operators import reduce as R
from axisframe.operators import window as W
from axisframe.tensor import Tensor


def tensor(spark, x, dims="ijk"):
    at = np.nonzero(np.ones(x.shape))
    return Tensor(spark.createDataFrame(pd.DataFrame({**{d: a.astype("int64") for d, a in zip(dims, at, strict=False)}, "value": x[at].astype(float)})), dims[: x.ndim], x.shape, None)


def array(t):
    out, rows = np.full(t.sizes, np.nan), t.df.toPandas()
    out[tuple(rows[d].to_numpy() for d in t.dims)] = rows["value"]
    assert len(rows) == out.size
    return out


@pytest.fixture(params=[True, False], ids=["windows", "ranges"])
def way(request, monkeypatch):
    if not request.param:
        monkeypatch.setattr(segments, "ONE_TASK", 3)


def test_running_sort_and_ranks(spark, way, many_parts):
    rng = np.random.default_rng(1)
    x = rng.integers(1, 6, (3, 40)).astype(float)
    t = tensor(spark, x)
    assert array(W.cumsum(t, "j")) == pytest.approx(np.cumsum(x, 1))
    assert array(W.cumprod(tensor(spark, 1 + x / 100), "i")) == pytest.approx(np.cumprod(1 + x / 100, 0))
    assert array(W.running(t, "j", "max")) == pytest.approx(np.maximum.accumulate(x, 1))
    assert array(W.running(t, None, "sum")) == pytest.approx(np.cumsum(x))
    for descending in (False, True):
        values, at = W.sort_with_positions(t, "j", descending)
        order = np.argsort(-x if descending else x, axis=1, kind="stable")
        assert (array(at) == order).all() and (array(values) == np.take_along_axis(x, order, 1)).all()
        s = pd.DataFrame(x.T)
        for kind, method in (("rank", "min"), ("dense_rank", "dense"), ("row_number", "first")):
            assert (array(W.ranks(t, "j", kind, descending)) == s.rank(method=method, ascending=not descending).to_numpy().T).all(), kind
    lag = W.ranks(t, "j", "lag", step=2).df.filter("value IS NOT NULL").toPandas()
    assert len(lag) == 3 * 38 and lag["value"].sum() == pytest.approx((x[:, 2:] - x[:, :-2]).sum())
    assert array(R.quantile(t, 0.3, "j")) == pytest.approx(np.quantile(x, 0.3, axis=1))


def test_user_scans(spark, many_parts):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 3, (4, 50))
    got = W.associative_scan(tensor(spark, x), "j", lambda a, b: np.hypot(a, b))
    assert array(got) == pytest.approx(np.sqrt(np.cumsum(x * x, axis=1)))
    a, b = rng.uniform(0.5, 1.1, 300), rng.normal(size=300)  # y[t] = a[t] y[t - 1] + b[t]
    key = np.r_[np.zeros(280), np.ones(20)]
    df = spark.createDataFrame(pd.DataFrame({"k": key, "t": np.arange(300), "a": a, "b": b})).repartition(3)
    found = segments.associative_scan(df, ["k"], ["t"], ["a", "b"], lambda p, q: [p[0] * q[0], p[1] * q[0] + q[1]])
    y, want = 0.0, []
    for i in range(300):
        y = a[i] * (0 if i in (0, 280) else y) + b[i]
        want.append(y)
    assert [r["b"] for r in found.sort("t").collect()] == pytest.approx(want)


@pytest.fixture
def many_parts(spark):
    """Ranges as on large data, where no small ones are put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_hot_group_lies_in_all_ranges(spark, many_parts):
    df = spark.range(4000).select(F.when(F.col("id") % 10 < 9, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("t"), F.lit(1.0).alias("v"))
    by = segments.Sorted(df, "k", "t")
    parts = by.rows.filter("k = 7").groupBy("part_").count().collect()
    assert len(parts) >= 3 and max(r["count"] for r in parts) < 2000
    out = by.running(by.rows, ["k"], "sum", F.col("v"), "s")
    assert "part_" in str(out._jdf.queryExecution().optimizedPlan())
    assert out.filter("k = 7").agg(F.max("s")).first()[0] == 3600
    assert by.carried(by.rows, ["k"], {"n": ("sum", F.lit(1))}).count() <= by.rows.select("part_").distinct().count() * 2


def test_lookups_and_averages_take_both_ways(spark, monkeypatch):
    rng = np.random.default_rng(3)
    bound = spark.createDataFrame(pd.DataFrame({"k": rng.integers(0, 3, 60), "t": rng.integers(0, 99, 60), "v": rng.normal(size=60)}))
    asked = spark.createDataFrame(pd.DataFrame({"k": rng.integers(0, 4, 80), "t": rng.integers(0, 99, 80), "n": np.arange(80)}))
    rows = lambda: sorted(map(str, lookup.asof_lookup(asked, bound, ["k"], "t", "v").collect()))
    means = lambda: {r["k"]: round(r["ema"], 12) for r in hof.ema(bound, ["k"], ["t", "v"], "v", 0.3).collect()}
    one, first = rows(), means()
    monkeypatch.setattr(segments, "ONE_TASK", 3)
    assert rows() == one and means() == first


def slow(x, window, stride, lo, hi, f, ceil=False):
    n = len(x)
    return [f(x[max(0, s) : max(0, min(n, s + window))]) for s in range(-lo, n + hi - window + 1, stride)]


@pytest.mark.parametrize("how", ["max", "sum", "mean", "min"])
def test_wide_windows(spark, monkeypatch, how):
    monkeypatch.setattr(W, "WIDE", 1)
    rng = np.random.default_rng(4)
    f = {"max": np.max, "sum": np.sum, "mean": np.mean, "min": np.min}[how]
    for n, window, stride, lo, hi in [(50, 7, 1, 0, 0), (50, 7, 3, 3, 3), (23, 5, 5, 2, 2), (23, 23, 1, 0, 0), (23, 20, 2, 10, 10), (9, 4, 1, 0, 3), (12, 3, 7, 1, 0)]:
        x = rng.normal(size=n)
        got = W.reduce_window(tensor(spark, x), {"i": window}, {"i": stride}, {"i": (lo, hi)}, how)
        assert array(got) == pytest.approx(slow(x, window, stride, lo, hi, f)), (n, window, stride, lo, hi)
    image = rng.normal(size=(3, 12, 11))
    got = array(W.reduce_window(tensor(spark, image), {"j": 4, "k": 3}, {"j": 2, "k": 1}, "SAME", how))
    monkeypatch.setattr(W, "WIDE", 10**9)
    assert got == pytest.approx(array(W.reduce_window(tensor(spark, image), {"j": 4, "k": 3}, {"j": 2, "k": 1}, "SAME", how)))


def test_the_cost_of_a_window_does_not_grow_with_it(spark):
    """Two rows a cell, whatever the window."""
    t = Tensor(spark.range(30_000).selectExpr("id AS i", "CAST(id % 97 AS DOUBLE) AS value"), ("i",), (30_000,), None)
    for window in (20, 10_000):
        along = W.Along(30_000, window, 1, 0, 1, 30_000 - window + 1)
        out = W.by_blocks(t.df, ["i"], "i", along, "max")
        assert "sequence(0, " not in out._jdf.queryExecution().optimizedPlan().toString()
        assert out.count() == 30_000 - window + 1
    assert array(W.reduce_window(t, {"i": 10_000}, {"i": 1}, "VALID", "max")).min() == 96
