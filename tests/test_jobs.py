"""Lookups, change processing, sources and streams on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisframe.operators import audit as Q
from axisframe.operators import change as D
from axisframe.operators import hof as H
from axisframe.operators import linalg as A
from axisframe.operators import lookup as K
from axisframe.operators import reduce, window
from axisframe.sources import build
from axisframe.streaming import streams as T
from axisframe.tensor import ShapeError


def test_incremental_equals_fresh(spark):
    compute = lambda df: df.groupBy("k").agg(F.sum("v").alias("s"))
    rng = np.random.default_rng(4)
    old = spark.createDataFrame([(int(k), int(v)) for k, v in rng.integers(0, 30, (90, 2))], "k int, v int")
    for share in (3, 25):
        new = old.withColumn("v", F.when(F.col("k") < share, F.col("v") + 1).otherwise(F.col("v"))).filter("k <> 7")
        got = D.incremental_refresh(old, new, compute(old), ["k"], compute)
        assert D.verify_incremental(got, compute(new)).count() == 0


def test_change_log_stops_at_a_gap(spark):
    log = spark.createDataFrame(
        [("a", 1, "full", "x"), ("a", 2, "edit", "y"), ("b", 1, "full", "p"), ("b", 3, "edit", "q"), ("c", 1, "edit", "z"), ("d", 1, "full", "m"), ("d", 3, "edit", "n"), ("d", 4, "full", "o")],
        "key string, version long, kind string, payload string",
    )
    got = {r["key"]: (r["version"], r["text"], r["in_sync"]) for r in D.apply_change_log(log, ["key"]).collect()}
    assert got["a"] == (2, "xy", True)
    assert got["b"] == (1, "p", False)
    assert got["c"][1:] == (None, False)
    assert got["d"] == (4, "o", True)


def test_asof_without_bindings_is_null(spark):
    probes = spark.createDataFrame([(1, 5, "p"), (1, None, "q"), (2, 1, "r")], "k int, t int, name string")
    bound = spark.createDataFrame([(1, 3, 10), (1, 5, 20), (1, 9, 30)], "k int, t int, v int")
    got = {r["name"]: r["v"] for r in K.asof_lookup(probes, bound, ["k"], "t", "v").collect()}
    assert got == {"p": 20, "q": None, "r": None}


def test_long_chain_is_one_group(spark):
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["group"] for r in K.connected_groups(edges).collect()} == {0}


def test_contract_forms(spark):
    df = spark.createDataFrame([(1, [[1, 2], [3, 4]]), (2, [[1], [2]]), (3, [[1, 2, 3], [1, 2, 3]])], "k int, x array<array<int>>")
    assert {r["row_key"] for r in Q.check_contract(df, "k", "x", "batch 2").collect()} == {"2", "3"}
    assert {r["row_key"] for r in Q.check_contract(df, "k", "x", "_ #2").collect()} == {"3"}
    assert {r["row_key"] for r in Q.check_contract(df, "k", "x", "... n=2").collect()} == {"2", "3"}


def test_tall_matrices(spark):
    x = np.random.default_rng(1).normal(size=(40, 3))
    df = spark.createDataFrame([(i, r.tolist(), float(r @ [1, -2, 3])) for i, r in enumerate(x)], "i int, x array<double>, y double")
    assert np.allclose(A.gram(df, "x"), x.T @ x)
    assert np.allclose(A.svd(df, "x")[1], np.linalg.svd(x)[1])
    assert np.allclose(A.lstsq(df, "x", "y"), [1, -2, 3])
    q, r = A.qr(df, "x")
    assert np.allclose(np.array([v["q"] for v in q.orderBy("i").collect()]) @ r, x)


def test_scan_corpus_and_diagnostics(spark, tmp_path):
    (tmp_path / "src/build").mkdir(parents=True)
    (tmp_path / "src/a.py").write_text("one\ntwo")
    (tmp_path / "src/build/b.py").write_text("no")
    (tmp_path / "src/c.txt").write_text("no")
    assert [r["text"] for r in build.scan_corpus(spark, str(tmp_path), "*.py").collect()] == ["one\ntwo"]
    found = spark.createDataFrame([("s", "1", "r", "mismatch", "m", 0)], ", ".join(f"{c} string" for c in Q.FINDING[:-1]) + ", axis int")
    build.write_diagnostics(found, str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    assert build.diagnostic_lines(found).first()["line"] == "s:1: error: m"


def test_change_log_stream(spark, tmp_path):
    rows = [("a", 1, "full", "x"), ("a", 2, "edit", "y"), ("b", 1, "full", "p"), ("b", 3, "edit", "q")]
    spark.createDataFrame(rows, "key string, version long, kind string, payload string").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = T.apply_change_log(T.read_events(spark, str(tmp_path / "in")), "key")
    T.run_once(T.upserts(out, str(tmp_path / "out"), ["key"], "version", str(tmp_path / "check")), spark)
    got = {r["key"]: (r["version"], r["text"], r["in_sync"]) for r in T.current(spark, str(tmp_path / "out"), ["key"], "version").collect()}
    assert got == {"a": (2, "xy", True), "b": (1, "p", False)}


@pytest.mark.parametrize("n", [1, 2, 5])
def test_samples_have_their_shape(spark, n):
    assert build.sample(spark, {"i": n, "j": 3}, "gumbel", seed=n).df.count() == 3 * n


def test_nulls_in_content_and_keys_are_changes(spark):
    schema = "k int, a int, b int"
    old = spark.createDataFrame([(1, None, 5), (2, 1, 1), (None, 1, 1), (4, 2, None)], schema)
    new = spark.createDataFrame([(1, 5, None), (2, 1, 1), (None, 2, 1), (4, 2, None)], schema)
    assert sorted((r["k"] for r in D.dirty_keys(old, new, ["k"]).collect()), key=repr) == [1, None]
    nested = [spark.createDataFrame([(1, v)], "k int, a array<int>") for v in ([None, 5], [5, None])]
    assert D.dirty_keys(*nested, ["k"]).count() == 1
    compute = lambda df: df.groupBy("k").agg(F.max("a").alias("a"))
    for above in (0.6, 0.1):
        got = D.incremental_refresh(old, new, compute(old), ["k"], compute, full_above=above)
        assert D.verify_incremental(got, compute(new)).isEmpty()
    assert D.dirty_keys(old, old.select("k", "a", "b"), ["k"]).isEmpty()


def contract(spark, values, spec, kind="array<array<int>>"):
    df = spark.createDataFrame(list(enumerate(values)), f"k int, x {kind}")
    return sorted((int(r["row_key"]), r["axis"]) for r in Q.check_contract(df, "k", "x", spec).collect())


def test_contracts_bind_names_within_a_row(spark):
    two, three, wide = [[1, 2], [3, 4]], [[1, 2, 3]] * 3, [[1, 2, 3]] * 2
    assert contract(spark, [two, three, wide], "n n") == [(2, 1)]
    assert contract(spark, [two, three, wide], "n n+1") == [(0, 1), (1, 1)]
    assert contract(spark, [two, wide, [[1, 2, 3]]], "#n n") == [(1, 0)]
    assert contract(spark, [two, wide], "*b 2") == contract(spark, [two, wide], "... 2") == contract(spark, [two, wide], "#*b _ 2") == [(1, -1)]
    assert contract(spark, [two], "n") == contract(spark, [two], "a b c") == contract(spark, [two], "*b 1 1 1") == [(0, None)]
    assert contract(spark, [two, None], "n m") == []
    for bad in ("... *b", "n n.x"):
        with pytest.raises(ShapeError):
            contract(spark, [two], bad)


def test_contracts_bind_names_across_columns(spark):
    rows = [(0, [[1, 2]], [[[1], [2]]]), (1, [[1, 2]], [[[1, 1], [2, 2]]]), (2, [[1]] * 3, [[[1]]])]
    df = spark.createDataFrame(rows, "k int, x array<array<int>>, y array<array<array<int>>>")
    got = lambda x, y: sorted((int(r["row_key"]), r["source"]) for r in Q.check_contracts(df, "k", {"x": x, "y": y}).collect())
    assert got("a n", "a n _") == [(2, "y")]
    assert got("*b", "*b m") == [(2, "y")]
    assert got("#*b", "#*b m") == []
    assert got("n m", "n m n") == [(1, "y"), (2, "y"), (2, "y")]


def test_resolution_climbs_any_chain_and_ends_in_cycles(spark):
    parents = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (103, 101), (103, 7)], "node int, parent int")
    values = spark.createDataFrame([(0, "root"), (30, "b"), (30, "a")], "node int, value string")
    got = {r["node"]: (r["value"], r["depth"]) for r in K.method_resolution(parents, values).collect()}
    assert got == {k: ("root", k) for k in range(30)} | {k: ("a", k - 30) for k in range(30, 41)} | {103: ("root", 8)}
    assert K.method_resolution(parents, values.limit(0)).count() == 0


def test_loops_raise_where_their_bound_is_reached(spark):
    state = spark.createDataFrame([(0,)], "n int")
    more = lambda df: df.select((F.col("n") + 1).alias("n"))
    assert H.while_loop(state, more, lambda _, after: after.first()["n"] < 3).first()["n"] == 3
    with pytest.raises(RuntimeError):
        H.while_loop(state, more, lambda _, after: True, most=2)


def test_scan_corpus_skips_folders_below_its_root_only(spark, tmp_path):
    root = tmp_path / "build" / "a corpus"
    for name in ("a.py", "src/b.py", "build/c.py", ".venv/d.py", "x/site-packages/e.py", "src/notes.txt", "builder/f.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    assert sorted(r["text"] for r in build.scan_corpus(spark, str(root), "*.py").collect()) == ["a.py", "builder/f.py", "src/b.py"]
    assert [r["text"] for r in build.scan_corpus(spark, f"file://{root}/src", "*.py").collect()] == ["src/b.py"]


@pytest.mark.parametrize("width", [1, 0.5, 7])
def test_innermost_interval_equals_brute_force(spark, width):
    rng = random.Random(4)
    for step in (1, 0.25):
        spans = [(i, rng.randint(0, 2), a := rng.randint(-400, 900) * step, a + rng.choice([0, 1, 2, 3, 16, 64, 65, 200, 700]) * step) for i in range(160)]
        points = [(i, rng.randint(0, 2), rng.randint(-420, 1500) * step) for i in range(150)] + [(900, None, 3.0), (901, 1, None)]
        s = spark.createDataFrame([(i, k, float(a), float(b)) for i, k, a, b in spans], "scope_id int, k int, start double, end double")
        p = spark.createDataFrame([(i, k, None if x is None else float(x)) for i, k, x in points], "id int, k int, x double")
        got = {r["id"]: r["scope_id"] for r in K.innermost_interval(p, s, ["k"], "x", ["id"], width).collect()}
        assert got == {i: min(((b - a, -a, j) for j, key, a, b in spans if x is not None and key == k and a <= x < b), default=(0, 0, None))[2] for i, k, x in points}
    assert K.innermost_interval(p, s.limit(0), ["k"], "x", ["id"]).filter("scope_id IS NOT NULL").isEmpty()


def test_order_statistics_of_whole_vectors_and_groups(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 40, (3, 57)).astype(float)
    grid = build.array_literal(spark, x.tolist(), ["part", "at"])
    vector = build.array_literal(spark, x[0].tolist(), ["at"])
    value = lambda t: {tuple(r[d] for d in t.dims): r["value"] for r in t.df.collect()}
    assert value(reduce.quantile(vector, 0.3)) == {(): pytest.approx(np.quantile(x[0], 0.3))}
    assert value(reduce.quantile(grid, [0.0, 0.77, 1.0], "at")) == {(q, p): pytest.approx(np.quantile(x[p], s)) for q, s in enumerate((0.0, 0.77, 1.0)) for p in range(3)}
    assert value(reduce.reduce(grid, "median", keepdims=True)) == {(0, 0): np.median(x)}
    assert value(reduce.kth_value(vector, 5, "at")[0]) == {(): np.sort(x[0])[4]}
    assert value(reduce.kth_value(grid, 5, "at")[1]) == {(p,): np.argsort(x[p], kind="stable")[4] for p in range(3)}
    assert value(reduce.lower_median(vector, "at")[0]) == {(): np.sort(x[0])[28]}
    got = value(window.softmax(vector))
    want = np.exp(x[0] - x[0].max())
    assert all(abs(got[(i,)] - v) < 1e-12 for i, v in enumerate(want / want.sum()))
    assert "SinglePartition" not in window.softmax(vector).df.filter("value > 0")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    normal = value(window.normalise(grid, None, 0.0))
    assert all(abs(normal[(p, i)] - (x[p, i] - x.mean()) / x.std()) < 1e-9 for p in range(3) for i in range(57))


def test_asof_carries_a_key_over_many_ranges(spark):
    rng = random.Random(8)
    bindings = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(0, 4000, 40)]), rng.randint(0, 9)) for _ in range(60)]
    probes = [(i, rng.choice([1, 1, 1, 1, 2, 3, None]), rng.choice([None, *range(4100)])) for i in range(3000)]
    b, p = spark.createDataFrame(bindings, "k int, t int, v int"), spark.createDataFrame(probes, "id int, k int, t int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = {r["id"]: r["v"] for r in K.asof_lookup(p, b, ["k"], "t", "v").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: max(((bt, v) for bk, bt, v in bindings if None not in (k, t, bt) and bk == k and bt <= t), default=(0, None))[1] for i, k, t in probes}


def test_averages_pass_over_nulls_and_start_at_resets(spark):
    rows = [("a", 1, 4.0, False), ("a", 2, None, False), ("a", 3, 8.0, None), ("b", 1, 1.0, False), ("b", 2, 5.0, True), ("b", 3, 3.0, False), ("b", 4, 7.0, False), ("c", 1, 9.0, True), ("d", 1, None, False), (None, 1, 2.0, False)]
    df = spark.createDataFrame(rows, "k string, t int, v double, r boolean")
    got = {r["k"]: r["average"] for r in D.ewma_cost(df, ["k"], ["t"], "v", "r").collect()}
    assert got == {"a": 6.0, "b": 5.0, "c": None, "d": None, None: 2.0}
    assert {r["k"]: r["ema"] for r in H.ema(df, ["k"], ["t"], "v", 0.25).collect()} == {"a": 5.0, "b": 3.4375, "c": 9.0, "d": None, None: 2.0}


def test_averages_over_many_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 1, 2]), t, rng.random(), rng.random() < 0.002) for t in range(4000)]
    df = spark.createDataFrame(rows, "k int, t int, v double, r boolean").repartition(16)
    want = {}
    for k, _, v, r in rows:
        a, e = want.get(k, (None, None))
        want[k] = (None if r else v if a is None else a * 0.9 + v * 0.1, v if e is None else e * 0.9 + v * 0.1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = {r["k"]: r["average"] for r in D.ewma_cost(df, ["k"], ["t"], "v", "r", 0.1).collect()}
        plain = {r["k"]: r["ema"] for r in H.ema(df, ["k"], ["t"], "v", 0.1).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {k: (pytest.approx(got[k]), pytest.approx(plain[k])) for k in got} == want


def test_upserts_are_compacted(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    for epoch in range(7):
        rows = spark.createDataFrame([(k, epoch * 10 + k, f"v{epoch}") for k in range(epoch % 3 + 1)], "k int, at int, v string")
        rows.withColumn("epoch", F.lit(epoch).cast("long")).write.parquet(f"{path}/batch={epoch}")
        if epoch in (2, 5):
            T.compact(spark, path, ["k"], "at")
            base, parts = T.folders(spark, path)
            assert base == epoch and [(n, p.rsplit("/", 1)[1]) for n, p in parts] == [(epoch, f"upto={epoch}")]
    assert sorted((r["k"], r["at"], r["v"]) for r in T.current(spark, path, ["k"], "at").collect()) == [(0, 60, "v6"), (1, 51, "v5"), (2, 52, "v5")]


def test_error_function(spark):
    from math import erf

    from axisframe.functions.catalogue import UNARY

    xs = [x / 16 for x in range(-120, 121)] + [1e-300, 30.0, -30.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", UNARY["erf"](F.col("x")).alias("e")).collect()
    assert all(abs(r["e"] - erf(r["x"])) < 4e-15 for r in got)


def test_groups_cut_their_tasks_by_edges(spark, monkeypatch):
    """1,000 distinct edges, each twice and back: 20 tasks of about 200 rows make them distinct, with 4 shuffle partitions."""
    from axisframe.operators import lookup as K

    most, whole = [], K.durable
    per_task = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    monkeypatch.setattr(K, "ROWS", 200)
    monkeypatch.setattr(K, "durable", lambda df, *name: most.append(per_task(df)) or whole(df, *name))
    edges = [(i, i + 1) for i in range(500)] + [(1000, 1001 + i) for i in range(500)]
    df = spark.createDataFrame(edges + [(b, a) for a, b in edges] + [(7, None), (5000, 5000)], "a long, b long")
    got = {r["node"]: r["group"] for r in K.connected_groups(df).collect()}
    assert got == {n: 0 for n in range(501)} | {n: 1000 for n in range(1000, 1501)} | {5000: 5000}
    assert most[1] < 200
