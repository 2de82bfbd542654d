"""Products by tiles and cyclic sums against numpy; what is shuffled and how much arises on the way."""

import numpy as np
import pandas as pd
import pytest

from axisframe.operators import blocks, cyclic
from axisframe.operators import contract as C
from axisframe.tensor import Tensor


def tensor(spark, x, dims, fill=0.0):
    at = np.nonzero(x)
    return Tensor(spark.createDataFrame(pd.DataFrame({**{d: a.astype("int64") for d, a in zip(dims, at, strict=True)}, "value": x[at].astype(float)})), dims, x.shape, fill)


def array(t):
    out, rows = np.zeros(t.sizes), t.df.toPandas()
    if not t.rank:
        return float(rows["value"].iloc[0])
    out[tuple(rows[d].to_numpy() for d in t.dims)] = rows["value"]
    return out


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(blocks, "TILE", 16)
    monkeypatch.setattr(blocks, "DEPTH", 8)
    monkeypatch.setattr(blocks, "GROUP", 2)


def test_tiles_equal_rows(spark, small_tiles):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(3, 40, 50)) * (rng.random((3, 40, 50)) < 0.3)
    b = rng.normal(size=(3, 50, 4, 9))
    got = blocks.blocked(tensor(spark, a, ["z", "i", "k"]), tensor(spark, b, ["z", "k", "m", "j"]), ["k"], ["z", "m", "i", "j"])
    assert got.dims == ("z", "m", "i", "j") and got.sizes == (3, 4, 40, 9)
    assert array(got) == pytest.approx(np.einsum("zik,zkmj->zmij", a, b))
    rows = C.contract(tensor(spark, a, ["z", "i", "k"]), tensor(spark, b, ["z", "k", "m", "j"]), ["k"], ["z", "m", "i", "j"])
    assert array(rows) == pytest.approx(array(got))


def test_matmul_takes_tiles_where_neither_side_is_small(spark, small_tiles, monkeypatch):
    monkeypatch.setattr(blocks, "MUCH", 1000)
    monkeypatch.setattr(C, "SMALL", 10)
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 30)), rng.normal(size=(30, 50))
    x[:, 7] = 1
    x[:, :7] = x[:, 8:] = 0  # one summed position holds all cells of a side
    product = C.matmul(tensor(spark, x, ["i", "k"]), tensor(spark, y, ["k", "j"]))
    assert "MapInArrow" in product.df._jdf.queryExecution().toString()
    assert array(product) == pytest.approx(x @ y)
    unknown = Tensor(tensor(spark, x, ["i", "k"]).df, ("i", "k"), (None, None), 0.0)
    assert "MapInArrow" not in C.matmul(unknown, tensor(spark, y, ["k", "j"])).df._jdf.queryExecution().toString()


def test_a_large_product_shuffles_tiles(spark):
    """600 x 600 x 600: 360,000 cells a side and few tiles, where rows would be 2.2 * 10 ** 8."""
    n = 600
    square = lambda names, f: Tensor(spark.range(n * n).selectExpr(f"id div {n} AS {names[0]}", f"id % {n} AS {names[1]}", f"CAST({f} AS DOUBLE) AS value"), names, (n, n), None)
    x, y = square(("i", "k"), f"(id div {n} + id % {n}) % 7 - 3"), square(("k", "j"), f"(id div {n} * 3 + id % {n}) % 5 - 2")
    assert blocks.pays(x, y, ["k"]) and not blocks.pays(x, Tensor(y.df, y.dims, (n, None), None), ["k"])
    out = C.matmul(x, y)
    i = np.arange(n)
    want = ((i[:, None] + i) % 7 - 3) @ ((i[:, None] * 3 + i) % 5 - 2)
    assert out.df.selectExpr("sum(value) AS s", "sum(value * value) AS q", "count(*) AS n").first()[:2] == (want.sum(), float((want.astype(float) ** 2).sum()))
    assert array(out)[[0, 300, 599]] == pytest.approx(want[[0, 300, 599]])


@pytest.mark.parametrize("spec", ["ab,bc,ca->", "ab,bc,ca->b", "ab,bc,cd,da->ac", "abc,bcd,cda,dab->a", "ab,bc,ca,ae->e", "abf,bc,ca->b"])
def test_cyclic_sums(spark, spec):
    rng = np.random.default_rng(len(spec))
    sizes = dict(zip("abcdef", (11, 9, 12, 6, 5, 4), strict=True))
    terms = spec.split("->")[0].split(",")
    xs = [rng.integers(0, 3, size=[sizes[c] for c in t]) * (rng.random([sizes[c] for c in t]) < 0.6) for t in terms]
    ts = [tensor(spark, x, [f"d{c}" for c in t]) for x, t in zip(xs, terms, strict=True)]
    got = C.einsum(spec, *ts)
    assert "cell_" in got.df._jdf.queryExecution().toString()
    assert array(got) == pytest.approx(np.einsum(spec, *xs))


def test_which_sums_are_cyclic():
    terms = lambda spec: [set(t) for t in spec.split(",")]
    assert all(cyclic.is_cyclic(terms(s)) for s in ("ab,bc,ca", "ab,bc,cd,da", "abc,cde,efa", "ab,bc,ca,cz"))
    assert not any(cyclic.is_cyclic(terms(s)) for s in ("ab,bc", "ab,bc,cd", "ab,bc,ca,abc", "ab,ac,ad", "ab,ab", "a,b"))


def test_bindings_stay_within_the_worst_case(monkeypatch):
    """Two pairwise joins of this triangle have n * n / 4 rows; label by label at most about n arise."""
    n = 2000
    hub = np.zeros(n // 2, np.int64)
    leaf = np.arange(1, n // 2 + 1)
    edges = np.concatenate([np.stack([hub, leaf]), np.stack([leaf, hub])], axis=1)
    terms, labels = [("a", "b"), ("b", "c"), ("a", "c")], ["a", "b", "c"]
    seen = []
    whole = cyclic.Trie.find
    monkeypatch.setattr(cyclic.Trie, "find", lambda self, level, node, rank, known: seen.append(len(node)) or whole(self, level, node, rank, known))
    values = [np.ones(edges.shape[1])] * 3
    out = list(cyclic.summed_in_cell([list(edges)] * 3, values, terms, labels, []))
    assert sum(s.sum() for _, s in out) == 0  # a star has no triangle
    assert sum(seen) < 6 * n


def test_hot_values_are_spread(spark, monkeypatch):
    monkeypatch.setattr(cyclic, "LOAD", 300)
    rows = [(7, i) for i in range(2000)] + [(i, i % 40) for i in range(100)]
    df = spark.createDataFrame(rows, "a long, b long")
    small = spark.createDataFrame([(i % 40, i % 9) for i in range(60)], "b long, c long")
    third = spark.createDataFrame([(i % 9, i) for i in range(60)], "c long, a long")
    terms = [("a", "b"), ("b", "c"), ("c", "a")]
    first = cyclic.shares([2100, 60, 60], terms)
    p = cyclic.spread_hot([df, small, third], terms, first)
    assert cyclic.fullest(df, terms[0], p) <= 300 < 2000
    assert p["b"] > 1


def test_tiles_are_sent_to_strips(spark, monkeypatch):
    """A tile goes once to each strip of the other side, not to each of its tiles."""
    monkeypatch.setattr(blocks, "TILE", 4)
    monkeypatch.setattr(blocks, "DEPTH", 8)
    monkeypatch.setattr(blocks, "PAIRS", 4)
    x = np.random.default_rng(2).normal(size=(160, 16))
    left, right = tensor(spark, x, ["i", "k"]), tensor(spark, x.T, ["k", "j"])
    pairs, _, strip = blocks.met(left, right, ["k"], None)
    assert strip and pairs.count() == 40 * 2 * 2 * 2  # 40 tiles by 2 summed ranges, 2 sides, 2 strips of the other side
    assert array(blocks.blocked(left, right, ["k"], ["i", "j"])) == pytest.approx(x @ x.T)
    monkeypatch.setattr(blocks, "HELD", 16 * 4 * 5)
    pairs, keys, _ = blocks.met(left, right, ["k"], None)
    assert pairs.count() == 40 * 2 * 2 * 8  # strips of 5 tiles, as many as may be held
    assert max(r["count"] for r in pairs.groupBy(*keys).count().collect()) == 2 * 5 * 2


@pytest.mark.parametrize("held", [1, 1 << 22])
def test_totals_of_rows(spark, monkeypatch, held):
    """Over all cells that meet, be they zero, and none of those that do not; no largest value where a row meets itself only."""
    for name, value in (("TILE", 8), ("DEPTH", 4), ("GROUP", 2), ("PAIRS", 4), ("HELD", held)):
        monkeypatch.setattr(blocks, name, value)
    rng = np.random.default_rng(3)
    x, y = (rng.integers(-2, 3, size=s).astype(float) for s in ((50, 23), (23, 41)))
    a, b = rng.random(x.shape) < 0.15, rng.random(y.shape) < 0.15
    a[20:28], b[:, 16:24] = True, True
    a[7], a[11], b[9] = False, False, False
    a[7, 9], b[9, 7] = True, True
    one = lambda v, there, dims: Tensor(spark.createDataFrame([(int(i), int(j), float(v[i, j])) for i, j in zip(*np.nonzero(there), strict=True)], f"{dims[0]} long, {dims[1]} long, value double"), dims, v.shape, None)
    got = {r["i"]: r[1:] for r in blocks.row_totals(one(x, a, ("i", "k")), one(y, b, ("k", "j")), ["k"]).collect()}
    value, meets = (x * a) @ (y * b), a.astype(int) @ b.astype(int) > 0
    assert got.keys() == set(np.flatnonzero(meets.any(axis=1)).tolist()) and 11 not in got
    for i, (total, most, square) in got.items():
        others = [value[i, j] for j in range(41) if meets[i, j] and j != i]
        assert total == pytest.approx(value[i][meets[i]].sum()) and square == pytest.approx((value[i][meets[i]] ** 2).sum())
        assert most == (max(others) if others else None)
    assert got[7][1] is None


def test_the_embeddings_product_gives_totals_and_no_cells(spark):
    from axisframe.plans.catalogue import QUERIES

    plan = QUERIES["j1_product_by_tiles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "square" in plan and "j_" not in plan


def test_cyclic_rows_are_sent_in_bundles(spark, monkeypatch):
    """36,000 rows a side in few rows of few bytes, whatever their signs and widths."""
    made, whole = [], cyclic.bundles
    monkeypatch.setattr(cyclic, "bundles", lambda df, term: made.append((df.count(), whole(df, term).selectExpr("count(*) AS n", "sum(length(data)) AS bytes").first())) or whole(df, term))
    side = lambda a, b: Tensor(spark.range(36000).selectExpr(f"(id * 7) % 300 AS {a}", f"id div 300 AS {b}", "1.0D AS value"), (a, b), (300, 300), 0.0)
    got = C.einsum("ab,bc,ca->b", side("a", "b"), side("b", "c"), side("c", "a")).df
    assert got.count() > 0
    for rows, sent in made:
        assert rows == 36000 and sent["n"] < 36000 / 20 and sent["bytes"] < 6 * 36000
    columns = [np.array([-(2**62), 5, 5, 2**61]), np.array([3, -200, 70000, 2**40])]
    assert [x.tolist() for x in cyclic.unbundled(cyclic.bundled(columns, np.arange(4) / 2))] == [*(c.tolist() for c in columns), [0, 0.5, 1, 1.5]]


def test_the_triangles_read_the_sales_once(spark, monkeypatch):
    from axisframe.plans import products

    calls, whole = [], products.durable
    monkeypatch.setattr(products, "durable", lambda df, *name: calls.append(name) or whole(df, *name))
    out = products.j6_cyclic_einsum(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1 and "orders" not in out._jdf.queryExecution().toString() and out.count() == 10
