"""Registered queries against their SQL in DuckDB on the smallest tables."""

from decimal import Decimal

import duckdb
import pytest

from axisframe.plans import catalogue

DATA = "/root/testdata/sf0.001"
SOME = [
    "s1_tensor_from_table", "s5_pack", "s7_linspace_price_steps", "s16_circulant", "e1_unary_maths", "e3_predicates_e4_nan_to_num", "e5_binary_arithmetic", "e14_masked_select", "e17_softmax",
    "b5_reshape_weeks", "b12_pad_reflect", "b16_rearrange", "k1_top_k_months", "u5_array_split", "u7_pad_conversations", "j1_gram_revenue", "j6_einsum_regions", "j11_nearest_to_label_mean",
    "j17_scatter_add", "j18_searchsorted", "a8_quantiles_per_brand", "a15_histogram", "a16_subtotals", "w1_cumsum_months", "w4_reduce_window", "w9_convolution", "m3_cross_entropy", "l4_least_squares",
    "f2_ema_scan", "q1_check_contract", "q3_broadcast_audit", "q11_oracle_compare", "d1_asof_lookup", "d2_innermost_interval", "d5_connected_groups", "d6_incremental_refresh", "d7_verify_incremental",
    "d10_method_resolution", "t1_debounce_batch", "t2_t6_latest_version_stream", "t5_dedupe_stream",
]


def cell(x):
    """A value as both engines have it: whole numbers of any width alike, no negative zero, structs as tuples."""
    if isinstance(x, (list, tuple)):
        return tuple(cell(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, cell(v)) for k, v in x.items())
    if isinstance(x, Decimal) and x == x.to_integral_value():
        return int(x)
    return x + 0.0 if isinstance(x, float) else x


def rows(table):
    """The rows of an Arrow table, so that whole numbers beside nulls stay whole numbers."""
    return sorted((tuple(cell(r[c]) for c in sorted(r)) for r in table.to_pylist()), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    ours, theirs = catalogue.QUERIES[name](spark, DATA).toArrow(), duck.execute(catalogue.SQL[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize(("name", "columns"), [("t4_change_log_keys", "key version text in_sync"), ("t3_ewma_stream", "user_id average rows"), ("a18_item", "value")])
def test_whole_results_equal_sql(spark, duck, name, columns):
    columns = columns.split()
    ours, theirs = catalogue.QUERIES[name](spark, DATA), duck.execute(catalogue.SQL[name])
    assert ours.columns == columns == [c[0] for c in theirs.description]
    rounded = lambda rows: sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    got, want = rounded(ours.collect()), rounded(theirs.fetchall())
    assert got == want and len(set(got)) == len(got)
    assert name != "t4_change_log_keys" or {r[3] for r in got} == {True, False}
    assert name != "a18_item" or got[0][0] > 1


def test_connected_groups_take_every_link(spark, duck):
    links = duck.execute("SELECT DISTINCT l_partkey * 2, l_suppkey * 2 + 1 FROM lineitem").fetchall()
    up = {n: n for link in links for n in link}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    assert {r["node"]: r["group"] for r in catalogue.QUERIES["d5_connected_groups"](spark, DATA).collect()} == {n: top(n) for n in up}


def test_registry_is_complete():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
    assert len(catalogue.QUERIES) > 150
