"""Queries on further members of the operator families, on sources, sinks and functions of the user."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as Q
from ..operators import broadcast as B
from ..operators import contract as C
from ..operators import hof as H
from ..operators import index as I
from ..operators import reduce as R
from ..operators import reshape as S
from ..operators import split as P
from ..operators import window as W
from ..sources import build
from ..sources.scratch import scratch_folder
from ..tensor import Tensor
from .common import ACT, EMB, PART, QTY, act, emb, price, qty, query, rounded, size, table
from .shapes import FULL, MONTH, by_month


@query("SELECT c_mktsegment AS segment, count(*) AS lines, sum(len(c_name))::BIGINT AS characters FROM customer GROUP BY ALL")
def s2_scan_corpus(spark, d):
    """Customers' names as text files below a folder called build, scanned back without a skipped folder."""
    root = f"{scratch_folder(spark, 'corpus')}/build"
    names = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), "c_name")
    names.write.partitionBy("segment").text(f"{root}/names")
    names.drop("segment").write.text(f"{root}/names/node_modules")
    files = build.scan_corpus(spark, root, "*.txt")
    lines = files.select(F.url_decode(F.regexp_extract("path", "segment=([^/]*)/", 1)).alias("segment"), F.explode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("line"))
    return lines.groupBy("segment").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("characters"))


@query(f"WITH {QTY}, s AS (SELECT nation, sum(value) AS value FROM dense GROUP BY nation) SELECT nation, value * (nation % 3 - 1) AS value FROM s")
def s3_array_literal(spark, d):
    weights = build.array_literal(spark, [float(n % 3 - 1) for n in range(25)], ["nation"])
    return B.binary(R.reduce(qty(spark, d), "sum", "month"), weights, "multiply", outer=False).df


@query("SELECT 'n' AS source, c_custkey::VARCHAR AS row_key, 'size' AS rule, CASE WHEN c_nationkey % 5 = 0 THEN 'approximation' ELSE 'mismatch' END AS kind, 'size is ' || c_nationkey AS message, CASE WHEN c_nationkey % 2 = 0 THEN (c_nationkey % 3)::INT END AS axis FROM customer")
def s15_write_diagnostics(spark, d):
    c, n = table(spark, d, "customer"), F.col("c_nationkey")
    findings = c.select(F.lit("n").alias("source"), F.col("c_custkey").cast("string").alias("row_key"), F.lit("size").alias("rule"), F.when(n % 5 == 0, "approximation").otherwise("mismatch").alias("kind"),
                        F.concat(F.lit("size is "), n.cast("string")).alias("message"), F.when(n % 2 == 0, (n % 3).cast("int")).alias("axis"))
    path = f"{scratch_folder(spark, 'findings')}/all"
    build.write_diagnostics(findings, path)
    return spark.read.schema(findings.schema).parquet(path).select(*findings.columns)


@query(f"WITH {QTY} SELECT nation, month, coalesce(q.value, 0) AS \"left\", coalesce(r.value, 0) AS \"right\" FROM (SELECT * FROM qty WHERE nation < 15) q FULL JOIN (SELECT nation, month, value * 2 + 1 AS value FROM qty WHERE nation > 8) r USING (nation, month)")
def b1_align(spark, d):
    t = qty(spark, d)
    pair = B.align(t.with_df(t.df.filter("nation < 15")), t.with_df(t.df.filter("nation > 8").withColumn("value", F.col("value") * 2 + 1)), outer=True)
    return pair.df.select("nation", "month", "left", "right")


@query(f"{FULL}, s AS (SELECT nation, sum(value) AS s FROM dense GROUP BY nation) SELECT nation, month, round(value / s, 8) AS value FROM dense JOIN s USING (nation)")
def f5_user_function(spark, d):
    """A function of the user, made of operators, called on a tensor and as a step of a pipe."""

    def share(t: Tensor, axis: str) -> Tensor:
        return B.binary(t, R.reduce(t, "sum", axis), "divide", outer=False)

    return rounded(H.sequential(qty(spark, d).dense(), lambda t: share(t, "month")), 8)


@query(f"WITH {ACT}, h AS (SELECT hour, sum(value) AS s, max(value) AS m FROM act GROUP BY hour), hours AS (SELECT unnest(range(24)) AS hour) SELECT k::BIGINT AS stack, hour, coalesce(CASE k WHEN 0 THEN s WHEN 1 THEN m END, 0) * 2 + 1 AS value FROM range(2) r(k), hours LEFT JOIN h USING (hour)")
def f6_map_stack(spark, d):
    t = act(spark, d)
    both = [R.reduce(Tensor(t.df, t.dims, t.sizes, None), how, "user").with_sizes(hour=24) for how in ("sum", "max")]
    dense = [Tensor(x.df, x.dims, x.sizes, 0.0).dense() for x in both]
    return H.map_stack(lambda x: x.map(lambda v: v * 2 + 1), dense).df


@query(f"WITH {QTY} SELECT a.nation, b.nation AS other, sum(a.value * b.value) AS value FROM dense a JOIN dense b USING (month) GROUP BY ALL")
def j2_mm(spark, d):
    t = qty(spark, d)
    return C.mm(t, S.transpose(t).rename(nation="other")).dense().df


@query(f"WITH {ACT}, b AS (SELECT \"user\" % 7 AS g, \"user\" AS u, hour, value FROM act), p AS (SELECT a.g, a.hour AS h1, b.hour AS h2, sum(a.value * b.value) AS v FROM b a JOIN b ON a.g = b.g AND a.u = b.u GROUP BY ALL) SELECT i::BIGINT AS g, j::BIGINT AS h1, k::BIGINT AS h2, coalesce(v, 0) * 2 + (i + j - k) * 3.0::DOUBLE AS value FROM range(7) x(i), range(24) y(j), range(24) z(k) LEFT JOIN p ON p.g = i AND p.h1 = j AND p.h2 = k")
def j2_baddbmm(spark, d):
    t = act(spark, d)
    x = Tensor(t.df.select((F.col("user") % 7).alias("g"), F.col("user").alias("u"), F.col("hour").alias("h1"), "value"), ("g", "u", "h1"), (7, None, 24), 0.0)
    c = build.full(spark, {"g": 7, "h1": 24, "h2": 24}, 0.0)
    c = Tensor(c.df.withColumn("value", (F.col("g") + F.col("h1") - F.col("h2")).cast("double")), c.dims, c.sizes, 0.0)
    return C.baddbmm(c, S.transpose(x, ["g", "h1", "u"]), x.rename(h1="h2"), beta=3, alpha=2).df


@query(f"{MONTH}, k AS (SELECT month, sum(value) * 2 AS w FROM dense WHERE nation < 9 GROUP BY month) SELECT sum(value * w) AS value FROM m JOIN k USING (month)")
def j3_inner_of_vectors(spark, d):
    t = qty(spark, d)
    w = R.reduce(t.with_df(t.df.filter("nation < 9")), "sum", "nation").map(lambda v: v * 2)
    return C.inner(by_month(spark, d), w).df


@query(f"WITH {ACT} SELECT a.hour, a.\"user\" % 5 AS p, b.\"user\" % 3 AS q, sum(a.value * b.value) AS value FROM act a JOIN act b ON a.hour = b.hour AND a.\"user\" // 5 = b.\"user\" // 3 GROUP BY ALL")
def j5_dot_general(spark, d):
    t = act(spark, d).df
    side = lambda n, name: Tensor(t.select(F.floor(F.col("user") / n).alias("u"), (F.col("user") % n).alias(name), "hour", "value"), ("u", name, "hour"), (None, n, 24), 0.0)
    return C.dot_general(side(5, "p"), side(3, "q"), (["u"], ["u"]), (["hour"], ["hour"])).df.select("hour", "p", "q", "value")


UPDATES = "u AS (SELECT s_nationkey::BIGINT AS nation, (s_suppkey % 12)::BIGINT AS month, max(s_suppkey % 5 + 1)::DOUBLE AS top, min(s_suppkey % 5 + 1)::DOUBLE AS least, round(exp(sum(ln(s_suppkey % 5 + 1))), 3) AS product FROM supplier GROUP BY ALL)"


@query(f"{FULL}, {UPDATES} SELECT nation, month, CASE WHEN top IS NULL THEN value ELSE top END AS put, greatest(value, coalesce(top, value)) AS most, least(value, coalesce(least, value)) AS fewest, round(value * coalesce(product, 1), 3) AS times, CASE WHEN top IS NULL THEN value ELSE -value END AS applied FROM dense LEFT JOIN u USING (nation, month)")
def j17_scatter_forms(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("nation"), (F.col("s_suppkey") % 12).alias("month"), (F.col("s_suppkey") % 5 + 1).cast("double").alias("value"))
    updates, t = Tensor(rows, ("nation", "month"), (25, 12), 0.0), qty(spark, d)
    forms = {"put": I.scatter(t, updates, "set"), "most": I.scatter(t, updates, "max"), "fewest": I.scatter(t, updates, "min"), "times": I.scatter(t, updates, "mul"), "applied": I.scatter_apply(t, rows, lambda v: -v)}
    out = t.dense().df.select("nation", "month")
    for name, x in forms.items():
        out = out.join(x.df.select("nation", "month", (F.round("value", 3) + F.lit(0.0)).alias(name)), ["nation", "month"])
    return out


@query(f"{MONTH} SELECT month, CASE WHEN month >= n - 6 THEN (SELECT -value FROM m x WHERE x.month = m.month - (n - 6)) ELSE value END AS value FROM m, n")
def j17_dynamic_update_slice(spark, d):
    t = by_month(spark, d)
    return I.dynamic_update_slice(t, I.slice_dim(t, "month", 0, 6).map(lambda v: -v), {"month": 10_000}).df


@query(f"WITH {QTY} SELECT month, nation, value FROM qty")
def b9_rollaxis(spark, d):
    out = S.rollaxis(qty(spark, d), "month")
    return out.df.select(*out.dims, "value")


@query(f"{FULL} SELECT month, value FROM dense WHERE nation = 7")
def b10_squeeze(spark, d):
    return S.squeeze(I.narrow(qty(spark, d).dense(), "nation", 7, 1), "nation").df


@query(f"{MONTH} SELECT (month + n // 2) % n AS month, value FROM m, n")
def b11_fftshift(spark, d):
    return S.fftshift(by_month(spark, d)).df


@query(f"{MONTH} SELECT o::BIGINT AS month, value FROM n, range(400) r(o) JOIN m ON month = least(greatest(o - 3, 0), n - 1) WHERE o < n + 5")
def b12_pad_replicate(spark, d):
    return S.pad(by_month(spark, d), {"month": (3, 2)}, "edge").df


@query(f"{FULL} SELECT (month // (n // 5 + CASE WHEN n % 5 > 0 THEN 1 ELSE 0 END))::BIGINT AS piece, nation, count(*) AS cells, sum(value) AS total FROM dense, n GROUP BY ALL")
def u6_chunk(spark, d):
    out = None
    for k, piece in enumerate(P.chunk(qty(spark, d).dense(), 5, "month")):
        part = piece.df.groupBy("nation").agg(F.count("*").alias("cells"), F.sum("value").alias("total")).select(F.lit(k).cast("long").alias("piece"), "nation", "cells", "total")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {EMB} SELECT vec, k, round(avg(value), 8) + 0.0 AS value FROM (SELECT vec, k // 4 AS k, value FROM emb) GROUP BY ALL")
def w5_average_pool(spark, d):
    return rounded(W.pool(emb(spark, d), 4, "mean", spatial=1), 8)


@query(f"WITH {EMB} SELECT vec, o::BIGINT AS k, max(value) AS value FROM emb JOIN range(13) r(o) ON k BETWEEN o * 5 AND o * 5 + 5 GROUP BY ALL")
def w5_ceil_mode_pool(spark, d):
    return W.pool(emb(spark, d), 6, stride=5, ceil_mode=True, spatial=1).df


@query(f"WITH {EMB} SELECT vec, k, round((value - avg(value) OVER w) / sqrt(var_pop(value) OVER w + 1e-5), 6) + 0.0 AS value FROM emb WINDOW w AS (PARTITION BY k)")
def e20_batch_norm(spark, d):
    return rounded(W.normalise(emb(spark, d), "vec"))


@query(f"WITH {EMB} SELECT vec, k, round((value - avg(value) OVER w) / sqrt(var_pop(value) OVER w + 1e-5), 6) + 0.0 AS value FROM emb WINDOW w AS (PARTITION BY vec, k // 8)")
def e20_group_norm(spark, d):
    t = S.unflatten(emb(spark, d), "k", {"c": 16, "j": 4})
    return rounded(S.flatten(W.group_norm(t, 8, "c", "j"), 1, 2, "k"))


@query(f"WITH {PART}, s AS (SELECT part, exp(size / 10 - t) AS e FROM pr, (SELECT max(size / 10) AS t FROM pr)) SELECT part, round(e / (SELECT sum(e) FROM s), 12) AS value FROM s")
def e17_softmax_of_a_vector(spark, d):
    t = size(spark, d).map(lambda v: v / 10)
    return rounded(W.softmax(Tensor(t.df, t.dims, t.sizes, None)), 12)


@query(f"WITH {PART} SELECT part, round((price - (SELECT avg(price) FROM pr)) / sqrt((SELECT var_pop(price) FROM pr) + 1e-5), 6) + 0.0 AS value FROM pr")
def e20_normalise_a_vector(spark, d):
    t = price(spark, d)
    return rounded(W.normalise(Tensor(t.df, t.dims, t.sizes, None), None))


@query("SELECT q::BIGINT AS q, round(CASE q WHEN 0 THEN quantile_cont(l_extendedprice, 0.1) WHEN 1 THEN quantile_cont(l_extendedprice, 0.5) ELSE quantile_cont(l_extendedprice, 0.99) END, 4) AS value FROM lineitem, range(3) r(q) GROUP BY q")
def a8_quantiles_of_all_lines(spark, d):
    """Quantiles without a group: one sort by ranges, no task with all rows."""
    lines = table(spark, d, "lineitem").select(F.monotonically_increasing_id().alias("row"), F.col("l_extendedprice").alias("value"))
    return rounded(R.quantile(Tensor(lines, ("row",), (None,), None), [0.1, 0.5, 0.99]), 4)


@query("""SELECT 'x' AS source, vec_id::VARCHAR AS row_key, 'contract' AS rule, 'mismatch' AS kind, 'size is not n = ' || (vec_id % 3 + 1) || ': ' || (vec_id % 4 + 1) AS message, 1 AS axis FROM embeddings WHERE vec_id % 3 <> vec_id % 4
UNION ALL SELECT 'y', vec_id::VARCHAR, 'contract', 'mismatch', 'size is not n+1 = ' || (vec_id % 3 + 2) || ': ' || (vec_id % 5 + 1), -1 FROM embeddings WHERE vec_id % 3 + 1 <> vec_id % 5""")
def q1_named_dims(spark, d):
    """`n n` binds n within a row, and `*b n+1` reckons with it in another column."""
    n = lambda m: (F.col("vec_id") % m + 1).cast("int")
    x = F.array_repeat(F.array_repeat(F.lit(0), n(4)), n(3))
    y = F.array(F.array_repeat(F.lit(0), n(5)))
    return Q.check_contracts(table(spark, d, "embeddings").select("vec_id", x.alias("x"), y.alias("y")), "vec_id", {"x": "n n", "y": "*b n+1"})
