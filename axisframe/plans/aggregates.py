"""Queries on contractions, lookups by index, aggregations, windows, losses and tall matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
import numpy as np
from pyspark.sql import functions as F

from ..operators import broadcast as B
from ..operators import contract as C
from ..operators import index as I
from ..operators import linalg as A
from ..operators import losses as L
from ..operators import reduce as R
from ..operators import reshape as S
from ..operators import split as P
from ..operators import window as W
from ..sources import build
from ..sources.build import tensor_from_table
from ..tensor import Tensor
from .common import ACT, DAILY, EMB, PART, QTY, REV, act, daily, emb, plain, price, qty, query, rev, rounded, size, table
from .elementwise import GRAM, gram
from .shapes import FULL, MONTH, by_month


@query(f"WITH {REV} SELECT a.nation, b.nation AS other, round(sum(a.value * b.value) / 1e9, 2) AS value FROM rev a JOIN rev b USING (month) GROUP BY ALL")
def j1_gram_revenue(spark, d):
    t = rev(spark, d)
    product = C.matmul(t, S.transpose(t).rename(nation="other"))
    return rounded(product.map(lambda v: v / 1e9), 2)


@query(f"{GRAM}, k AS (SELECT nation, sum(value) AS v FROM dense GROUP BY nation) SELECT g.nation, round(sum(g.value * k.v) / 1e6, 2) AS value FROM gram g JOIN k ON g.other = k.nation GROUP BY g.nation")
def j2_mv(spark, d):
    v = R.reduce(qty(spark, d), "sum", "month")
    return rounded(C.mv(gram(spark, d), v.rename(nation="x")).map(lambda x: x / 1e6), 2)


@query(f"{GRAM} SELECT nation, other, value * 2 + CASE WHEN nation = other THEN 1 ELSE 0 END AS value FROM gram")
def j2_addmm(spark, d):
    t = qty(spark, d)
    one = build.eye(spark, 25, dims=("p", "q"), sparse=False)
    return C.addmm(one, t, S.transpose(t).rename(nation="other"), alpha=2).df


@query(f"WITH {ACT}, b AS (SELECT \"user\" % 7 AS g, \"user\" AS u, hour, value FROM act) SELECT a.g, a.hour AS h1, b.hour AS h2, sum(a.value * b.value) AS value FROM b a JOIN b ON a.g = b.g AND a.u = b.u GROUP BY ALL")
def j2_bmm(spark, d):
    t = act(spark, d)
    x = Tensor(t.df.select((F.col("user") % 7).alias("g"), F.col("user").alias("u"), F.col("hour").alias("h1"), "value"), ("g", "u", "h1"), (7, None, 24), 0.0)
    left = S.transpose(x, ["g", "h1", "u"])
    return C.bmm(left, x.rename(h1="h2")).df


@query(f"WITH {QTY} SELECT sum(value * value) AS value FROM qty")
def j3_vdot(spark, d):
    t = qty(spark, d)
    return C.vdot(t, t).df


@query(f"{MONTH}, k AS (SELECT nation, sum(value) AS v FROM dense GROUP BY nation) SELECT nation, month, value * v AS value FROM k CROSS JOIN m")
def j4_outer(spark, d):
    return C.outer(R.reduce(qty(spark, d), "sum", "month"), by_month(spark, d)).df


@query(f"{GRAM} SELECT nation * 2 + p AS nation, other * 2 + q AS other, value * (p + 2 * q + 1) AS value FROM gram, range(2) x(p), range(2) y(q)")
def j4_kron(spark, d):
    return C.kron(gram(spark, d), build.array_literal(spark, [[1, 3], [2, 4]], ["p", "q"])).df


@query(f"WITH {QTY}, k AS (SELECT nation AS i, sum(value) AS v FROM dense GROUP BY nation) SELECT a.i AS i0, a.v AS v0, b.i AS i1, b.v AS v1 FROM k a JOIN k b ON a.i < b.i")
def j4_combinations(spark, d):
    return C.combinations(R.reduce(qty(spark, d), "sum", "month"), 2)


@query(f"WITH {QTY} SELECT a.month AS month, b.month AS month_, sum(a.value * b.value) AS value FROM qty a JOIN qty b USING (nation) GROUP BY ALL")
def j5_tensordot(spark, d):
    t = qty(spark, d)
    return C.tensordot(t, t, ["nation"], ["nation"]).df


@query(f"WITH {QTY}, s AS (SELECT n_regionkey::BIGINT AS r, n_nationkey::BIGINT AS nation FROM nation) SELECT x.r AS a, y.r AS b, sum(p.value * q.value) AS value FROM qty p JOIN qty q USING (month) JOIN s x ON x.nation = p.nation JOIN s y ON y.nation = q.nation GROUP BY ALL")
def j6_einsum_regions(spark, d):
    t = qty(spark, d)
    member = tensor_from_table(table(spark, d, "nation"), {"r": F.col("n_regionkey").cast("long"), "n": F.col("n_nationkey").cast("long")}, F.lit(1.0), sizes={"r": 5, "n": 25})
    return C.einsum("an,nm,km,bk->ab", member, t, t, member).df


@query("""WITH s AS (SELECT n_regionkey::BIGINT AS r, n_nationkey::BIGINT AS n FROM nation), p AS (SELECT a.n AS i, b.n AS j, 1.0 AS v FROM s a JOIN s b ON a.r = b.r),
p2 AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM p a JOIN p b ON a.j = b.i GROUP BY ALL) SELECT a.i, b.j, sum(a.v * b.v)::DOUBLE AS value FROM p2 a JOIN p b ON a.j = b.i GROUP BY ALL""")
def j7_matrix_power(spark, d):
    n = table(spark, d, "nation")
    other = n.select(F.col("n_nationkey").cast("long").alias("j"), F.col("n_regionkey").alias("r2"))
    pairs = n.join(other, F.col("n_regionkey") == F.col("r2"))
    t = tensor_from_table(pairs, {"i": F.col("n_nationkey").cast("long"), "j": F.col("j")}, F.lit(1.0), sizes={"i": 25, "j": 25})
    return C.matrix_power(t, 3).df


@query(f"WITH {EMB}, x AS (SELECT vec, k // 3 AS g, k % 3 AS j, value FROM emb WHERE k < 63), w AS (SELECT vec, g, max(value) FILTER (j = 0) AS a, max(value) FILTER (j = 1) AS b, max(value) FILTER (j = 2) AS c FROM x GROUP BY ALL), p AS (SELECT u.vec, u.b * v.c - u.c * v.b AS x0, u.c * v.a - u.a * v.c AS x1, u.a * v.b - u.b * v.a AS x2 FROM w u JOIN w v ON u.vec = v.vec AND u.g = 0 AND v.g = 1) SELECT vec, j::BIGINT AS j, round(CASE j WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END, 9) + 0.0 AS value FROM p, range(3) r(j)")
def j8_cross(spark, d):
    t = S.unflatten(I.slice_dim(emb(spark, d), "k", 0, 63), "k", {"g": 21, "j": 3})
    return rounded(C.cross(I.index_dim(t, "g", 0), I.index_dim(t, "g", 1)), 9)


@query(f"WITH {EMB} SELECT vec, o::BIGINT AS o, round(sum(value * ((k + o) % 5 - 2)) + any_value(o), 6) + 0.0 AS value FROM emb, range(3) r(o) GROUP BY vec, o")
def j9_linear(spark, d):
    weight = build.array_literal(spark, [[(k + o) % 5 - 2 for k in range(64)] for o in range(3)], ["o", "k"])
    return rounded(C.linear(emb(spark, d), weight, build.array_literal(spark, [0, 1, 2], ["o"])))


@query("""SELECT vec_id, list_transform([0, 1, 2], lambda o: round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * ((i - 1 + o) % 5 - 2))), 6) + 0.0) AS scores FROM embeddings""")
def j9_packed_linear(spark, d):
    weight = [[float((k + o) % 5 - 2) for k in range(64)] for o in range(3)]
    out = C.packed_linear(table(spark, d, "embeddings"), "embedding", weight)
    return out.select("vec_id", F.transform("scores", lambda x: F.round(x, 6) + 0.0).alias("scores"))


@query(f"WITH {EMB} SELECT a.vec, o::BIGINT AS o, round(sum(a.value * b.value * CASE WHEN a.k = (b.k + o) % 64 THEN 1 ELSE 0 END), 6) + 0.0 AS value FROM emb a JOIN emb b USING (vec), range(2) r(o) GROUP BY ALL")
def j10_bilinear(spark, d):
    shift = [[[1.0 if a == (b + o) % 64 else 0.0 for b in range(64)] for a in range(64)] for o in range(2)]
    t = emb(spark, d)
    return rounded(C.bilinear(t, build.array_literal(spark, shift, ["o", "p", "q"]), t))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
m AS (SELECT label, k, avg(x) AS x FROM (SELECT label, unnest(range(64)) AS k, unnest(v) AS x FROM e) GROUP BY ALL), p AS (SELECT label, list(x ORDER BY k) AS p FROM m GROUP BY label),
s AS (SELECT vec_id, label, list_cosine_similarity(v, p) AS s FROM e JOIN p USING (label)), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 6) DESC, vec_id)::INT AS rank FROM s)
SELECT label, rank, vec_id, round(s, 6) AS similarity FROM r WHERE rank <= 5""")
def j11_nearest_to_label_mean(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    means = e.select("label", F.posexplode("v").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("x"))
    means = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("p"))
    near = e.join(means, "label").withColumn("similarity", F.round(C.cosine(F.col("v"), F.col("p")), 6))
    w = Window.partitionBy("label").orderBy(F.desc("similarity"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("label", "rank", "vec_id", "similarity")


@query(f"WITH {EMB} SELECT a.vec, round(sum(a.value * b.value) / (sqrt(sum(a.value * a.value)) * sqrt(sum(b.value * b.value))), 6) + 0.0 AS value FROM emb a JOIN emb b ON a.vec = b.vec AND b.k = a.k + 32 GROUP BY a.vec")
def j11_cosine_of_halves(spark, d):
    a, b = P.split(emb(spark, d), 2, "k")
    return rounded(C.cosine_similarity(a, b))


@query(f"""WITH {QTY}, x AS (SELECT nation, month, value / 10000 AS value FROM dense), w AS (SELECT sqrt(count(*)) AS w FROM months),
s AS (SELECT a.nation AS q, b.nation AS k, sum(a.value * b.value) / any_value(w) AS s FROM x a JOIN x b USING (month), w GROUP BY ALL), p AS (SELECT q, k, exp(s - max(s) OVER (PARTITION BY q)) AS e FROM s), z AS (SELECT q, k, e / sum(e) OVER (PARTITION BY q) AS p FROM p)
SELECT q AS nation, month AS month_, round(sum(p * value), 6) AS value FROM z JOIN x ON x.nation = z.k GROUP BY ALL""")
def j12_attention(spark, d):
    t = qty(spark, d).dense().map(lambda v: v / 10000)
    t = t.with_sizes(month=t.length("month"))
    out = C.attention(t, t, t)
    return out.df.select("nation", F.col(out.dims[-1]).alias("month_"), F.round("value", 6).alias("value"))


@query("""WITH pr AS (SELECT p_partkey, max(p_retailprice) AS price, max(p_size)::DOUBLE AS size FROM part GROUP BY ALL), l AS (SELECT l_orderkey AS o, l_linenumber AS l, max(l_partkey) AS p FROM lineitem GROUP BY ALL)
SELECT o, l, c::BIGINT AS c, CASE c WHEN 0 THEN price ELSE size END AS value FROM l JOIN pr ON p = p_partkey, range(2) r(c)""")
def j13_embedding_of_parts(spark, d):
    ids = tensor_from_table(table(spark, d, "lineitem"), {"o": F.col("l_orderkey"), "l": F.col("l_linenumber")}, "l_partkey", "max", fill=None)
    rows = P.stack([price(spark, d), size(spark, d)], 1, "c")
    return I.embedding(ids, rows).df


@query(f"{FULL} SELECT CASE nation WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END::BIGINT AS pick, month, value FROM dense WHERE nation IN (3, 1, 24)")
def j14_take(spark, d):
    t = qty(spark, d).dense()
    at = build.array_literal(spark, [3, 1, -1], ["pick"])
    return I.take(Tensor(t.df, t.dims, (25, t.length("month")), 0.0), at, "nation").df


@query(f"{FULL} SELECT nation, 0::BIGINT AS month, value FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY value DESC, month) AS r FROM dense) WHERE r = 1")
def j15_take_along_argmax(spark, d):
    t = qty(spark, d).dense()
    at = R.arg(t, "max", "month")
    at = at.with_df(at.df.withColumn("month", F.lit(0).cast("long")), ["nation", "month"], [25, 1])
    return I.take_along(t, at, "month").df


@query(f"{MONTH} SELECT n_nationkey::BIGINT AS \"window\", o::BIGINT AS \"offset\", value FROM nation, range(4) r(o), n JOIN m ON month = least(greatest(n_nationkey * 5 - 3, 0), n - 4) + o")
def j16_window_gather(spark, d):
    starts = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("window"), (F.col("n_nationkey") * 5 - 3).cast("long").alias("start"))
    return I.window_gather(by_month(spark, d), starts, "month", 4).df.select("window", "offset", "value")


@query(f"{FULL}, u AS (SELECT s_nationkey::BIGINT AS nation, (s_suppkey % 12)::BIGINT AS month, count(*)::DOUBLE AS c FROM supplier GROUP BY ALL) SELECT nation, month, value + coalesce(c, 0) AS value FROM dense LEFT JOIN u USING (nation, month)")
def j17_scatter_add(spark, d):
    updates = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("nation"), (F.col("s_suppkey") % 12).alias("month"), F.lit(1.0).alias("value"))
    return I.scatter(qty(spark, d), Tensor(updates, ("nation", "month"), (25, 12), 0.0), "add").df


@query("SELECT p_partkey, (SELECT count(*) FROM supplier WHERE s_acctbal < p_retailprice * 4 - 1000) AS position FROM part")
def j18_searchsorted(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_acctbal").alias("v"))
    values = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * 4 - 1000).alias("v"))
    return I.searchsorted(a, values, "v").select("p_partkey", "position")


@query('SELECT doc_id AS doc, c::BIGINT AS "class", CASE WHEN quality + 2 * toxic = c THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM labels, range(4) r(c)')
def j19_one_hot_labels(spark, d):
    t = tensor_from_table(table(spark, d, "labels"), {"doc": F.col("doc_id")}, F.col("quality") + 2 * F.col("toxic"), "max", fill=None)
    return I.one_hot(t, 4).df


@query(f"{GRAM} SELECT nation, other, value FROM gram UNION ALL SELECT nation + 25, other + 25, -value FROM gram")
def j20_block_diag(spark, d):
    g = gram(spark, d)
    return P.block_diag(g, g.map(lambda v: -v)).df


@query(f"{FULL} SELECT nation, month FROM dense ANTI JOIN qty USING (nation, month)")
def j21_missing_cells(spark, d):
    return P.missing_cells(qty(spark, d))


@query(f"{MONTH} SELECT month, value FROM m")
def a1_sum(spark, d):
    return R.reduce(qty(spark, d), "sum", "nation").dense().df


@query(f"{FULL} SELECT nation, round(avg(value), 6) AS value FROM dense GROUP BY nation")
def a1_mean(spark, d):
    return rounded(R.reduce(qty(spark, d), "mean", "month"))


@query(f"{FULL} SELECT nation, max(value) AS hi, min(value) AS lo, max(value) - min(value) AS span FROM dense GROUP BY nation")
def a2_extremes(spark, d):
    t = qty(spark, d)
    lo, hi = R.minmax(t, "month")
    out = lo.df.withColumnRenamed("value", "lo").join(hi.df.withColumnRenamed("value", "hi"), "nation")
    return out.join(R.reduce(t, "ptp", "month").df.withColumnRenamed("value", "span"), "nation").select("nation", "hi", "lo", "span")


@query(f"WITH {EMB} SELECT vec, round(product(1 + value), 6) AS value FROM emb GROUP BY vec")
def a3_prod(spark, d):
    return rounded(R.reduce(emb(spark, d).map(lambda v: v + 1), "prod", "k"))


@query(f"{FULL} SELECT nation, round(stddev_pop(value), 6) AS std, round(var_samp(value), 4) AS var1 FROM dense GROUP BY nation")
def a4_spread(spark, d):
    t = qty(spark, d)
    a, b = R.reduce(t, "std", "month"), R.reduce(t, "var", "month", ddof=1)
    return a.df.select("nation", F.round("value", 6).alias("std")).join(b.df.select("nation", F.round("value", 4).alias("var1")), "nation")


@query(f"{FULL} SELECT month, bool_and(value > 0) AS \"all\", bool_or(value > 1000) AS \"any\" FROM dense GROUP BY month")
def a5_all_any(spark, d):
    t = qty(spark, d).dense()
    x, y = R.reduce(B.binary(t, 0, "greater"), "all", "nation"), R.reduce(B.binary(t, 1000, "greater"), "any", "nation")
    return x.df.withColumnRenamed("value", "all").join(y.df.withColumnRenamed("value", "any"), "month")


@query(f"{FULL} SELECT nation, arg_max(month, (value, -month)) AS hi, arg_min(month, (value, month)) AS lo FROM dense GROUP BY nation")
def a6_arg(spark, d):
    t = qty(spark, d)
    return R.arg(t, "max", "month").df.withColumnRenamed("value", "hi").join(R.arg(t, "min", "month").df.withColumnRenamed("value", "lo"), "nation")


@query(f"{FULL} SELECT nation, median(value) AS value FROM dense GROUP BY nation")
def a7_median(spark, d):
    return R.reduce(qty(spark, d), "median", "month").df


@query(" UNION ALL ".join(f"SELECT {i}::BIGINT AS q, p_brand AS brand, round(quantile_cont(p_retailprice, {q}), 4) AS value FROM part GROUP BY p_brand" for i, q in enumerate((0.1, 0.5, 0.95))))
def a8_quantiles_per_brand(spark, d):
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("part")).agg(F.max("p_retailprice").alias("value"))
    return rounded(R.quantile(Tensor(p, ("brand", "part"), (None, None), None), [0.1, 0.5, 0.95], "part"), 4)


@query(f"{FULL}, r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY value, month) AS r, count(*) OVER (PARTITION BY nation) AS c FROM dense) SELECT nation, max(value) FILTER (r = (c + 1) // 2) AS lower_median, max(value) FILTER (r = 3) AS third FROM r GROUP BY nation")
def a9_order_statistics(spark, d):
    t = qty(spark, d)
    return R.lower_median(t, "month")[0].df.withColumnRenamed("value", "lower_median").join(R.kth_value(t, 3, "month")[0].df.withColumnRenamed("value", "third"), "nation")


@query(f"WITH {ACT}, a AS (SELECT hour, value, count(*) AS n FROM act GROUP BY ALL) SELECT hour, arg_max(value, (n, -value)) AS value FROM a GROUP BY hour")
def a9_mode(spark, d):
    t = act(spark, d)
    return R.mode(Tensor(t.df, t.dims, t.sizes, None), "user")[0].df


@query(f"WITH {EMB} SELECT vec, round(sum(abs(value)), 6) AS l1, round(sqrt(sum(value * value)), 6) AS l2, max(abs(value)) AS linf FROM emb GROUP BY vec")
def a10_norms(spark, d):
    t = emb(spark, d)
    one, two, top = (R.norm(t, o, "k").df for o in (1, 2, float("inf")))
    return one.select("vec", F.round("value", 6).alias("l1")).join(two.select("vec", F.round("value", 6).alias("l2")), "vec").join(top.select("vec", F.col("value").alias("linf")), "vec")


@query(f"WITH {EMB} SELECT vec, round(max(value) + ln(sum(exp(value - top))), 6) AS value FROM (SELECT *, max(value) OVER (PARTITION BY vec) AS top FROM emb) GROUP BY vec")
def a11_logsumexp(spark, d):
    return rounded(R.logsumexp(emb(spark, d), "k"))


@query(f"WITH {QTY} SELECT nation, count(*) FILTER (value <> 0) AS value FROM qty GROUP BY nation")
def a12_count_nonzero(spark, d):
    return R.reduce(qty(spark, d), "count_nonzero", "month").df


@query(f"WITH {PART} SELECT row_number() OVER (ORDER BY size) - 1 AS i, size AS value FROM (SELECT DISTINCT size FROM pr)")
def a13_unique(spark, d):
    s = size(spark, d)
    return R.unique(Tensor(s.df, s.dims, s.sizes, None)).df


@query(f"WITH {PART}, c AS (SELECT size::BIGINT AS i, count(*) AS n FROM pr GROUP BY ALL), t AS (SELECT max(i) AS last FROM c) SELECT g.i::BIGINT AS i, coalesce(n, 0)::DOUBLE AS value FROM (SELECT unnest(range(last + 1)) AS i FROM t) g LEFT JOIN c USING (i)")
def a14_bincount(spark, d):
    s = size(spark, d)
    return R.bincount(Tensor(s.df, s.dims, s.sizes, None)).df


@query("SELECT b::BIGINT AS bin, count(l_quantity) FILTER (least(floor(l_quantity / 6), 9) = b)::DOUBLE AS value FROM lineitem, range(10) r(b) WHERE l_quantity BETWEEN 0 AND 60 GROUP BY b")
def a15_histogram(spark, d):
    lines = table(spark, d, "lineitem").select(F.monotonically_increasing_id().alias("row"), F.col("l_quantity").alias("value"))
    return R.histogram(Tensor(lines, ("row",), (None,), None), 10, 0, 60)[0].df


@query(f"WITH {QTY} SELECT nation, month, sum(value) AS value, (grouping(nation) * 2 + grouping(month))::BIGINT AS level FROM qty GROUP BY GROUPING SETS ((nation), (month), ())")
def a16_subtotals(spark, d):
    return R.subtotals(qty(spark, d), ["nation"], ["month"], []).select("nation", "month", "value", "level")


@query("SELECT count(DISTINCT user_id) AS users, true AS near FROM events")
def a17_approximate_size(spark, d):
    """The exact number, and whether the estimate lies within four times its stated error."""
    e = table(spark, d, "events")
    exact = e.agg(F.count_distinct("user_id").alias("users"))
    return exact.join(R.approximate_size(e, "user_id", 0.02)).select("users", (F.abs(F.col("size") - F.col("users")) <= F.greatest(F.lit(0.08) * F.col("users"), F.lit(1))).alias("near"))


@query(f"WITH {QTY} SELECT sum(value)::DOUBLE AS value FROM qty")
def a18_item(spark, d):
    total = R.item(R.reduce(qty(spark, d), "sum"))
    return spark.range(1).select(F.lit(total).cast("double").alias("value"))


@query(f"{MONTH} SELECT month, sum(value) OVER (ORDER BY month) AS value FROM m")
def w1_cumsum_months(spark, d):
    return W.cumsum(by_month(spark, d)).df


@query(f"{FULL} SELECT nation, month, sum(value) OVER (PARTITION BY nation ORDER BY month) AS value FROM dense")
def w1_cumsum_nations(spark, d):
    return W.cumsum(qty(spark, d), "month").df


@query(f"{FULL} SELECT nation, month, max(value) OVER (PARTITION BY nation ORDER BY month) AS value FROM dense")
def w2_running_max(spark, d):
    return W.running(qty(spark, d), "month", "max").df


@query(f"{MONTH} SELECT row_number() OVER (ORDER BY value, month) - 1 AS month, value, month AS at FROM m")
def w3_sort_argsort(spark, d):
    values, at = W.sort_with_positions(by_month(spark, d))
    return values.df.join(at.df.withColumnRenamed("value", "at"), "month")


@query(f"{MONTH} SELECT o::BIGINT AS month, sum(value) AS value FROM n, range(200) r(o) JOIN m ON month BETWEEN o * 2 AND o * 2 + 4 WHERE o <= (n - 5) // 2 GROUP BY o")
def w4_reduce_window(spark, d):
    return W.reduce_window(by_month(spark, d), {"month": 5}, {"month": 2}, "VALID", "sum").df


@query(f"WITH {EMB} SELECT vec, k // 4 AS k, max(value) AS value FROM emb GROUP BY ALL")
def w5_max_pool(spark, d):
    return W.pool(emb(spark, d), 4, spatial=1).df


@query(f"{MONTH} SELECT b::BIGINT AS month, round(avg(value), 6) AS value FROM n, range(7) r(b) JOIN m ON month >= (b * n) // 7 AND month < ceil((b + 1) * n / 7.0) GROUP BY b")
def w6_adaptive_pool(spark, d):
    return rounded(W.adaptive_pool(by_month(spark, d), {"month": 7}))


@query(f"{MONTH} SELECT o::BIGINT AS month, month - o * 3 AS \"window\", value FROM n, range(200) r(o) JOIN m ON month BETWEEN o * 3 AND o * 3 + 5 WHERE o <= (n - 6) // 3")
def w7_unfold(spark, d):
    return W.unfold(by_month(spark, d), "month", 6, 3).df


@query(f"WITH {EMB}, x AS (SELECT vec, k // 8 AS h, k % 8 AS w, value FROM emb) SELECT vec, i * 2 + j AS patch, (h - i) // 2 * 4 + (w - j) // 2 AS place, value FROM x, range(2) a(i), range(2) b(j) WHERE h % 2 = i AND w % 2 = j")
def w8_im2col(spark, d):
    t = S.unflatten(emb(spark, d), "k", {"c": 1, "h": 8, "w": 8})
    return W.im2col(t, (2, 2), 2).df


@query(f"WITH {EMB} SELECT vec, 0::BIGINT AS channel, k // 8 AS \"row\", k % 8 AS \"column\", value FROM emb")
def w8_col2im(spark, d):
    t = S.unflatten(emb(spark, d), "k", {"c": 1, "h": 8, "w": 8})
    return W.col2im(W.im2col(t, (2, 2), 2), (8, 8), (2, 2), 2).df


@query(f"WITH {EMB} SELECT vec, o::BIGINT AS c, (k - j + 1)::BIGINT AS k, round(sum(value * (j * 2 - 1 + o)), 6) + 0.0 AS value FROM emb, range(3) a(j), range(2) b(o) WHERE k - j + 1 BETWEEN 0 AND 63 GROUP BY ALL")
def w9_convolution(spark, d):
    kernel = build.array_literal(spark, [[[-1, 1, 3]], [[0, 2, 4]]], ["o", "c", "j"])
    t = emb(spark, d)
    x = S.expand_dims(t, 1, "c")
    return rounded(W.convolve(x, kernel, padding=1))


@query(f"WITH {EMB} SELECT vec, 0::BIGINT AS c, k * 2 + j AS k, round(sum(value * (j + 1)), 6) + 0.0 AS value FROM emb, range(3) a(j) GROUP BY ALL")
def w10_transposed_convolution(spark, d):
    kernel = build.array_literal(spark, [[[1, 2, 3]]], ["c", "o", "j"])
    return rounded(W.convolve_transposed(S.expand_dims(emb(spark, d), 1, "c"), kernel, stride=2))


@query(f"{FULL} SELECT nation, month, dense_rank() OVER (PARTITION BY nation ORDER BY value DESC) AS rank, value - lag(value) OVER (PARTITION BY nation ORDER BY month) AS change FROM dense")
def w11_ranks_and_changes(spark, d):
    t = qty(spark, d)
    r, c = W.ranks(t, "month", "dense_rank", True), W.ranks(t, "month", "lag")
    return r.df.select("nation", "month", F.col("value").cast("long").alias("rank")).join(c.df.withColumnRenamed("value", "change"), ["nation", "month"])


@query(f"WITH {DAILY}, t AS (SELECT max(day) AS last FROM daily), g AS (SELECT unnest(range(last + 1)) AS day FROM t), x AS (SELECT day, coalesce(value, 0) AS v FROM g LEFT JOIN daily USING (day)), y AS (SELECT a.v AS v, b.v AS w FROM x a JOIN x b ON b.day = a.day + 7) SELECT round(avg((v - w) * (v - w)), 6) AS mse, round(avg(abs(v - w)), 6) AS l1, round(avg(CASE WHEN abs(v - w) <= 1 THEN 0.5 * (v - w) * (v - w) ELSE abs(v - w) - 0.5 END), 6) AS huber FROM y")
def m1_forecast_losses(spark, d):
    t = daily(spark, d).dense()
    n = t.length("day")
    x = Tensor(t.df.filter(F.col("day") < n - 7), ("day",), (n - 7,), None)
    y = Tensor(t.df.filter(F.col("day") >= 7).withColumn("day", F.col("day") - 7), ("day",), (n - 7,), None)
    out = None
    for name in ("mse", "l1", "huber"):
        one = L.loss(name, x, y).df.select(F.round("value", 6).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


LABELS = "p AS (SELECT doc_id, quality, 1 / (1 + exp(-(n_chars / 2000.0 - 1))) AS p, n_chars / 2000.0 - 1 AS x FROM labels JOIN documents USING (doc_id))"


def length_scores(spark, d) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").withColumn("x", F.col("n_chars") / 2000 - 1)


@query(f"WITH {LABELS} SELECT round(avg(greatest(x, 0) + ln(1 + exp(-abs(x))) - x * quality), 6) AS value FROM p")
def m2_log_loss_of_length(spark, d):
    s = length_scores(spark, d)
    x = tensor_from_table(s, {"doc": F.col("doc_id")}, "x", "max", fill=None)
    y = tensor_from_table(s, {"doc": F.col("doc_id")}, F.col("quality").cast("double"), "max", fill=None)
    return rounded(L.loss("bce_with_logits", x, y))


@query(f"WITH {EMB}, l AS (SELECT vec_id AS vec, label FROM embeddings), e AS (SELECT vec, max(value) FILTER (k = label) AS z, max(value) AS top, list(value) AS vs FROM emb JOIN l USING (vec) WHERE k < 10 GROUP BY vec) SELECT round(avg(top + ln(list_sum(list_transform(vs, lambda v: exp(v - top)))) - z), 6) AS value FROM e")
def m3_cross_entropy(spark, d):
    x = I.slice_dim(emb(spark, d), "k", 0, 10)
    y = tensor_from_table(table(spark, d, "embeddings"), {"vec": F.col("vec_id")}, "label", "max", fill=None)
    return rounded(L.cross_entropy(x, y))


def number_rows(spark, rows, columns: str) -> DataFrame:
    return spark.createDataFrame(rows, columns)


@query(f"WITH {EMB}, s AS (SELECT k, var_samp(value) AS v FROM emb GROUP BY k) SELECT (SELECT count(*) FROM embeddings) AS vectors, round(sum(v), 6) AS variance, true AS uncorrelated, true AS largest, true AS shares FROM s")
def l1_pca_scores(spark, d):
    """Scores are uncorrelated, the first has at least the largest variance of a component, and the shares are theirs."""
    rows = table(spark, d, "embeddings")
    scored, _, shares = A.pca(rows, "embedding", 4)
    of_scores, of_values = A.covariance(scored, "scores"), A.covariance(rows, "embedding")
    total, spread = of_values.trace(), of_scores.diagonal()
    found = (scored.count(), round(float(total), 6), bool(abs(of_scores - np.diag(spread)).max() < 1e-9 * total), bool(spread[0] >= of_values.diagonal().max() - 1e-12), bool(abs(spread / total - shares).max() < 1e-9))
    return number_rows(spark, [found], "vectors long, variance double, uncorrelated boolean, largest boolean, shares boolean")


@query(f"WITH {EMB} SELECT a.k AS i, b.k AS j, round(sum(a.value * b.value), 4) + 0.0 AS value FROM emb a JOIN emb b USING (vec) GROUP BY ALL")
def l3_gram_of_embeddings(spark, d):
    g = A.gram(table(spark, d, "embeddings"), "embedding")
    n = len(g)
    return number_rows(spark, [(i, j, round(float(g[i, j]), 4) + 0.0) for i in range(n) for j in range(n)], "i long, j long, value double")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def l4_least_squares(spark, d):
    rows = table(spark, d, "lineitem").select(F.array(F.lit(1.0), "l_quantity").alias("x"), "l_extendedprice")
    b, a = A.lstsq(rows, "x", "l_extendedprice")
    return number_rows(spark, [(round(float(a), 4), round(float(b), 2))], "slope double, intercept double")


@query("SELECT (1 + (var_pop(l_quantity) > 0)::INT + (var_pop(l_discount) > 0 AND corr(l_quantity, l_discount) ** 2 < 1 - 1e-9)::INT)::BIGINT AS rank FROM lineitem")
def l5_matrix_rank(spark, d):
    x = F.array(F.lit(1.0), F.col("l_quantity"), F.col("l_discount"), F.col("l_quantity") * 2 + 1)
    return number_rows(spark, [(A.matrix_rank(table(spark, d, "lineitem").select(x.alias("x")), "x"),)], "rank long")


@query(f"WITH {EMB} SELECT a.k AS i, b.k AS j, CASE WHEN a.k = b.k THEN 1.0 ELSE 0.0 END::DOUBLE AS unit, round(sum(a.value * b.value), 4) + 0.0 AS gram, a.k > b.k AS below FROM emb a JOIN emb b USING (vec) GROUP BY a.k, b.k")
def l2_tall_skinny_qr(spark, d):
    """Q'Q, R'R and which cells of R are zero."""
    rows, r = A.qr(table(spark, d, "embeddings"), "embedding")
    unit, whole = A.gram(rows, "q"), r.T @ r
    cells = [(i, j, round(float(unit[i, j]), 6) + 0.0, round(float(whole[i, j]), 4) + 0.0, bool(i > j and r[i, j] == 0)) for i in range(len(r)) for j in range(len(r))]
    return number_rows(spark, cells, "i long, j long, unit double, gram double, below boolean")


@query(f"WITH {ACT} SELECT \"user\", sum(value) AS value FROM act GROUP BY ALL")
def a1_events_of_users(spark, d):
    return plain(R.reduce(act(spark, d), "sum", "hour"))
