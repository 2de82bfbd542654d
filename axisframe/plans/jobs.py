"""Queries on user functions, audits, lookups, change processing and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit as Q
from ..operators import change as D
from ..operators import hof as H
from ..operators import lookup as K
from ..operators import reduce as R
from ..sources.scratch import scratch_folder
from ..streaming import streams as T
from .common import ACT, QTY, act, qty, query, table


def events(spark, d) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"WITH {ACT} SELECT \"user\", sum(value) AS total, max(value) AS top FROM act GROUP BY ALL")
def f1_vmap_users(spark, d):
    f = lambda pdf: pdf.agg({"value": ["sum", "max"]}).T.set_axis(["total", "top"], axis=1)
    return H.vmap(f, act(spark, d), "user", "total double, top double").select("user", "total", "top")


EVENTS = "e AS (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)"
EMA = f"""WITH RECURSIVE {EVENTS}, f AS (SELECT user_id, r, value AS ema FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.r, f.ema * 0.75 + e.value * 0.25 FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)"""


@query(f"{EMA} SELECT user_id, round(arg_max(ema, r), 6) AS ema FROM f GROUP BY user_id")
def f2_ema_scan(spark, d):
    out = H.ema(events(spark, d), ["user_id"], ["ts", "event_id"], "value", 0.25)
    return out.select("user_id", F.round("ema", 6).alias("ema"))


@query(f"WITH {EVENTS} SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS carry FROM e")
def f2_scan_all(spark, d):
    out = H.scan_all(events(spark, d), ["user_id"], ["ts", "event_id"], "value", 0.0, lambda c, v: c + v)
    return out.select("user_id", "event_id", F.round("carry", 6).alias("carry"))


@query("WITH RECURSIVE c AS (SELECT o_custkey AS k, count(*) AS n, 0 AS steps FROM orders GROUP BY ALL UNION ALL SELECT k, CASE WHEN n % 2 = 0 THEN n // 2 ELSE 3 * n + 1 END, steps + 1 FROM c WHERE n > 1) SELECT k, max(steps)::BIGINT AS steps FROM c GROUP BY k")
def f3_while_loop(spark, d):
    start = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")).withColumn("steps", F.lit(0).cast("long"))
    go = F.col("n") > 1
    step = lambda df: df.select("k", F.when(~go, F.col("n")).when(F.col("n") % 2 == 0, F.floor(F.col("n") / 2)).otherwise(3 * F.col("n") + 1).alias("n"), F.when(go, F.col("steps") + 1).otherwise(F.col("steps")).alias("steps"))
    twice = lambda df: step(step(step(step(df))))  # noqa: E731  four steps to each written table
    return H.while_loop(start, twice, lambda _, after: not after.filter(go).isEmpty()).select("k", "steps")


@query("SELECT event_id, CASE least(greatest(user_id % 4, 0), 2) WHEN 0 THEN value WHEN 1 THEN -value ELSE value * 2 END AS x, CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM events")
def f4_cond_switch(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", H.switch(F.col("user_id") % 4, v, -v, v * 2).alias("x"), H.cond(v > 50, F.lit(1.0), F.lit(0.0)).alias("y"))


@query(f"WITH {QTY} SELECT nation, max(value) - sum(value) AS value FROM (SELECT nation, month // 12 AS y, sum(value) AS value FROM qty GROUP BY ALL) GROUP BY nation")
def f7_sequential(spark, d):
    year = lambda t: t.with_df(t.df.withColumn("month", F.floor(F.col("month") / 12)).groupBy("nation", "month").agg(F.sum("value").alias("value")), fill=None)
    top = lambda t: R.reduced(t, F.max("value") - F.sum("value"), "month")
    return H.sequential(qty(spark, d), year, top).df


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 6) AS power FROM embeddings")
def f8_vector_udf(spark, d):
    power = H.vector_udf(lambda s: s.map(lambda v: float((v.astype(float) ** 2).sum())))
    return table(spark, d, "embeddings").select("vec_id", F.round(power("embedding"), 6).alias("power"))


@query("SELECT event_type, round(max(value) - min(value), 6) AS span FROM events GROUP BY event_type")
def f9_reducer_udf(spark, d):
    span = H.reducer_udf(lambda s: float(s.max() - s.min()))
    return table(spark, d, "events").groupBy("event_type").agg(F.round(span("value"), 6).alias("span"))


class Words:
    """A row for each word of a name."""

    def eval(self, name: str):
        for i, w in enumerate((name or "").split()):
            yield i, w


@query("SELECT p_partkey, (unnest(range(len(string_split(p_name, ' ')))))::INT AS i, unnest(string_split(p_name, ' ')) AS word FROM part")
def f10_fan_out(spark, d):
    return H.fan_out(table(spark, d, "part"), Words, "i int, word string", "p_name").select("p_partkey", "i", "word")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def c1_settings(spark, d):
    return table(spark, d, "events").select("event_id", Q.setting("props", "$.k", "$.key").cast("long").alias("k"))


@query("SELECT p_partkey, list_filter(string_split_regex(trim(p_name), '[\\s,]+'), lambda x: x <> '') AS dims, len(list_filter(string_split_regex(trim(p_name), '[\\s,]+'), lambda x: x <> ''))::INT AS n FROM part")
def c2_split_names(spark, d):
    dims = Q.parse_dims(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", dims.alias("dims"), F.size(dims).alias("n"))


@query("SELECT vec_id, len(embedding)::INT AS last, len(embedding) * 2::BIGINT AS elements FROM embeddings")
def c3_c4_sizes(spark, d):
    sizes = F.array(F.size("embedding"), F.lit(2))
    return table(spark, d, "embeddings").select("vec_id", Q.size_at(sizes, -2).alias("last"), Q.product_of(sizes).alias("elements"))


@query("""SELECT 'embedding' AS source, vec_id::VARCHAR AS row_key, 'contract' AS rule, 'mismatch' AS kind, 'size is not 64: ' || len(embedding) AS message, 0 AS axis
FROM (SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN embedding[1:vec_id % 64] ELSE embedding END AS embedding FROM embeddings) WHERE len(embedding) <> 64""")
def q1_check_contract(spark, d):
    e = table(spark, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", F.lit(1), (F.col("vec_id") % 64).cast("int"))).otherwise(F.col("embedding")))
    return Q.check_contract(e, "vec_id", "embedding", "k=64")


@query("""SELECT name, min(size)::INT AS least, max(size)::INT AS most, count(DISTINCT size) AS sizes, count(DISTINCT size) FILTER (size <> 1) <= 1 AS one_size FROM (SELECT 'width' AS name, len(embedding) AS size FROM embeddings UNION ALL
SELECT 'words', len(string_split(p_name, ' ')) FROM part UNION ALL SELECT 'width', CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 64 END FROM nation) GROUP BY name""")
def q2_bind_dims(spark, d):
    a = Q.observed_sizes(table(spark, d, "embeddings"), "embedding", ["width"])
    b = Q.observed_sizes(table(spark, d, "part").withColumn("w", F.split("p_name", " ")), "w", ["words"])
    c = table(spark, d, "nation").select(F.lit("width").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, 1).otherwise(64).alias("size"))  # stretched in half of the rows
    return Q.bind_dims(a.unionByName(b).unionByName(c))


def ops(spark, d) -> DataFrame:
    """An operation log made of order lines: shapes from their numbers."""
    n = lambda c, m: (F.col(c) % m + 1).cast("int")
    left, right = F.array(n("l_partkey", 3), n("l_suppkey", 2), n("l_linenumber", 4)), F.array(n("l_orderkey", 2), n("l_linenumber", 4))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", left.alias("left_shape"), right.alias("right_shape"))


OPS = """ops AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 3 + 1)::INT AS a0, (l_suppkey % 2 + 1)::INT AS a1, (l_linenumber % 4 + 1)::INT AS a2, (l_orderkey % 2 + 1)::INT AS b1, (l_linenumber % 4 + 1)::INT AS b2 FROM lineitem)"""


@query(f"WITH {OPS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN a1 <> b1 AND a1 <> 1 AND b1 <> 1 THEN NULL ELSE [a0, greatest(a1, b1), a2] END AS result FROM ops")
def q3_broadcast_audit(spark, d):
    return Q.broadcast_audit(ops(spark, d)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "result")


@query(f"WITH {OPS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, a2 <> b1 AS conflict FROM ops")
def q4_contraction_audit(spark, d):
    return Q.contraction_audit(ops(spark, d)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "conflict")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey % 4 AS k, (l_partkey % 3 + 1)::INT AS a0, (l_suppkey % 2 + 1)::INT AS a1, (l_linenumber % 4 + 1)::INT AS a2, (l_orderkey // 4 % 3 + 1)::INT AS b0, (l_suppkey % 4 + 1)::INT AS b1, (l_partkey % 2 + 1)::INT AS b2 FROM lineitem),
c AS (SELECT *, CASE k WHEN 0 THEN (a0 <> b0 AND a0 <> 1 AND b0 <> 1) OR a2 <> b1 WHEN 3 THEN true ELSE a2 <> b1 END AS conflict FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, conflict, CASE WHEN conflict THEN NULL WHEN k = 0 THEN [greatest(a0, b0), a1, b2] WHEN k = 1 THEN [a0, a1] ELSE [b0, b2] END AS result FROM c""")
def q4_products_of_any_ranks(spark, d):
    """Batch sizes that broadcast, vectors on either side, and scalars."""
    n = lambda c, m: (c % m + 1).cast("int")
    k, left, right = F.col("l_orderkey") % 4, F.array(n(F.col("l_partkey"), 3), n(F.col("l_suppkey"), 2), n(F.col("l_linenumber"), 4)), F.array(n(F.floor(F.col("l_orderkey") / 4), 3), n(F.col("l_suppkey"), 4), n(F.col("l_partkey"), 2))
    shaped = table(spark, d, "lineitem").withColumn("left_shape", F.when(k == 2, F.slice(left, 3, 1)).when(k == 3, F.slice(left, 1, 0)).otherwise(left)).withColumn("right_shape", F.when(k == 1, F.slice(right, 2, 1)).when(k == 3, F.slice(right, 2, 1)).otherwise(right))
    return Q.contraction_audit(shaped).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "conflict", "result")


@query(f"WITH {OPS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, a0 * a1 * a2 % b2 <> 0 AS conflict FROM ops")
def q5_reshape_audit(spark, d):
    new = ops(spark, d).withColumn("new_shape", F.array(F.col("right_shape")[1], F.lit(-1)))
    return Q.reshape_audit(new, "left_shape").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "conflict")


@query(f"WITH {OPS} SELECT l_orderkey AS op_id, count(DISTINCT a0) > 1 OR count(DISTINCT a1) > 1 AS conflict FROM ops GROUP BY l_orderkey")
def q5_concat_audit(spark, d):
    operands = ops(spark, d).select(F.col("l_orderkey").alias("op_id"), F.col("left_shape").alias("shape"), F.lit(2).alias("axis"))
    return Q.concat_audit(operands)


@query("""WITH o AS (SELECT l_orderkey AS op_id, l_orderkey % 4 AS k, (l_partkey % 3 + 1)::INT AS a, (l_suppkey % 2 + 1)::INT AS b, l_linenumber AS n, count(*) OVER (PARTITION BY l_orderkey) AS rows FROM lineitem)
SELECT op_id, CASE k WHEN 0 THEN count(DISTINCT a) > 1 WHEN 1 THEN count(DISTINCT b) > 1 WHEN 2 THEN true ELSE NOT bool_or(n % 2 = 0) AND count(DISTINCT a) > 1 END AS conflict FROM o GROUP BY op_id, k""")
def q5_concat_of_any_axes(spark, d):
    """By order: the last axis as -1, the last but one as -2, an axis beyond the rank, and empty vectors among other ranks."""
    k, n = F.col("l_orderkey") % 4, lambda c, m: (F.col(c) % m + 1).cast("int")
    shape = F.array(n("l_partkey", 3), n("l_suppkey", 2))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("op_id"), F.when((k == 3) & (F.col("l_linenumber") % 2 == 0), F.array(F.lit(0))).otherwise(shape).alias("shape"), F.when(k == 1, -2).when(k == 2, -3).otherwise(-1).alias("axis"))
    return Q.concat_audit(rows)


FINDINGS = "f AS (SELECT c_mktsegment AS source, c_custkey AS row_key, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE (c_custkey % 7)::INT END AS measured, CASE WHEN c_custkey % 3 = 0 THEN 'n' ELSE (c_custkey % 2)::VARCHAR END AS declared FROM customer), g AS (SELECT *, CASE WHEN TRY_CAST(declared AS INT) IS NOT NULL AND measured IS NOT NULL AND declared::INT <> measured THEN 'mismatch' WHEN TRY_CAST(declared AS INT) IS NULL OR measured IS NULL THEN 'approximation' END AS kind FROM f)"


def graded(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    measured = F.when(F.col("c_nationkey") % 5 != 0, (F.col("c_custkey") % 7).cast("int"))
    declared = F.when(F.col("c_custkey") % 3 == 0, "n").otherwise((F.col("c_custkey") % 2).cast("string"))
    df = c.select(F.col("c_mktsegment").alias("source"), F.col("c_custkey").alias("row_key"), measured.alias("measured"), declared.alias("declared"))
    return Q.grade(df, "declared", "measured")


@query(f"WITH {FINDINGS} SELECT row_key, kind FROM g")
def q6_grade(spark, d):
    return graded(spark, d).select("row_key", "kind")


@query(f"WITH {FINDINGS} SELECT count(DISTINCT source) AS sources, count(*) FILTER (kind = 'mismatch') AS errors, count(*) FILTER (kind = 'approximation') AS warnings, CASE WHEN count(*) FILTER (kind = 'mismatch') > 0 THEN 1 ELSE 0 END AS exit_code FROM g")
def q7_summary(spark, d):
    return Q.summary(graded(spark, d))


@query(f"WITH {FINDINGS} SELECT source, kind, min(row_key) AS row_key FROM g GROUP BY ALL")
def q8_dedupe(spark, d):
    return Q.dedupe(graded(spark, d).select("source", "kind", "row_key"), ["source", "kind"], ["row_key"])


@query(f"WITH {FINDINGS} SELECT source, count(*) AS rows, count(measured) AS known, round(count(measured) / count(*), 6) AS share FROM g GROUP BY source")
def q9_coverage(spark, d):
    return Q.coverage(graded(spark, d), F.col("measured").isNotNull(), "source").withColumn("share", F.round("share", 6))


@query("SELECT [len(string_split(text, ' '))::INT] AS sizes, count(*) AS rows FROM conversations GROUP BY ALL")
def q10_shape_profile(spark, d):
    return Q.shape_profile(table(spark, d, "conversations").withColumn("w", F.split("text", " ")), "w")


@query(f"WITH {FINDINGS} SELECT row_key, TRY_CAST(declared AS INT) AS predicted, measured, coalesce(TRY_CAST(declared AS INT) IS NULL OR TRY_CAST(declared AS INT) = measured, false) AS passes FROM g")
def q11_oracle_compare(spark, d):
    g = graded(spark, d)
    predicted = g.select("row_key", F.expr("try_cast(declared AS int)").alias("size"))
    return Q.oracle_compare(predicted, g.select("row_key", F.col("measured").alias("size")), ["row_key"], "size")


@query("SELECT 'w' AS \"column\", count(*) AS rows, count(*) FILTER (len(string_split(text, ' ')) > 40) AS over, max(len(string_split(text, ' ')))::INT AS largest FROM conversations")
def q12_oversize(spark, d):
    return Q.oversize(table(spark, d, "conversations").withColumn("w", F.split("text", " ")), ["w"], 40)


BUY = "b AS (SELECT user_id, ts, max(value) AS price FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY ALL)"


@query(f"WITH {BUY} SELECT e.event_id, e.user_id, b.price FROM events e ASOF LEFT JOIN b ON e.user_id = b.user_id AND e.ts >= b.ts")
def d1_asof_lookup(spark, d):
    e = events(spark, d)
    first = e.agg(F.min("event_type").alias("t"))
    bought = e.join(F.broadcast(first), F.col("event_type") == F.col("t")).select("user_id", "ts", F.col("value").alias("price"))
    return K.asof_lookup(e.select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", "price").select("event_id", "user_id", "price")


SCOPES = "s AS (SELECT o_orderkey AS scope_id, (o_custkey % 10)::BIGINT AS k, datediff('day', DATE '1995-01-01', o_orderdate::DATE) AS start, datediff('day', DATE '1995-01-01', o_orderdate::DATE) + 1 + o_orderkey % 400 AS \"end\" FROM orders), p AS (SELECT c_custkey, c_custkey % 10 AS k, (c_custkey * 37) % 2500 AS place FROM customer)"


@query(f"WITH {SCOPES}, h AS (SELECT c_custkey, scope_id, row_number() OVER (PARTITION BY c_custkey ORDER BY \"end\" - start, start DESC, scope_id) AS r FROM p JOIN s USING (k) WHERE start <= place AND place < \"end\") SELECT p.c_custkey, h.scope_id FROM p LEFT JOIN h ON h.c_custkey = p.c_custkey AND h.r = 1")
def d2_innermost_interval(spark, d):
    day = F.datediff("o_orderdate", F.lit("1995-01-01")).cast("long")
    scopes = table(spark, d, "orders").select(F.col("o_orderkey").alias("scope_id"), (F.col("o_custkey") % 10).alias("k"), day.alias("start"), (day + 1 + F.col("o_orderkey") % 400).alias("end"))
    points = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 10).alias("k"), ((F.col("c_custkey") * 37) % 2500).alias("at"))
    return K.innermost_interval(points, scopes, ["k"], "at", ["c_custkey"]).select("c_custkey", "scope_id")


@query("SELECT l_orderkey, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) END AS l_returnflag FROM lineitem GROUP BY l_orderkey")
def d3_reconcile_paths(spark, d):
    return K.reconcile_paths(table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag")


def sites(spark, d):
    s = table(spark, d, "events").select("event_id", (F.col("user_id") % 20).alias("scope_id"), F.col("event_type").alias("name"))
    wanted = s.select("scope_id", "name").distinct()
    plans = wanted.select("scope_id", "name", F.when(F.col("scope_id") % 2 == 0, F.concat(F.col("name"), F.lit("_2"))).otherwise(F.lit("click")).alias("new_name"))
    return s, plans


@query("""WITH s AS (SELECT event_id, user_id % 20 AS scope_id, event_type AS name FROM events), u AS (SELECT DISTINCT scope_id, name FROM s),
r AS (SELECT scope_id, name, CASE WHEN scope_id % 2 = 0 THEN name || '_2' ELSE 'click' END AS new_name FROM u), ok AS (SELECT r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.scope_id = r.scope_id AND u.name = r.new_name))
SELECT event_id, s.scope_id, coalesce(new_name, s.name) AS name FROM s LEFT JOIN ok ON ok.scope_id = s.scope_id AND ok.name = s.name""")
def d4_rename(spark, d):
    s, plans = sites(spark, d)
    return K.rename(s, plans)


@query("""WITH RECURSIVE s AS (SELECT event_id, user_id % 20 AS scope_id, event_type AS name FROM events), u AS (SELECT DISTINCT scope_id, name FROM s),
r AS (SELECT scope_id, name, CASE WHEN name = 'click' THEN CASE scope_id % 4 WHEN 0 THEN 'view' WHEN 3 THEN 'x' ELSE 'error' END WHEN name = 'view' THEN CASE scope_id % 4 WHEN 0 THEN 'click' WHEN 3 THEN 'x' END WHEN name = 'error' THEN CASE scope_id % 4 WHEN 1 THEN 'error_2' WHEN 2 THEN 'purchase' END END AS new_name FROM u),
a AS (SELECT * FROM r WHERE new_name IS NOT NULL), t AS (SELECT scope_id, new_name FROM a GROUP BY ALL HAVING count(*) > 1),
bad AS (SELECT scope_id, name FROM a WHERE EXISTS (SELECT 1 FROM t WHERE t.scope_id = a.scope_id AND t.new_name = a.new_name) OR (EXISTS (SELECT 1 FROM u WHERE u.scope_id = a.scope_id AND u.name = a.new_name) AND NOT EXISTS (SELECT 1 FROM a b WHERE b.scope_id = a.scope_id AND b.name = a.new_name))
  UNION SELECT a.scope_id, a.name FROM a JOIN bad ON bad.scope_id = a.scope_id AND bad.name = a.new_name)
SELECT event_id, s.scope_id, coalesce(a.new_name, s.name) AS name FROM s LEFT JOIN (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.scope_id = a.scope_id AND bad.name = a.name)) a ON a.scope_id = s.scope_id AND a.name = s.name""")
def d4_renames_together(spark, d):
    """By scope: two names change places, a chain that ends in a free name, one that ends in a name in use, and twins."""
    s, _ = sites(spark, d)
    k, is_ = F.col("scope_id") % 4, lambda n: F.col("name") == n
    new = F.when(is_("click"), F.when(k == 0, "view").when(k == 3, "x").otherwise("error")).when(is_("view"), F.when(k == 0, "click").when(k == 3, "x")).when(is_("error"), F.when(k == 1, "error_2").when(k == 2, "purchase"))
    plans = s.select("scope_id", "name").distinct().withColumn("new_name", new).filter("new_name IS NOT NULL")
    return K.rename(s, plans)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM lineitem), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
cc(node, g) USING KEY (node) AS (SELECT DISTINCT a, a FROM both_ UNION (SELECT p.node, min(i.g) FROM recurring.cc p JOIN both_ x ON x.a = p.node JOIN cc i ON i.node = x.b WHERE i.g < p.g GROUP BY p.node)) SELECT node, g AS "group" FROM cc""")
def d5_connected_groups(spark, d):
    lines = table(spark, d, "lineitem")
    return K.connected_groups(lines.select((F.col("l_partkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b")))


def totals(df: DataFrame) -> DataFrame:
    return df.groupBy("o_custkey").agg(F.count("price").alias("orders"), F.round(F.sum("price"), 2).alias("total"), F.count("discount").alias("discounts"))


def prices(spark, d, swapped: int | None, raised: int | None) -> DataFrame:
    """Orders with a price or, for some customers, a discount in its stead; these swap the two, others pay one more."""
    o = table(spark, d, "orders")
    mod = lambda n: F.lit(False) if n is None else F.col("o_custkey") % n == 0
    amount = F.when(mod(raised), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    discount = (F.col("o_custkey") % 4 == 0) & ~mod(swapped)
    return o.select("o_custkey", "o_orderkey", F.when(~discount, amount).alias("price"), F.when(discount, amount).alias("discount"))


PRICES = "p AS (SELECT o_custkey, CASE WHEN o_custkey % {raised} = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS amount, o_custkey % 4 = 0 AND o_custkey % {swapped} <> 0 AS discount FROM orders), {name} AS (SELECT o_custkey, count(*) FILTER (NOT discount) AS orders, round(sum(amount) FILTER (NOT discount), 2) AS total, count(*) FILTER (discount) AS discounts FROM p GROUP BY o_custkey)"
NEVER = 10**9


@query(f"WITH {PRICES.format(raised=10, swapped=12, name='t')} SELECT * FROM t")
def d6_incremental_refresh(spark, d):
    """Some customers' nulls move from one column to the other, which is a change like any other."""
    old = prices(spark, d, None, None)
    return D.incremental_refresh(old, prices(spark, d, 12, 10), totals(old), ["o_custkey"], totals)


@query(f"WITH {PRICES.format(raised=NEVER, swapped=NEVER, name='a')}, {PRICES.format(raised=7, swapped=NEVER, name='b').replace('p AS', 'p2 AS').replace('FROM p ', 'FROM p2 ')}, c AS (SELECT * FROM a WHERE o_custkey % 7 <> 0 OR o_custkey % 2 <> 0 UNION ALL SELECT * FROM b WHERE o_custkey % 14 = 0) SELECT *, 'incremental' AS only_in FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'fresh' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM c)")
def d7_verify_incremental(spark, d):
    """A refresh told of half of the changes differs in the other half, one told of all differs nowhere."""
    old, new = prices(spark, d, None, None), prices(spark, d, None, 7)
    told = new.filter("o_custkey % 14 = 0").unionByName(old.filter("o_custkey % 14 <> 0"))
    fresh = totals(new)
    half, whole = (D.incremental_refresh(old, x, totals(old), ["o_custkey"], totals) for x in (told, new))
    return D.verify_incremental(half, fresh).unionByName(D.verify_incremental(whole, fresh))


@query("SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def d8_invalidate_dependents(spark, d):
    deps = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("path"))
    changed = table(spark, d, "part").filter("p_size = 7").select(F.col("p_partkey").alias("path"))
    return D.invalidate_dependents(changed, deps)[0]


@query("SELECT event_type, round(quantile_disc(value, 0.5), 1) AS p50, round(quantile_disc(value, 0.95), 1) AS p95, round(max(value), 1) AS max FROM events GROUP BY event_type")
def d9_latency_stats(spark, d):
    return Q.latency_stats(table(spark, d, "events"), "event_type", "value")


@query("""WITH RECURSIVE p AS (SELECT c_custkey AS node, c_custkey - 1 AS parent FROM customer WHERE c_custkey % 40 <> 0 UNION ALL SELECT c_custkey, c_custkey // 3 FROM customer WHERE c_custkey % 5 = 0 AND c_custkey >= 3), v AS (SELECT c_custkey AS node, min(c_mktsegment) AS value FROM customer WHERE c_custkey % 40 = 1 GROUP BY ALL),
a(node, value, depth) USING KEY (node) AS (SELECT node, value, 0 FROM v UNION (SELECT p.node, min(a.value), min(a.depth) + 1 FROM a JOIN p ON p.parent = a.node WHERE p.node NOT IN (SELECT node FROM recurring.a) GROUP BY p.node)) SELECT node, value, depth FROM a""")
def d10_method_resolution(spark, d):
    """Chains of up to 39 steps that also meet other chains."""
    c = table(spark, d, "customer")
    parents = c.filter("c_custkey % 40 <> 0").select(F.col("c_custkey").alias("node"), (F.col("c_custkey") - 1).alias("parent"))
    others = c.filter("c_custkey % 5 = 0 AND c_custkey >= 3").select(F.col("c_custkey").alias("node"), F.floor(F.col("c_custkey") / 3).alias("parent"))
    values = c.filter("c_custkey % 40 = 1").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("value"))
    return K.method_resolution(parents.unionByName(others), values)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS events FROM s GROUP BY user_id, s""")
def t1_debounce_batch(spark, d):
    out = D.sessions(events(spark, d), ["user_id"], "ts", "6 hours")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "events")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def t2_latest_version_batch(spark, d):
    return D.latest_version(table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


@query(f"""WITH RECURSIVE {EVENTS}, x AS (SELECT e.*, v.event_type = (SELECT min(event_type) FROM events) AS reset FROM e JOIN events v USING (event_id)), f AS (SELECT user_id, r, CASE WHEN reset THEN NULL ELSE value END AS a FROM x WHERE r = 1
UNION ALL SELECT x.user_id, x.r, CASE WHEN reset THEN NULL WHEN a IS NULL THEN value ELSE a * 0.5 + value * 0.5 END FROM f JOIN x ON x.user_id = f.user_id AND x.r = f.r + 1), l AS (SELECT user_id, max(r) AS r FROM f GROUP BY user_id) SELECT user_id, round(a, 6) AS average FROM f JOIN l USING (user_id, r)""")
def t3_ewma_batch(spark, d):
    e = events(spark, d)
    first = e.agg(F.min("event_type").alias("t"))
    marked = e.join(F.broadcast(first)).withColumn("reset", F.col("event_type") == F.col("t"))
    return D.ewma_cost(marked, ["user_id"], ["ts", "event_id"], "value", "reset").select("user_id", F.round("average", 6).alias("average"))


CHANGES = """WITH x AS (SELECT o_custkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 2 - CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS version, CASE WHEN o_orderkey % 4 = 0 THEN 'full' ELSE 'edit' END AS kind, o_orderpriority AS p FROM orders),
b AS (SELECT *, count(*) FILTER (kind = 'full') OVER (PARTITION BY key ORDER BY version ROWS UNBOUNDED PRECEDING) AS base, lag(version) OVER (PARTITION BY key ORDER BY version) AS before FROM x),
g AS (SELECT *, kind = 'edit' AND (base = 0 OR before IS NULL OR version - before <> 1) AS gap FROM b), r AS (SELECT *, max(gap::INT) OVER (PARTITION BY key, base ORDER BY version ROWS UNBOUNDED PRECEDING) = 1 AS broken FROM g), l AS (SELECT key, max(base) AS base FROM r GROUP BY key)
SELECT key, max(version) FILTER (NOT broken) AS version, CASE WHEN base > 0 THEN string_agg(p, '' ORDER BY version) FILTER (NOT broken) END AS text, NOT bool_or(broken) AND base > 0 AS in_sync FROM r JOIN l USING (key, base) GROUP BY key, base"""


@query(CHANGES)
def t4_change_log_keys(spark, d):
    return D.apply_change_log(change_log(spark, d), ["key"]).select("key", "version", "text", "in_sync")


def change_log(spark, d) -> DataFrame:
    """A log of changes made of orders: versions in order, some skipped."""
    from pyspark.sql import Window

    o = table(spark, d, "orders")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) * 2 - F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0)
    log = o.select(F.col("o_custkey").alias("key"), n.cast("long").alias("version"), F.when(F.col("o_orderkey") % 4 == 0, "full").otherwise("edit").alias("kind"), F.col("o_orderpriority").alias("payload"))
    return log.groupBy("key", "version").agg(F.min("kind").alias("kind"), F.min("payload").alias("payload"))


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL")
def t7_daily_windows_batch(spark, d):
    out = D.time_windows(events(spark, d), ["event_type"], "ts", "1 day", None, F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", "v")


def streamed(spark, d, job, keys: list[str], order: str, mode: str = "update", source: DataFrame | None = None, **step) -> DataFrame:
    """The table that a streaming job over events (or another stream) leaves behind."""
    path = f"{scratch_folder(spark, 'stream')}/rows"
    events_ = source if source is not None else T.read_events(spark, d, "events.parquet")
    T.run_once(T.upserts(job(events_), path, keys, order, f"{path}-checkpoint", mode, **step), spark)
    return T.current(spark, path, keys, order)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS events FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def t1_debounce_stream(spark, d):
    """The sessions that the watermark has passed, each given out once."""
    out = streamed(spark, d, lambda s: T.debounce(s, ["user_id"], "ts", "6 hours", "1 hour"), ["user_id", "start"], "end", "append")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "events")


@query(CHANGES)
def t4_change_log_stream(spark, d):
    path = f"{scratch_folder(spark, 'changes')}/log"
    change_log(spark, d).write.parquet(path)
    log = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    step = lambda batch, now: T.change_log_step(batch, now, "key")
    schema = f"key {log.schema['key'].dataType.simpleString()}, version long, text string, in_sync boolean"
    out = streamed(spark, d, lambda s: s, ["key"], "version", source=log, step=step, schema=schema)
    return out.select("key", F.nullif("version", F.lit(-1)).alias("version"), "text", "in_sync")


@query("""WITH c AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS half, max(ts) AS last FROM events), kept AS (SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start FROM events, c WHERE ts >= half OR time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY > last - INTERVAL 2 DAY)
SELECT event_type, start, count(*) AS n, true AS late FROM kept GROUP BY ALL""")
def t8_late_data_stream(spark, d):
    """The later half of the events comes first, so the earlier half is too late: it changes nothing and is counted."""
    e = events(spark, d)
    half = e.agg((F.min(F.unix_micros("ts")) + F.expr("(max(unix_micros(ts)) - min(unix_micros(ts))) / 2")).alias("half"))
    turn = F.when(F.unix_micros("ts") < F.col("half"), 2).otherwise(F.col("event_id") % 2)
    marked = e.join(F.broadcast(half)).select("event_type", "ts", turn.alias("turn"))
    path = f"{scratch_folder(spark, 'late')}/events"
    for k in range(3):  # a file for each micro-batch: what is late in one follows from the watermark of the batch before
        marked.filter(F.col("turn") == k).drop("turn").coalesce(1).write.mode("append").parquet(path)
    source = T.read_events(spark, path, files_per_trigger=1)
    job = T.time_windows(source, ["event_type"], "ts", "1 day", None, "2 days", F.count("*").alias("n")).select("event_type", "start", "n")
    kept = f"{path}-out"
    done = T.run_once(T.upserts(job, kept, ["event_type", "start"], "n", f"{kept}-checkpoint"), spark)
    out = T.current(spark, kept, ["event_type", "start"], "n")
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.lit(T.late_rows(done) > 0).alias("late"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def t2_t6_latest_version_stream(spark, d):
    out = streamed(spark, d, lambda s: T.latest_version(s, ["user_id"], "event_id", "event_type"), ["user_id"], "event_id")
    return out.select("user_id", "event_id", "event_type")


@query(f"""WITH RECURSIVE {EVENTS}, f AS (SELECT user_id, r, value AS a FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.r, a * 0.5 + value * 0.5 FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
SELECT user_id, round(arg_max(a, r), 6) AS average, max(r) AS "rows" FROM f GROUP BY user_id""")
def t3_ewma_stream(spark, d):
    out = streamed(spark, d, lambda s: T.ewma(s, "user_id", ["ts", "event_id"], "value"), ["user_id"], "rows")
    return out.select("user_id", F.round("average", 6).alias("average"), "rows")


@query("SELECT DISTINCT event_id FROM events")
def t5_dedupe_stream(spark, d):
    twice = lambda s: T.dedupe_events(s.unionByName(s), ["event_id"], "ts").select("event_id", F.lit(1).alias("one"))
    return streamed(spark, d, twice, ["event_id"], "one").select("event_id")


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def t7_t8_daily_windows_stream(spark, d):
    job = lambda s: T.time_windows(s, ["event_type"], "ts", "1 day", None, "2 days", F.count("*").alias("n")).select("event_type", "start", "n")
    out = streamed(spark, d, job, ["event_type", "start"], "n")
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_id, event_type, coalesce(CASE WHEN event_id % 2 = 0 THEN 'live' END, c_mktsegment) AS label FROM events LEFT JOIN (SELECT c_custkey, min(c_mktsegment) AS c_mktsegment FROM customer GROUP BY ALL) ON user_id = c_custkey")
def t9_stream_static(spark, d):
    stored = table(spark, d, "customer").groupBy(F.col("c_custkey").alias("user_id")).agg(F.min("c_mktsegment").alias("label"))
    live = lambda s: T.with_static(s.withColumn("label", F.when(F.col("event_id") % 2 == 0, "live")), stored, ["user_id"], "label").select("event_id", "event_type", "label", F.lit(1).alias("one"))
    return streamed(spark, d, live, ["event_id"], "one").select("event_id", "event_type", "label")
