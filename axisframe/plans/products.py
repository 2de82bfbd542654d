"""Queries on large products: tiles, cyclic sums."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import contract as C
from ..operators.blocks import row_totals
from ..sources.build import tensor_from_table
from ..sources.scratch import durable
from .common import EMB, emb, query, sales


@query(f"""WITH {EMB}, p AS (SELECT a.vec, b.vec AS other, sum(a.value * b.value) AS value FROM emb a JOIN emb b USING (k) GROUP BY ALL)
SELECT vec, round(sum(value), 5) + 0.0 AS total, round(max(value) FILTER (other <> vec), 6) + 0.0 AS most, round(sum(value * value), 5) AS square FROM p GROUP BY vec""")
def j1_product_by_tiles(spark, d):
    """All inner products of the embeddings, multiplied tile by tile and summed up where they arise; of each vector's row the sum,
    the largest but its own, and the sum of squares."""
    t = emb(spark, d)
    t = replace(t, sizes=t.measured)
    rows = row_totals(t, t.rename(vec="other"), ["k"])
    return rows.select("vec", *(F.round(F.col(c) + 0.0, n).alias(c) for c, n in (("total", 5), ("most", 6), ("square", 5))))


@query("""WITH s AS (SELECT l_partkey AS p, l_suppkey AS s, c_nationkey AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
ps AS (SELECT p, s, count(*) AS v FROM s GROUP BY ALL), sn AS (SELECT s, n, count(*) AS v FROM s GROUP BY ALL), np AS (SELECT n, p, count(*) AS v FROM s GROUP BY ALL)
SELECT ps.s, sum(ps.v * sn.v * np.v)::DOUBLE AS value FROM ps JOIN sn ON ps.s = sn.s JOIN np ON np.n = sn.n AND np.p = ps.p GROUP BY ps.s""")
def j6_cyclic_einsum(spark, d):
    """Weighted triangles part - supplier - nation of the customer, by supplier: a cycle, joined in one round."""
    rows = durable(sales(spark, d).select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("c_nationkey").cast("long").alias("n")), "sales")
    pairs = [tensor_from_table(rows, {a: F.col(a), b: F.col(b)}, F.lit(1.0)) for a, b in ("ps", "sn", "np")]
    return C.einsum("ps,sn,np->s", *pairs).df
