"""Connected components of an edge table by alternating large and small stars, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, forget


def large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the node's smallest neighbour (or itself)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the component's smallest node, itself listed too."""

    def state(df):
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    edges = durable(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    before = state(edges)
    while before[0]:
        after = durable(small_star(large_star(edges)), "stars")
        forget(edges)
        edges, now = after, state(after)
        if now == before:
            break
        before = now
    tied = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return tied.unionByName(tied.select(F.col("root").alias("node"), "root").distinct())
