"""Base tensors of the registered queries, and the same as SQL common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.build import tensor_from_table, unpack_axis
from ..tensor import Tensor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month_of(c: str) -> Column:
    return ((F.year(c) - 1995) * 12 + F.month(c) - 1).cast("long")


def sales(spark, d) -> DataFrame:
    lines, orders, customers = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "customer")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))


def qty(spark, d) -> Tensor:
    """Quantity by customer nation and order month."""
    return tensor_from_table(sales(spark, d), {"nation": F.col("c_nationkey").cast("long"), "month": month_of("o_orderdate")}, "l_quantity", sizes={"nation": 25})


QTY = """qty AS (SELECT c_nationkey::BIGINT AS nation, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::BIGINT AS month, sum(l_quantity) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
months AS (SELECT unnest(range(max(month) + 1)) AS month FROM qty), nations AS (SELECT unnest(range(25)) AS nation),
dense AS (SELECT nation, month, coalesce(value, 0) AS value FROM nations CROSS JOIN months LEFT JOIN qty USING (nation, month))"""


def rev(spark, d) -> Tensor:
    """Revenue by customer nation and order month."""
    money = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return tensor_from_table(sales(spark, d), {"nation": F.col("c_nationkey").cast("long"), "month": month_of("o_orderdate")}, money, sizes={"nation": 25})


REV = """rev AS (SELECT c_nationkey::BIGINT AS nation, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::BIGINT AS month, sum(l_extendedprice * (1 - l_discount)) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def emb(spark, d) -> Tensor:
    """Embeddings by vector and component."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("vec"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return unpack_axis(rows, ["vec"], "e", "k", {"k": 64})


EMB = "emb AS (SELECT vec_id AS vec, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS value FROM embeddings)"


def act(spark, d) -> Tensor:
    """Number of events by user and hour of day."""
    return tensor_from_table(table(spark, d, "events"), {"user": F.col("user_id"), "hour": F.hour("ts").cast("long")}, F.lit(1.0), sizes={"hour": 24})


ACT = "act AS (SELECT user_id AS \"user\", hour(ts)::BIGINT AS hour, count(*)::DOUBLE AS value FROM events GROUP BY ALL)"


def price(spark, d) -> Tensor:
    return tensor_from_table(table(spark, d, "part"), {"part": F.col("p_partkey")}, "p_retailprice", "max")


def size(spark, d) -> Tensor:
    return tensor_from_table(table(spark, d, "part"), {"part": F.col("p_partkey")}, F.col("p_size").cast("double"), "max")


PART = "pr AS (SELECT p_partkey AS part, max(p_retailprice) AS price, max(p_size)::DOUBLE AS size FROM part GROUP BY ALL)"


def daily(spark, d) -> Tensor:
    """Number of orders by day since the start of 1995."""
    return tensor_from_table(table(spark, d, "orders"), {"day": F.datediff("o_orderdate", F.lit("1995-01-01")).cast("long")}, F.lit(1.0))


DAILY = "daily AS (SELECT datediff('day', DATE '1995-01-01', o_orderdate::DATE) AS day, count(*)::DOUBLE AS value FROM orders GROUP BY ALL)"


def rounded(t: Tensor, digits: int = 6) -> DataFrame:
    """The value to so many digits, with no negative zero."""
    return t.df.withColumn("value", F.round(F.col("value"), digits) + F.lit(0.0))


def plain(t: Tensor) -> DataFrame:
    return t.df.withColumn("value", F.col("value").cast("double"))
