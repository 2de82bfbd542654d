"""Sharding by a permutation-filled lookup table.

Each shard has its own preference order over the slots of a table of prime size; the shards take turns, each turn
claiming the first slot of its order that is still free, until the table is full. A key's slot is its hash modulo
the table's size, so a broadcast of the table places any row in constant time, and a change of shards moves few keys.

A null key counts as the empty text; equal keys share a shard; repeated rows are placed each; an empty table gives
no rows; the input's other columns pass through unread unless their name is that of a new column, which wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SHARDS = 64
SIZE = 6421  # prime, 100 slots for each shard


def text_hash(text: str, part: int = 0) -> int:
    """32 bits of the text's MD5, the same in Spark and in SQL."""
    import hashlib

    return int(hashlib.md5(text.encode()).hexdigest()[8 * part : 8 * part + 8], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = SIZE) -> list[int]:
    """The shard number of every slot."""
    if not shards or len(set(shards)) < len(shards) or not is_prime(size) or size < len(shards):
        raise ValueError("needs distinct shards and a prime table size that is not below their number")
    order = [(text_hash(s) % size, text_hash(s, 1) % (size - 1) + 1) for s in shards]
    taken, turn, at = [-1] * size, 0, [0] * len(shards)
    for _ in range(size):
        start, step = order[turn]
        while taken[slot := (start + at[turn] * step) % size] >= 0:
            at[turn] += 1
        taken[slot] = turn
        turn = (turn + 1) % len(shards)
    return taken


def slot_of(key: Column, size: int) -> Column:
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % size).cast("int")


def assign_shards(df: DataFrame, key: str, shards: list[str], size: int = SIZE) -> DataFrame:
    """df with `slot` and `shard`. The broadcast holds one row per slot: its size is the table's, whatever the data."""
    lookup = df.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(lookup_table(shards, size))], "slot int, shard string")
    return df.drop("shard").withColumn("slot", slot_of(F.col(key), size)).join(F.broadcast(lookup), "slot")


def names(n: int) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot, shard of every document."""
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", names(SHARDS)).select("doc_id", "slot", "shard")


OP1_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 4, '0') AS name FROM range({SHARDS}) t(i)),
orders AS (
  SELECT list(('0x' || substr(md5(name), 1, 8))::BIGINT % {SIZE} ORDER BY i) AS start,
         list(('0x' || substr(md5(name), 9, 8))::BIGINT % ({SIZE} - 1) + 1 ORDER BY i) AS step FROM shards),
claims AS (
  SELECT 0 AS turn, CAST(NULL AS BIGINT) AS slot, repeat('0', {SIZE})::BIT AS taken
  UNION ALL
  SELECT turn + 1, claimed, set_bit(taken, claimed::INT, 1) FROM (
    SELECT turn, taken, list_filter(list_transform(range({SIZE}), lambda j: (start[turn % {SHARDS} + 1] + j * step[turn % {SHARDS} + 1]) % {SIZE}),
                                    lambda s: get_bit(taken, s::INT) = 0)[1] AS claimed
    FROM claims, orders WHERE turn < {SIZE})),
lookup AS (SELECT slot, 'shard-' || lpad(((turn - 1) % {SHARDS})::VARCHAR, 4, '0') AS shard FROM claims WHERE turn > 0)
SELECT doc_id, slot::INT AS slot, shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {SIZE} AS slot FROM documents) d JOIN lookup USING (slot)
"""
