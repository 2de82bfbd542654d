"""Best-fit packing of tokenised documents, planned on the histogram of piece lengths.

Pieces are counted by length, best-fit decreasing runs on the driver over those counts (at most `capacity` of
them), and pieces take the planned slots by joining on their rank within their length. A null text is the empty
text and gives one piece holding the end id; repeated rows are packed once for each row; an empty table gives no
rows; other columns of the input are not read.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, durable, table, texts_of, trimmed
from .wordbpe import WordBpe, loaded

CAPACITY = 4096
END = 1


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt): each document's ids and the end id, cut only where longer than
    capacity; salt numbers a task's pieces, so that pieces of a repeated id can be told apart."""
    bounded_batches(docs.sparkSession)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, salt long"
    tail = end.to_bytes(4, "little")

    def run(batches):
        tok, ids = loaded(WordBpe, path)
        made = 0
        for batch in batches:
            out = [[], [], [], [], []]
            for doc_id, text in zip(batch["doc_id"].to_pylist(), texts_of(batch), strict=True):
                blob = b"".join(map(ids.__getitem__, tok.pretokens(text))) + tail
                for k, at in enumerate(range(0, len(blob), 4 * capacity)):
                    part = blob[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            kinds = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            salt, made = pa.array(range(made, made + len(out[0])), pa.int64()), made + len(out[0])
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(out, kinds, strict=True)), salt], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), schema)


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, rank_from, rank_to, first_sequence, each, offset).

    The pieces of one length with ranks in [rank_from, rank_to) go, `each` to a sequence, to the sequences from
    first_sequence on, starting at offset. Sequences that are filled alike stay together as one range, so the work
    and the plan depend on the number of lengths, not on the number of pieces.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    runs, opened = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = min((r for r in free if r >= length), default=None)
            if room is None:
                each = capacity // length
                free[capacity] = [(opened, -(-left // each))]
                opened += -(-left // each)
                room = capacity
            first, n = free[room].pop()
            if not free[room]:
                del free[room]
            each = min(room // length, left)
            full = min(n, left // each)
            runs.append((length, rank, rank + full * each, first, each, capacity - room))
            rank, left = rank + full * each, left - full * each
            if full < n:
                free.setdefault(room, []).append((first + full, n - full))
            if room - each * length:
                free.setdefault(room - each * length, []).append((first, full))
    return runs


def ranked(cut: DataFrame, per_task: int = 200_000) -> DataFrame:
    """cut with `rank`, from 0, within its length. A frequent length is ranked in parts, offset by the counts of the parts before."""
    parts = max(64, -(-cut.count() // per_task))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    return cut.withColumn("rank", F.row_number().over(within) - 1).join(base, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base")).drop("part", "base")


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document."""
    spark = docs.sparkSession
    cut = durable(pieces(docs, capacity, end, path), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    fields = ["length", "rank_from", "rank_to", "first", "each", "at"]
    plan = pa.Table.from_pylist([dict(zip(fields, r, strict=True)) for r in plan_slots(histogram, capacity)], pa.schema([(f, pa.int64()) for f in fields]))
    runs = spark.createDataFrame(plan)  # from Arrow: a list would start Python workers of another kind on every executor
    p, r = ranked(cut).alias("p"), F.broadcast(runs).alias("r")  # the plan's size is bounded by the capacity
    step = F.col("p.rank") - F.col("r.rank_from")
    return p.join(r, (F.col("p.length") == F.col("r.length")) & (F.col("p.rank") >= F.col("r.rank_from")) & (F.col("p.rank") < F.col("r.rank_to"))).select(
        "doc_id", "piece", "start", "p.length", "ids_crc32",
        (F.col("r.first") + F.floor(step / F.col("r.each"))).cast("long").alias("sequence_id"),
        (F.col("r.at") + step % F.col("r.each") * F.col("p.length")).cast("long").alias("offset"),
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
