"""Shared plumbing: table reading, Arrow batch limits and hashing."""

from __future__ import annotations

import ctypes
import gc
import os
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import durable, forget

__all__ = ["durable", "forget"]
BATCH_ROWS = 2000
BATCH_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches sent to Python workers by rows and by bytes, and let local workers import this package.

    A cluster gets the package with --py-files.
    """
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [paths, root]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers: every bit of the result depends on every bit given."""
    h = (h ^ (h >> np.uint64(32))) * A
    h = (h ^ (h >> np.uint64(29))) * B
    return h ^ (h >> np.uint64(32))


def fresh(name: str, taken) -> str:
    """name, or a longer one where it is taken."""
    while name in taken:
        name += "_"
    return name


def remainder(column: str, modulus: int):
    """crc32 of the id's decimal text modulo a number; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def least_frequent(counts: DataFrame, n: str, most: int) -> int | None:
    """The smallest count with at most `most` rows of that count or more, all rows of one band of counts together.

    It comes from a histogram of counts, so the driver gets a bounded number of rows; None where not even one band fits.
    """
    band = F.floor(16 * F.log2(F.col(n))).cast("int")  # about a thousand bands at most
    kept, cut = 0, None
    for row in counts.groupBy(band.alias("band")).agg(F.count("*").alias("keys"), F.min(n).alias("least")).sort(F.desc("band")).collect():
        if kept + row["keys"] > most:
            break
        kept, cut = kept + row["keys"], row["least"]
    return cut


def frequent(counts: DataFrame, column: str, n: str, most: int) -> list:
    """At most `most` of the most frequent keys, as (key, n), all keys of one band of counts together; n desc, key."""
    cut = least_frequent(counts, n, most)
    if cut is None:
        return []
    got = counts.filter(F.col(n) >= cut).select(column, n).toArrow()
    return sorted(zip(got[column].to_pylist(), got[n].to_pylist(), strict=True), key=lambda r: (-r[1], r[0]))


def give_back() -> None:
    """Return memory that this Python worker no longer uses to the system; its next task may be of another kind."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def trimmed(run):
    """A function for mapInArrow that gives memory back at a task's end."""

    def call(batches):
        yield from run(batches)
        give_back()

    return call


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts, null as the empty text."""
    return [x or "" for x in batch[column].to_pylist()]


def kept_rows(df: DataFrame, keep) -> DataFrame:
    """The rows of df for whose texts keep(list of texts) says true, all columns as they are, without a join."""
    bounded_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(keep(texts_of(batch)), pa.bool_()))

    return df.mapInArrow(trimmed(run), df.schema)
