"""A keyed table of current rows that streams put into: hash buckets, runs of batches, levelled merging.

Every batch is a run, a folder of Parquet files by hash bucket of the key, sorted by key and with Bloom filters of it. FAN runs
of a level are merged into one of the next. A run's name tells which batches it holds, so a merged run and those it replaces
never count twice: readers take the widest runs that are complete. A look-up of keys reads their buckets only, and of these
the row groups whose statistics and filters let a key be there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .streams import newest

BUCKETS = 512
FAN = 4
FILTER_BYTES = 1 << 16  # of a row group's Bloom filter at most
LOOKED_UP = 10_000  # keys that a look-up may name


def bucket(keys: list[str]):
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def complete_runs(spark: SparkSession, path: str) -> list[tuple[int, int, str]]:
    """(first batch, last batch, folder) of the widest complete runs, which do not overlap."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    where = hadoop(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath() for f in system.listStatus(where)] if system.exists(where) else []
    runs = sorted((*map(int, p.getName()[4:].split("-")), p.toString()) for p in found if p.getName().startswith("run=") and system.exists(hadoop(p, "_SUCCESS")))
    out, upto = [], -1
    for first, last, folder in sorted(runs, key=lambda r: (r[0], -r[1])):
        if first > upto:
            out.append((first, last, folder))
            upto = last
    return out


def forget_replaced(spark: SparkSession, path: str) -> None:
    """Delete runs that a wider complete one stands for, and unfinished ones of batches that are done."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    where = hadoop(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    kept = {folder for *_, folder in complete_runs(spark, path)}
    for f in system.listStatus(where):
        if f.getPath().getName().startswith("run=") and f.getPath().toString() not in kept:
            system.delete(f.getPath(), True)


def write_run(rows: DataFrame, path: str, first: int, last: int, keys: list[str]) -> None:
    filters = {f"parquet.bloom.filter.enabled#{k}": "true" for k in keys} | {"parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.max.bytes": str(FILTER_BYTES)}
    placed = rows.withColumn("bucket", bucket(keys)).repartition("bucket").sortWithinPartitions("bucket", *keys)
    placed.write.mode("overwrite").options(**filters).partitionBy("bucket").parquet(f"{path}/run={first}-{last}")


def put(batch: DataFrame, epoch: int, path: str, keys: list[str], order: str) -> None:
    """The batch's newest row of each key as a run; a batch that comes again writes the same run again, or nothing where a
    merged one holds it."""
    spark = batch.sparkSession
    if any(first <= epoch <= last and last > first for first, last, _ in complete_runs(spark, path)):
        return
    write_run(newest(batch.withColumn("epoch", F.lit(epoch).cast("long")), keys, order), path, epoch, epoch, keys)
    merge(spark, path, keys, order)


def level(first: int, last: int) -> int:
    """0 for one batch, one more for every FAN times as many."""
    n, out = last - first + 1, 0
    while n >= FAN:
        n, out = n // FAN, out + 1
    return out


def merge(spark: SparkSession, path: str, keys: list[str], order: str) -> None:
    """Merge the last FAN runs of one level, as long as there are so many; others stay as they are."""
    while True:
        runs = complete_runs(spark, path)
        last = runs[-FAN:]
        if len(last) < FAN or len({level(a, b) for a, b, _ in last}) > 1:
            return
        rows = spark.read.option("basePath", path).parquet(*(folder for *_, folder in last)).drop("run", "bucket")
        write_run(newest(rows, keys, order), path, last[0][0], last[-1][1], keys)
        forget_replaced(spark, path)


def into_store(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, mode: str = "update"):
    """A writer that keeps the newest row of each key below path."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(lambda batch, epoch: put(batch, epoch, path, keys, order))


def stored(spark: SparkSession, path: str, keys: list[str], order: str, wanted: DataFrame | None = None) -> DataFrame:
    """The current rows, all or those of the wanted keys (LOOKED_UP at most; more are joined). Only the wanted keys' buckets
    are read."""
    runs = [folder for *_, folder in complete_runs(spark, path)]
    rows = spark.read.option("basePath", path).parquet(*runs).drop("run")
    if wanted is None:
        return newest(rows.drop("bucket"), keys, order).drop("epoch")
    named = wanted.select(*keys).dropna().distinct().withColumn("bucket", bucket(keys)).limit(LOOKED_UP + 1).collect()
    if len(named) > LOOKED_UP:
        return newest(rows.drop("bucket").join(wanted.select(*keys).distinct(), keys, "left_semi"), keys, order).drop("epoch")
    few = rows.filter(F.col("bucket").isin([r["bucket"] for r in named] or [-1]))
    for k in keys:
        few = few.filter(F.col(k).isin([r[k] for r in named]))
    exact = spark.createDataFrame([tuple(r[k] for k in keys) for r in named], wanted.select(*keys).schema)
    return newest(few.drop("bucket").join(F.broadcast(exact), keys, "left_semi"), keys, order).drop("epoch")
