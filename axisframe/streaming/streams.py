"""Change events as streams: sessions, newest versions, running averages, change logs, upserts and lookups.

Event times that have no zone are read as UTC, since watermarks refuse the zone-less type.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, pattern: str = "*.parquet", ts: str = "ts", files_per_trigger: int | None = None, schema=None) -> DataFrame:
    """A stream of the Parquet files of a folder whose names fit, with a zoned time column."""
    schema = schema or spark.read.parquet(f"{folder}/{pattern}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn(ts, F.col(ts).cast("timestamp"))


def debounce(events: DataFrame, keys: list[str], ts: str, gap, late: str = "1 hour") -> DataFrame:
    """Sessions of events closer than the gap, which may differ by row; given out once the watermark has passed them."""
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(*keys, w.alias("w_")).agg(F.count("*").alias("events")).select(*keys, F.col("w_.start").alias("start"), F.col("w_.end").alias("end"), "events")


def latest_version(events: DataFrame, keys: list[str], version: str, payload: str) -> DataFrame:
    """The payload of each key's newest version so far; older versions that come late change nothing. Update or complete mode."""
    return events.groupBy(*keys).agg(F.max_by(payload, version).alias(payload), F.max(version).alias(version))


def timeout(keep: int | None) -> str:
    return GroupStateTimeout.NoTimeout if keep is None else GroupStateTimeout.ProcessingTimeTimeout


def ewma(events: DataFrame, key: str, order: str | list[str], cost: str, reset: str | None = None, alpha: float = 0.5, keep: int | None = None) -> DataFrame:
    """(key, average, rows) after each micro-batch: a fold in each key's state, rows of a batch in order; a reset row empties it.

    With `keep`, a key's state goes after so many milliseconds without a row, so that the state stays bounded.
    """
    kind = events.schema[key].dataType.simpleString()

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        average, rows = state.get if state.exists else (None, 0)
        pdf = pd.concat(list(frames)).sort_values(order)
        for value, clear in zip(pdf[cost], pdf[reset] if reset else [False] * len(pdf), strict=True):
            average = None if clear else float(value) if average is None else average * (1 - alpha) + float(value) * alpha
            rows += 1
        state.update((average, rows))
        if keep is not None:
            state.setTimeoutDuration(keep)
        yield pd.DataFrame({key: [group[0]], "average": [average], "rows": [rows]})

    return events.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, average double, rows long", "average double, rows long", "update", timeout(keep))


def apply_change_log(events: DataFrame, key: str, version: str = "version", kind: str = "kind", payload: str = "payload", keep: int | None = None) -> DataFrame:
    """(key, version, text, in_sync) after each micro-batch: an edit that does not follow the last version silences the key
    until a full text comes; version is -1 before the first one. `keep` bounds the state as in ewma."""
    key_type = events.schema[key].dataType.simpleString()

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        at, text, in_sync = state.get if state.exists else (-1, None, False)
        for row in pd.concat(list(frames)).sort_values(version).itertuples():
            v, k, p = getattr(row, version), getattr(row, kind), getattr(row, payload)
            if k == "full":
                if v > at:
                    at, text, in_sync = int(v), p, True
            elif in_sync and v == at + 1:
                at, text = int(v), text + p
            elif v > at:
                in_sync = False
        state.update((at, text, in_sync))
        if keep is not None:
            state.setTimeoutDuration(keep)
        yield pd.DataFrame({key: [group[0]], "version": [at], "text": [text], "in_sync": [in_sync]})

    return events.groupBy(key).applyInPandasWithState(run, f"`{key}` {key_type}, version long, text string, in_sync boolean", "version long, text string, in_sync boolean", "update", timeout(keep))


def change_log_step(batch: DataFrame, now: DataFrame, key: str, version: str = "version", kind: str = "kind", payload: str = "payload") -> DataFrame:
    """(key, version, text, in_sync) of the keys of a micro-batch, from their rows before it: what `apply_change_log` does, as
    expressions over each key's changes in order, for `upserts` to fold batch by batch. No Python runs for a key."""
    rows = batch.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(version).cast("long").alias("v"), F.col(kind).alias("k"), F.col(payload).alias("p")))).alias("rows_"))
    stored = now.select(key, F.struct("version", "text", "in_sync").alias("now_"))
    none = F.struct(F.lit(-1).cast("long").alias("version"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("in_sync"))
    state = lambda v, text, in_sync: F.struct(v.alias("version"), text.alias("text"), in_sync.alias("in_sync"))

    def step(s, r):
        newer = r["v"] > s["version"]
        fits = s["in_sync"] & (r["v"] == s["version"] + 1)
        longer = F.concat(F.coalesce(s["text"], F.lit("")), F.coalesce(r["p"], F.lit("")))
        return F.when(newer & (r["k"] == "full"), state(r["v"], r["p"], F.lit(True))).when(newer & fits, state(r["v"], longer, F.lit(True))).when(newer, state(s["version"], s["text"], F.lit(False))).otherwise(s)

    folded = rows.join(stored, key, "left").select(key, F.aggregate("rows_", F.coalesce("now_", none), step).alias("now_"))
    return folded.select(key, "now_.version", "now_.text", "now_.in_sync")


def dedupe_events(events: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Each event once; the state holds keys no longer than the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each key's row of the largest order, the later batch's on ties."""
    rest = [c for c in rows.columns if c not in keys and c not in (order, "epoch")]
    best = rows.groupBy(*keys).agg(F.max(F.struct(order, "epoch", *rest)).alias("r_"))
    return best.select(*keys, f"r_.{order}", "r_.epoch", *(f"r_.{c}" for c in rest))


def folders(spark: SparkSession, path: str) -> tuple[int, list[tuple[int, str]]]:
    """(epoch of the last compaction or -1, its folder and those of the batches after it, by epoch)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath() for f in system.listStatus(where)] if system.exists(where) else []
    done = [p for p in found if system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    numbered = sorted((p.getName().split("=")[0], int(p.getName().split("=")[1]), p.toString()) for p in done if p.getName().split("=")[0] in ("batch", "upto"))
    base = max((n for kind, n, _ in numbered if kind == "upto"), default=-1)
    return base, [(n, p) for kind, n, p in numbered if n > base or (kind == "upto" and n == base)]


def compact(spark: SparkSession, path: str, keys: list[str], order: str) -> None:
    """Write the current rows of all batches so far as one table, and delete what it stands for once it is complete."""
    base, parts = folders(spark, path)
    if len(parts) < 2:
        return
    last = max(n for n, _ in parts)
    newest(spark.read.parquet(*(p for _, p in parts)), keys, order).write.mode("overwrite").parquet(f"{path}/upto={last}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for _, p in parts:
        hadoop(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop(p), True)


def upserts(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, mode: str = "update", every: int = 50, step=None, schema: str | None = None):
    """A writer that keeps one current row for each key below path, in one folder for each micro-batch; read it with
    `current`. A batch that runs again writes the same folder again, and every so many batches all are made one.

    With a step, the rows of a batch are step(batch, the rows before it of the batch's keys), which have the schema; a later
    batch's order must not be less than an earlier one's."""

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        base, parts = folders(spark, path)
        if epoch <= base:
            return  # compacted before the batch was noted as done
        if step:
            before = [p for n, p in parts if n < epoch]
            if before:
                now = newest(spark.read.parquet(*before).join(batch.select(*keys).distinct(), keys, "left_semi"), keys, order).drop("epoch")
            else:
                now = spark.createDataFrame([], schema)
            batch = step(batch, now)
        newest(batch.withColumn("epoch", F.lit(epoch).cast("long")), keys, order).write.mode("overwrite").parquet(f"{path}/batch={epoch}")
        if epoch % every == every - 1:
            compact(spark, path, keys, order)

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put)


def current(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """The current row of each key."""
    return newest(spark.read.parquet(*(p for _, p in folders(spark, path)[1])), keys, order).drop("epoch")


def time_windows(events: DataFrame, keys: list[str], ts: str, size: str, slide: str | None, late: str, *aggs) -> DataFrame:
    """Tumbling or sliding windows; rows later than the watermark are dropped and counted in the query's progress."""
    return events.withWatermark(ts, late).groupBy(*keys, F.window(ts, size, slide or size).alias("w_")).agg(*aggs).withColumns({"start": F.col("w_.start"), "end": F.col("w_.end")}).drop("w_")


def late_rows(query) -> int:
    """How many rows, combined within each task, came too late, over the progress reports that the query still has."""
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)


def with_static(stream: DataFrame, static: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The stream's value where it has one, else the table's."""
    stored = static.select(*keys, F.col(value).alias("stored_"))
    return stream.join(stored, keys, "left").withColumn(value, F.coalesce(value, "stored_")).drop("stored_")


def run_once(writer, spark: SparkSession):
    """Process what is there, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
