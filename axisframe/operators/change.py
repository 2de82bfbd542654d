"""Change processing: incremental refresh by content hash, its check against a fresh run, and batch twins of the streams."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as fold

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import durable
from ..tensor import fail_unless
from .hof import averaged

FULL_ABOVE = 0.6


def content_hash(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hash, rows): 64 bits of each row's other columns, equal keys together.

    Hash functions pass nulls over, so (null, 5) would equal (5, null): the JSON text of the row, which names every
    null, is hashed with the values.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.xxhash64(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), *rest) if rest else F.lit(0).cast("long")
    return df.groupBy(*keys).agg(F.sum(row.cast("decimal(38,0)")).alias("hash"), F.count("*").alias("rows"))


def dirty_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The keys whose content is new, changed or gone."""
    a, b = content_hash(old, keys).toDF(*keys, "h_", "n_"), content_hash(new, keys).toDF(*keys, "h_", "n_")
    both = a.withColumn("side_", F.lit(1)).unionByName(b.withColumn("side_", F.lit(2)))  # a null key is a key, too
    same = (F.count("*") == 2) & (F.min("h_") == F.max("h_")) & (F.min("n_") == F.max("n_"))
    return both.groupBy(*keys).agg(same.alias("same_")).filter("NOT same_").select(*keys)


def of_keys(df: DataFrame, wanted: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """The rows of df whose keys are (or, with left_anti, are not) among the wanted ones; nulls are keys like others."""
    other = wanted.select(*(F.col(k).alias(f"{k}_of_") for k in keys)).distinct()
    return df.join(other, fold(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{k}_of_")) for k in keys)), how)


def incremental_refresh(old: DataFrame, new: DataFrame, results: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame], groups: DataFrame | None = None, full_above: float = FULL_ABOVE) -> DataFrame:
    """Results for `new`: reused for keys with unchanged content, computed for the others.

    With groups (keys, group), a change spreads to its whole group. Above a share of dirty keys everything is computed.
    compute takes whole keys and gives rows that carry the keys.
    """
    dirty = dirty_keys(old, new, keys)
    if groups is not None:
        touched = of_keys(groups, dirty, keys).select("group").distinct()
        dirty = dirty.unionByName(groups.join(touched, "group", "left_semi").select(*keys)).distinct()
    dirty = durable(dirty)
    now = new.select(*keys).distinct()
    total, bad = now.count(), of_keys(now, dirty, keys).count()
    if total and bad / total > full_above:
        return compute(new)
    kept = of_keys(of_keys(results, dirty, keys, "left_anti"), now, keys)
    return kept.unionByName(compute(of_keys(new, dirty, keys)))


def verify_incremental(incremental: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows that one run has and the other lacks, with the side that has them; empty where the two agree."""
    fail_unless(sorted(incremental.columns) == sorted(fresh.columns), "columns differ")
    incremental = incremental.select(*fresh.columns)
    return incremental.exceptAll(fresh).withColumn("only_in", F.lit("incremental")).unionByName(fresh.exceptAll(incremental).withColumn("only_in", F.lit("fresh")))


def invalidate_dependents(changed: DataFrame, dependencies: DataFrame, key: str = "key", path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(keys to drop, dependencies that stay): a changed path drops every key that reads it."""
    drop = dependencies.join(changed.select(path).distinct(), path, "left_semi").select(key).distinct()
    return drop, dependencies.join(drop, key, "left_anti")


def sessions(events: DataFrame, keys: list[str], ts: str, gap) -> DataFrame:
    """(keys, start, end, events): events closer than the gap share a session; the gap may be a column of durations."""
    w = F.session_window(ts, gap)
    return events.groupBy(*keys, w.alias("w_")).agg(F.count("*").alias("events")).select(*keys, F.col("w_.start").alias("start"), F.col("w_.end").alias("end"), "events")


def latest_version(events: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Each key's row of the newest version; the largest row on ties."""
    rest = [c for c in events.columns if c not in keys and c != version]
    best = events.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("r_"))
    return best.select(*keys, "r_.*").select(*events.columns)


def ewma_cost(samples: DataFrame, keys: list[str], order: list[str], cost: str, reset: str, alpha: float = 0.5) -> DataFrame:
    """(keys, average): the average starts anew at a reset row; null where no cost follows the last reset. Rows without a
    cost are passed over, a null reset is none."""
    return averaged(samples, keys, order, cost, alpha, "average", reset)


def apply_change_log(log: DataFrame, keys: list[str], version: str = "version", kind: str = "kind", payload: str = "payload") -> DataFrame:
    """(keys, version, text, in_sync): a full text starts afresh, edits that follow one another without a gap are
    appended, and an edit that does not fit silences the key until the next full text."""
    w = Window.partitionBy(*keys).orderBy(version)
    runs = log.withColumn("base_", F.count_if(F.col(kind) == "full").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("gap_", (F.col(kind) == "edit") & ((F.col(version) - F.lag(version).over(w) != 1) | (F.col("base_") == 0) | F.lag(version).over(w).isNull()))
    broken = F.max(F.col("gap_").cast("int")).over(Window.partitionBy(*keys, "base_").orderBy(version).rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.withColumn("broken_", broken == 1)
    last = runs.groupBy(*keys).agg(F.max("base_").alias("base_"))
    part = runs.join(last, [*keys, "base_"])
    text = F.concat_ws("", F.transform(F.filter(F.array_sort(F.collect_list(F.struct(version, payload, "broken_"))), lambda x: ~x["broken_"]), lambda x: x[payload]))
    out = part.groupBy(*keys, "base_").agg(F.max(F.when(~F.col("broken_"), F.col(version))).alias(version), text.alias("text"), (~F.bool_or("broken_") & (F.max("base_") > 0)).alias("in_sync"))
    return out.select(*keys, version, F.when(F.col("base_") > 0, F.col("text")).alias("text"), "in_sync")


def time_windows(events: DataFrame, keys: list[str], ts: str, size: str, slide: str | None, *aggs) -> DataFrame:
    """Aggregates over tumbling or sliding windows of time."""
    return events.groupBy(*keys, F.window(ts, size, slide or size).alias("w_")).agg(*aggs).withColumns({"start": F.col("w_.start"), "end": F.col("w_.end")}).drop("w_")
