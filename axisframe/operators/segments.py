"""Running totals, places and user-given scans within groups of any size.

Rows are sorted once by ranges of keys and order, so a group with most of the rows lies in many ranges. Each range works on
its own part of a group; what a range needs of the ranges before it (their totals, combined in order) comes from a table with
a row for each range, since only the first group of a range can have begun before it. Where the largest group, found by one
count, fits a task, a plain window does the same without the written copy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce as fold

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import durable
from ..tensor import fail_unless
from .blocks import runs

ONE_TASK = 1_000_000  # rows of a group that one task may sort
RUNNING = {"sum": F.sum, "prod": F.product, "max": F.max, "min": F.min, "any": F.bool_or, "all": F.bool_and}


def combined(how: str, a: Column, b: Column) -> Column:
    return {"sum": a + b, "prod": a * b, "max": F.greatest(a, b), "min": F.least(a, b), "any": a | b, "all": a & b}[how]


def fits(df: DataFrame, keys: list[str]) -> bool:
    """Whether the largest group fits a task; counts are combined on the map side."""
    return (df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= ONE_TASK


def same(keys: list[str]) -> Column:
    """Equality of the columns with those of the same names and a final `_of`, null being like null."""
    return fold(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys), F.lit(True))


class Sorted:
    """Rows in order, each range with its number `part_`, and a row's place over all ranges in `at_`."""

    def __init__(self, df: DataFrame, *order):
        rows = durable(df.orderBy(*order).withColumn("at_", F.monotonically_increasing_id()), "sorted")
        self.rows = rows.withColumn("part_", F.shiftright("at_", 33))

    def pieces(self, keys: list[str]):
        return Window.partitionBy("part_", *keys)

    def carried(self, rows: DataFrame, keys: list[str], totals: dict[str, tuple[str, Column]]) -> DataFrame:
        """(part_, keys with _of, for each total `before_` and `all_`): the groups that lie in several ranges, a row for each of
        their ranges, with the totals of the ranges before and of all. Totals are (name of the operation, column)."""
        own = F.struct(*(F.col(k) for k in keys)) if keys else F.struct(F.lit(0).alias("k"))
        ends = rows.groupBy("part_").agg(F.min_by(own, "at_").alias("first_"), F.max_by(own, "at_").alias("last_"))
        met = ends.withColumn("past_", F.lag("last_").over(Window.orderBy("part_"))).filter(F.col("past_").eqNullSafe(F.col("first_")))  # a row for each range at most
        spanning = met.select("first_").distinct()
        if keys:
            spanning = spanning.select(*(F.col(f"first_.{k}").alias(f"{k}_of") for k in keys))
            mine = rows.join(F.broadcast(spanning), same(keys), "left_semi")
        else:
            mine = rows
        sums = mine.groupBy("part_", *keys).agg(*(RUNNING[how](c).alias(f"t_{n}") for n, (how, c) in totals.items()))
        by = Window.partitionBy(*(keys or [F.lit(0)]))
        before = by.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
        told = [x for n, (how, _) in totals.items() for x in (RUNNING[how](f"t_{n}").over(before).alias(f"before_{n}"), RUNNING[how](f"t_{n}").over(by).alias(f"all_{n}"))]
        return sums.select(F.col("part_").alias("part_of"), *(F.col(k).alias(f"{k}_of") for k in keys), *told)

    def with_carried(self, rows: DataFrame, keys: list[str], totals: dict[str, tuple[str, Column]]) -> DataFrame:
        more = self.carried(rows, keys, totals)
        return rows.join(F.broadcast(more), (F.col("part_") == F.col("part_of")) & same(keys), "left").drop("part_of", *(f"{k}_of" for k in keys))

    def running(self, rows: DataFrame, keys: list[str], how: str, column: Column, out: str) -> DataFrame:
        """rows with the running total of their group up to each."""
        both = self.with_carried(rows.withColumn("x_", column), keys, {"x": (how, F.col("x_"))})
        within = RUNNING[how]("x_").over(self.pieces(keys).orderBy("at_").rowsBetween(Window.unboundedPreceding, 0))
        whole = both.withColumn("within_", within)
        value = F.when(F.col("before_x").isNull(), F.col("within_")).when(F.col("within_").isNull(), F.col("before_x")).otherwise(combined(how, F.col("before_x"), F.col("within_")))
        return whole.withColumn(out, value).drop("x_", "within_", "before_x", "all_x")

    def places(self, rows: DataFrame, keys: list[str], place: str, number: str | None = None) -> DataFrame:
        """rows with their 0-based place in their group and, where asked, the group's number of rows."""
        both = self.with_carried(rows, keys, {"n": ("sum", F.lit(1).cast("long"))})
        mine = F.row_number().over(self.pieces(keys).orderBy("at_")) - 1
        out = both.withColumn(place, (mine + F.coalesce("before_n", F.lit(0))).cast("long"))
        if number:
            out = out.withColumn(number, F.coalesce("all_n", F.count("*").over(self.pieces(keys))).cast("long"))
        return out.drop("before_n", "all_n")


def running_total(df: DataFrame, keys: list[str], order: list, column: str, out: str, how: str = "sum", small: bool | None = None) -> DataFrame:
    """df with a running total (sum, prod, max, min, any, all) of each group in order. `small` says that groups fit a task, where
    that is known; else they are counted."""
    fail_unless(how in RUNNING, f"unknown operation {how}")
    if keys and (fits(df, keys) if small is None else small):
        return df.withColumn(out, RUNNING[how](column).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    by = Sorted(df, *keys, *order)
    return by.running(by.rows, keys, how, F.col(column), out).drop("at_", "part_")


def placed(df: DataFrame, keys: list[str], order: list, small: bool | None = None) -> DataFrame:
    """df with each row's 0-based place within its keys (`r_`) and their number of rows (`n_`)."""
    if keys and (fits(df, keys) if small is None else small):
        by = Window.partitionBy(*keys)
        return df.withColumn("r_", (F.row_number().over(by.orderBy(*order)) - 1).cast("long")).withColumn("n_", F.count("*").over(by))
    by = Sorted(df, *keys, *order)
    return by.places(by.rows, keys, "r_", "n_").drop("at_", "part_")


Combine = Callable[[list[np.ndarray], list[np.ndarray]], list[np.ndarray]]


def scanned(columns: list[np.ndarray], starts: np.ndarray, combine: Combine) -> list[np.ndarray]:
    """The inclusive scan of each segment, in as many steps as its length has bits; `starts` marks the segments' first rows."""
    segment = np.cumsum(starts)
    longest = np.bincount(segment).max() if len(segment) else 0
    step = 1
    while step < longest:
        at = np.flatnonzero(segment[step:] == segment[:-step]) + step
        merged = combine([c[at - step] for c in columns], [c[at] for c in columns])
        columns = [c.astype(np.result_type(c, m)) for c, m in zip(columns, merged, strict=True)]
        for c, m in zip(columns, merged, strict=True):
            c[at] = m
        step *= 2
    return columns


def associative_scan(df: DataFrame, keys: list[str], order: list, columns: list[str], combine: Combine) -> DataFrame:
    """df with each of the (double) columns replaced by its scan within the keys, in order, under a user's associative operation on
    one or more numbers: combine(earlier columns, later columns) gives the combined ones, elementwise on numpy arrays.

    A range is scanned as it streams through its task. Null keys are keys of their own; groups that follow each other are told
    apart by a 64-bit digest.
    """
    import pyarrow as pa

    for c in columns:
        df = df.withColumn(c, F.col(c).cast("double"))
    by = Sorted(df.withColumn("key_", F.xxhash64(*keys) if keys else F.lit(0).cast("long")), *keys, *order)
    rows = by.rows.repartition("part_").sortWithinPartitions("part_", "at_")

    def each_part(batches, first: dict) -> Iterator:
        """(part, batch, scanned columns, keys, first key) of the batches, with what the ranges before bring along."""
        for (part,), held in runs(batches, ["part_"]):
            last, carry = first.get(part, (None, None))
            for batch in held:
                key = batch["key_"].to_numpy()
                values = [batch[c].to_numpy(zero_copy_only=False).astype(float) for c in columns]
                if last is not None and key[0] == last:
                    values = [np.r_[[c], v] for c, v in zip(carry, values, strict=True)]
                    key_ = np.r_[[last], key]
                else:
                    key_ = key
                starts = np.r_[True, key_[1:] != key_[:-1]]
                values = [v[len(key_) - len(key) :] for v in scanned(values, starts, combine)]
                last, carry = key[-1], [v[-1] for v in values]
                yield part, batch, values

    def ends(batches):
        part, kept = None, None
        for p, batch, values in each_part(batches, {}):
            key = batch["key_"].to_numpy()
            if p != part:
                if kept:
                    yield row(part, kept)
                part, kept = p, [key[0], True, None, None]
            kept = [kept[0], kept[1] and bool((key == kept[0]).all()), key[-1], [v[-1] for v in values]]
        if kept:
            yield row(part, kept)

    def row(part, kept):
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (int(part), int(kept[0]), bool(kept[1]), int(kept[2]))] + [pa.array([[float(v) for v in kept[3]]])], ["part", "first", "single", "last", "total"])

    told = sorted(rows.mapInArrow(ends, "part long, first long, single boolean, last long, total array<double>").toLocalIterator(), key=lambda r: r["part"])  # a row for each range
    first, last, total = {}, None, None
    for r in told:
        brought = total if last == r["first"] else None
        if brought is not None:
            first[r["part"]] = (last, brought)
        own = r["total"]
        if r["single"] and brought is not None:
            own = [float(x[0]) for x in combine([np.array([b]) for b in brought], [np.array([v]) for v in own])]
        last, total = r["last"], own
    shared = df.sparkSession.sparkContext.broadcast(first)
    names = df.columns

    def scan(batches):
        for _, batch, values in each_part(batches, shared.value):
            new = dict(zip(columns, values, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(new[c]) if c in new else batch[c] for c in names], names)

    return rows.mapInArrow(scan, df.schema)
