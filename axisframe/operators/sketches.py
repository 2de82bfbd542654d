"""Stored summaries of cells: counts, extremes, quantile sketches (KLL) and distinct counts (HyperLogLog), merged without the rows.

A table of sketches has a row for each cell and batch of data. Rolling up dims and adding new data are the same step, a grouped
merge of sketches, so neither reads old rows again. The merge of quantile sketches keeps the stated error of ranks, about
2.3 / k ** 0.9; that of distinct counts does not depend on the order at all.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tensor import fail_unless

K = 800  # of the quantile sketches: ranks to about half a hundredth
LG = 12  # of the distinct counts: 4096 registers, about 1.6 hundredths


def rank_error(k: int = K) -> float:
    return 2.3 / k**0.9


def sketched(df: DataFrame, dims: dict[str, Column | str] | list[str], value: Column | str, item: Column | str | None = None, k: int = K) -> DataFrame:
    """(dims…, n, least, most, quantiles[, items]) of each cell: of the values that are not null, and of the distinct items if asked
    for. Sketches form on the map side, so a cell with any share of the rows sends small ones."""
    named = dims if isinstance(dims, dict) else {d: d for d in dims}
    of = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(*(of(c).alias(d) for d, c in named.items()), of(value).cast("double").alias("v_"), *([] if item is None else [of(item).cast("string").alias("item_")]))
    aggs = [F.count("v_").alias("n"), F.min("v_").alias("least"), F.max("v_").alias("most"), F.kll_sketch_agg_double("v_", k).alias("quantiles")]
    if item is not None:
        aggs.append(F.hll_sketch_agg("item_", LG).alias("items"))
    return rows.groupBy(*named).agg(*aggs)


def rolled_up(sketches: DataFrame, kept: Iterable[str], k: int = K) -> DataFrame:
    """One row for each cell of the dims that are kept; over all its dims this merges batches of one cell."""
    aggs = [F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("quantiles", k).alias("quantiles")]
    if "items" in sketches.columns:
        aggs.append(F.hll_union_agg("items").alias("items"))
    return sketches.groupBy(*kept).agg(*aggs)


def added(old: DataFrame, new: DataFrame, dims: list[str]) -> DataFrame:
    """Both tables of sketches as one with a row a cell."""
    fail_unless(set(old.columns) == set(new.columns), f"columns {old.columns} and {new.columns}")
    return rolled_up(old.unionByName(new), dims)


def add_to_store(path: str, new: DataFrame) -> None:
    """Sketches of new data put beside those stored, as files of their own; readers roll them up."""
    new.write.mode("append").parquet(path)


def quantiles(sketches: DataFrame, shares: list[float], out: str = "q") -> DataFrame:
    """sketches with an array of estimates; the least and largest value are exact, and a cell without values has nulls."""
    fail_unless(all(0 <= q <= 1 for q in shares), "shares lie from 0 to 1")
    one = lambda q: F.col("least") if q == 0 else F.col("most") if q == 1 else F.kll_sketch_get_quantile_double("quantiles", F.lit(float(q)))
    return sketches.withColumn(out, F.array(*(F.when(F.col("n") > 0, one(q)) for q in shares)))


def distinct_items(sketches: DataFrame, out: str = "distinct_items") -> DataFrame:
    return sketches.withColumn(out, F.hll_sketch_estimate("items"))
