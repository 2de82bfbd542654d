"""Reductions over dims, with the array libraries' axis and keepdims arguments. Absent cells count with their fill."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..tensor import Tensor, fail_unless
from .broadcast import numbered
from .segments import placed


def aggregates() -> dict[str, Column]:
    v = F.col("value")
    return {
        "sum": F.sum(v), "mean": F.avg(v), "max": F.max(v), "min": F.min(v), "ptp": F.max(v) - F.min(v), "prod": F.product(v.cast("double")),
        "std": F.stddev_pop(v), "var": F.var_pop(v), "std1": F.stddev_samp(v), "var1": F.var_samp(v), "all": F.bool_and(v.cast("boolean")), "any": F.bool_or(v.cast("boolean")),
        "count_nonzero": F.count_if(v.cast("double") != 0), "approx_distinct": F.approx_count_distinct(v),
        "norm1": F.sum(F.abs(v)), "norm2": F.sqrt(F.sum(v * v)), "norminf": F.max(F.abs(v)),
    }


#: Reductions to which a cell that is zero and absent adds nothing.
SPARSE_SAFE = {"sum", "count_nonzero", "norm1", "norm2", "norminf", "any"}


def reduced(t: Tensor, agg: Column, axis=None, keepdims: bool = False, fill=None) -> Tensor:
    """An aggregate over dims; `fill` is its value of a slice without rows."""
    gone = t.names(axis)
    kept = [d for d in t.dims if d not in gone]
    out = t.df.groupBy(*kept).agg((agg if fill is None or kept else F.coalesce(agg, F.lit(fill))).alias("value"))
    small = Tensor(out, kept, [t.size(d) for d in kept], fill)
    return with_ones(small, t.dims, gone) if keepdims else small


def with_ones(t: Tensor, dims, gone: list[str]) -> Tensor:
    """t with the dims that a reduction took away, of size 1."""
    out = t.df.withColumns({d: F.lit(0).cast("long") for d in gone})
    return Tensor(out.select(*dims, "value"), dims, [1 if d in gone else t.size(d) for d in dims], t.fill)


def reduce(t: Tensor, how: str, axis=None, keepdims: bool = False, ddof: int = 0) -> Tensor:
    """One of the named reductions; no axis reduces all dims, an empty one keeps the shape."""
    if axis is not None and not isinstance(axis, (str, int)) and not list(axis):
        return t
    gone = t.names(axis)
    if how in ("std", "var") and ddof:
        fail_unless(ddof == 1, "ddof is 0 or 1")
        how += "1"
    aggs = aggregates()
    if how == "median":
        out = quantile(t, 0.5, gone)
        return out if not keepdims else with_ones(out, t.dims, gone)
    fail_unless(how in aggs, f"unknown reduction {how}")
    if how not in ("any", "all") and t.df.schema["value"].dataType == BooleanType():  # truth values count as 1 and 0
        t = t.map(lambda v: v.cast("long"), fill=None if t.fill is None else float(t.fill))
    if how == "mean" and t.fill == 0 and t.sizes.count(None) == 0:
        return reduced(t, F.sum("value") / float(prod(t.size(d) for d in gone)), axis, keepdims, 0.0)
    if t.fill is not None and not (t.fill == 0 and how in SPARSE_SAFE):
        t = t.dense()
    return reduced(t, aggs[how], axis, keepdims, None if t.fill is None else False if how == "any" else 0.0)


def minmax(t: Tensor, axis=None) -> tuple[Tensor, Tensor]:
    return reduce(t, "min", axis), reduce(t, "max", axis)


def norm(t: Tensor, order: float = 2, axis=None, keepdims: bool = False) -> Tensor:
    if order in (1, 2, float("inf")):
        return reduce(t, f"norm{'inf' if order == float('inf') else int(order)}", axis, keepdims)
    fail_unless(order > 0, f"norm of order {order}")
    t = t if t.fill == 0 else t.dense()
    return reduced(t, F.pow(F.sum(F.pow(F.abs("value"), F.lit(float(order)))), F.lit(1 / order)), axis, keepdims, None if t.fill is None else 0.0)


def logsumexp(t: Tensor, axis=None, keepdims: bool = False) -> Tensor:
    """max + log of the sum of exp(x - max), the maximum found per group first."""
    gone = t.names(axis)
    kept = [d for d in t.dims if d not in gone]
    t = t.dense()
    top = t.df.groupBy(*kept).agg(F.max("value").alias("top"))
    both = t.df.join(top, kept) if kept else t.df.crossJoin(F.broadcast(top))
    shifted = Tensor(both.select(*t.dims, F.struct("value", "top").alias("value")), t.dims, t.sizes, None)
    return reduced(shifted, F.max("value.top") + F.log(F.sum(F.exp(F.col("value.value") - F.col("value.top")))), axis, keepdims)


def arg(t: Tensor, how: str, axis: str | int) -> Tensor:
    """Position of the largest ('max') or smallest ('min') value along a dim, the first on ties."""
    d = t.name(axis)
    t = t.dense()
    key = -F.col("value") if how == "max" else F.col("value")
    return reduced(t, F.min_by(F.col(d), F.struct(key, F.col(d))), axis)


def quantile(t: Tensor, q, axis=None, dim: str = "q") -> Tensor:
    """Linear interpolation between the values around; a list of shares adds a leading dim."""
    many = not isinstance(q, (int, float))
    fail_unless(all(0 <= x <= 1 for x in (q if many else [q])), "shares lie from 0 to 1")
    t = t.dense()
    gone = t.names(axis)
    rest = [d for d in t.dims if d not in gone]
    sizes = [t.size(d) for d in rest]
    shares = [float(x) for x in (q if many else [q])]
    rows = placed(t.df.filter("value IS NOT NULL"), rest, ["value"])
    asked = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("i"), (F.lit(x) * (F.col("n_") - 1)).alias("at")) for i, x in enumerate(shares))))
    near = rows.withColumn("q_", asked).filter(F.abs(F.col("r_") - F.col("q_.at")) < 1)  # the one or two values around
    share = F.sum(F.col("value") * (1 - F.abs(F.col("r_") - F.col("q_.at"))))
    out = near.groupBy(F.col("q_.i").alias(dim), *rest).agg(share.alias("value"))
    if not many:
        return Tensor(out.select(*rest, "value"), rest, sizes, None)
    return Tensor(out.select(dim, *rest, "value"), (dim, *rest), (len(shares), *sizes), None)


def percentile(t: Tensor, q, axis=None) -> Tensor:
    return quantile(t, q / 100 if isinstance(q, (int, float)) else [x / 100 for x in q], axis)


def kth_value(t: Tensor, k: int, axis: str | int) -> tuple[Tensor, Tensor]:
    """(values, indices) of the k-th smallest along a dim, counted from 1."""
    t = t.dense()
    d = t.name(axis)
    n = t.size(d)
    fail_unless(k >= 1 and (n is None or k <= n), f"k = {k} of size {n}")
    return pair_of(t, d, placed(t.df, t.others(d), ["value", d]).filter(F.col("r_") == k - 1))


def pair_of(t: Tensor, d: str, hit: DataFrame) -> tuple[Tensor, Tensor]:
    rest = t.others(d)
    sizes = [t.size(x) for x in rest]
    return Tensor(hit.select(*rest, "value"), rest, sizes, None), Tensor(hit.select(*rest, F.col(d).alias("value")), rest, sizes, None)


def lower_median(t: Tensor, axis: str | int) -> tuple[Tensor, Tensor]:
    """(values, indices): the lower of the two middles."""
    t = t.dense()
    d = t.name(axis)
    return pair_of(t, d, placed(t.df, t.others(d), ["value", d]).filter(F.col("r_") == F.floor((F.col("n_") - 1) / 2)))


def mode(t: Tensor, axis: str | int) -> tuple[Tensor, Tensor]:
    """(values, indices): the most frequent value, the smallest on ties, and its last position."""
    t = t.dense()
    d = t.name(axis)
    rest = t.others(d)
    counts = t.df.groupBy(*rest, "value").agg(F.count("*").alias("n"), F.max(d).alias(d))
    best = counts.groupBy(*rest).agg(F.min(F.struct((-F.col("n")).alias("n"), "value", d)).alias("b"))
    return pair_of(t, d, best.select(*rest, F.col("b.value").alias("value"), F.col(f"b.{d}").alias(d)))


def unique(t: Tensor, dim: str = "i") -> Tensor:
    """The sorted distinct values as a vector of a length that the data tell."""
    values = t.dense().df.select("value").distinct()
    return Tensor(numbered(values, ["value"], "n_").select(F.col("n_").alias(dim), "value"), (dim,), (None,), None)


def bincount(t: Tensor, dim: str = "i", least: int = 0) -> Tensor:
    """How often each whole number from 0 to the largest occurs."""
    counts = t.dense().df.groupBy(F.col("value").cast("long").alias(dim)).agg(F.count("*").cast("double").alias("value"))
    out = Tensor(counts, (dim,), (None,), 0.0)
    return out.with_sizes(**{dim: max(least, out.length(dim))}).dense()


def histogram(t: Tensor, bins: int = 10, low: float | None = None, high: float | None = None, dim: str = "bin") -> tuple[Tensor, list[float]]:
    """(counts, edges) of equal bins from low to high, the last one closed; values outside are not counted."""
    fail_unless(bins > 0, "no bins")
    t = t.dense()
    if low is None or high is None:
        r = t.df.agg(F.min("value").alias("a"), F.max("value").alias("b")).first()
        low, high = (r["a"] if low is None else low), (r["b"] if high is None else high)
    if low == high:
        low, high = low - 0.5, high + 0.5
    fail_unless(low < high, "the lower end is above the upper")
    inside = t.df.filter(F.col("value").between(low, high))
    place = F.least(F.width_bucket("value", F.lit(float(low)), F.lit(float(high)), F.lit(bins)) - 1, F.lit(bins - 1)).cast("long")
    counts = inside.groupBy(place.alias(dim)).agg(F.count("*").cast("double").alias("value"))
    return Tensor(counts, (dim,), (bins,), 0.0).dense(), [low + (high - low) * i / bins for i in range(bins + 1)]


def subtotals(t: Tensor, *kept: list[str], how: str = "sum") -> DataFrame:
    """Several reduced shapes in one pass: a row set for each list of kept dims; `level` tells them apart."""
    sets = [[F.col(t.name(d)) for d in k] for k in kept]
    return t.df.groupingSets(sets, *t.dims).agg(aggregates()[how].alias("value"), F.grouping_id().alias("level"))


def approximate_size(df: DataFrame, column: str, error: float = 0.02) -> DataFrame:
    """An estimate of how many coordinates a data-dependent dim has."""
    return df.agg(F.approx_count_distinct(column, error).alias("size"))


def item(t: Tensor):
    """The only value."""
    rows = t.df.select("value").take(2)
    fail_unless(len(rows) == 1, "item needs exactly one cell")
    return rows[0]["value"]


