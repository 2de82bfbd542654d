"""The tensor handle: a table with one column for each dimension and a `value` column.

Coordinates are 0-based integers where an operator does arithmetic on them, and may be any key otherwise; they are
unique. A size is an integer, or None where only the data tell. `fill` is the value of cells that have no row: a
number, or None where an absent cell is missing.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import cached_property
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: A grid of more cells, such as one over hashed keys, is refused rather than written out.
MOST_CELLS = 10**13


class ShapeError(ValueError):
    """Sizes that an operator refuses; raised before any Spark job."""


def fail_unless(ok: bool, message: str) -> None:
    if not ok:
        raise ShapeError(message)


@dataclass(frozen=True)
class Tensor:
    df: DataFrame
    dims: tuple[str, ...]
    sizes: tuple[int | None, ...]
    fill: float | None = 0.0

    def __post_init__(self):
        object.__setattr__(self, "dims", tuple(self.dims))
        object.__setattr__(self, "sizes", tuple(self.sizes))
        fail_unless(len(self.dims) == len(self.sizes), f"{len(self.dims)} dims but {len(self.sizes)} sizes")
        fail_unless(len(set(self.dims)) == len(self.dims), f"repeated dim in {self.dims}")
        missing = [c for c in (*self.dims, "value") if c not in self.df.columns]
        fail_unless(not missing, f"no column {missing}")

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def rank(self) -> int:
        return len(self.dims)

    @cached_property
    def measured(self) -> tuple[int, ...]:
        """All sizes; those unknown are found by one aggregate."""
        unknown = [d for d, s in zip(self.dims, self.sizes, strict=True) if s is None]
        found = self.df.agg(*(F.max(d).alias(d) for d in unknown)).first() if unknown else {}
        return tuple(s if s is not None else (found[d] + 1 if found[d] is not None else 0) for d, s in zip(self.dims, self.sizes, strict=True))

    def size(self, dim: str | int) -> int | None:
        return self.sizes[self.axis(dim)]

    def length(self, dim: str | int) -> int:
        k = self.axis(dim)
        return self.sizes[k] if self.sizes[k] is not None else self.measured[k]

    def axis(self, dim: str | int) -> int:
        if isinstance(dim, str):
            fail_unless(dim in self.dims, f"no dim {dim} in {self.dims}")
            return self.dims.index(dim)
        fail_unless(-self.rank <= dim < self.rank, f"axis {dim} is out of range for rank {self.rank}")
        return dim % self.rank

    def name(self, dim: str | int) -> str:
        return self.dims[self.axis(dim)]

    def names(self, dims: str | int | Iterable | None) -> list[str]:
        """The dims meant by an axis argument; None means all."""
        if dims is None:
            return list(self.dims)
        out = [self.name(d) for d in ([dims] if isinstance(dims, (str, int)) else dims)]
        fail_unless(len(set(out)) == len(out), f"axis given twice: {out}")
        return out

    def others(self, *dims: str | int) -> list[str]:
        gone = {self.name(d) for d in dims}
        return [d for d in self.dims if d not in gone]

    def with_df(self, df: DataFrame, dims: Sequence[str] | None = None, sizes: Sequence[int | None] | None = None, fill="same") -> Tensor:
        dims = self.dims if dims is None else tuple(dims)
        sizes = tuple(self.sizes[self.dims.index(d)] if d in self.dims else None for d in dims) if sizes is None else tuple(sizes)
        return Tensor(df.select(*dims, "value"), dims, sizes, self.fill if fill == "same" else fill)

    def map(self, f, fill="same") -> Tensor:
        """f of the value column; what it makes of the fill is asked for where that changes."""
        return self.with_df(self.df.withColumn("value", f(F.col("value"))), fill=fill)

    def rename(self, **names: str) -> Tensor:
        dims = [names.get(d, d) for d in self.dims]
        return Tensor(self.df.select(*(F.col(a).alias(b) for a, b in zip(self.dims, dims, strict=True)), "value"), dims, self.sizes, self.fill)

    def with_sizes(self, **sizes: int) -> Tensor:
        return replace(self, sizes=tuple(sizes.get(d, s) for d, s in zip(self.dims, self.sizes, strict=True)))

    def dense(self, fill: float | None = None) -> Tensor:
        """A row for every cell."""
        value = self.fill if fill is None else fill
        if not self.rank or value is None:
            return self
        cells = prod(self.measured)
        fail_unless(cells <= MOST_CELLS, f"{cells} cells of {dict(zip(self.dims, self.measured, strict=True))} are too many to write out; number the keys first")
        cells = grid(self.spark, dict(zip(self.dims, self.measured, strict=True)))
        return Tensor(cells.join(self.df, list(self.dims), "left").withColumn("value", F.coalesce("value", F.lit(value))).select(*self.dims, "value"), self.dims, self.measured, None)


def grid(spark: SparkSession, sizes: dict[str, int]) -> DataFrame:
    """All coordinates of the given sizes, from one range: no join."""
    n, columns = prod(sizes.values()), []
    df, left = spark.range(n), n
    for name, size in sizes.items():
        left //= max(1, size)
        columns.append((F.floor(F.col("id") / F.lit(max(1, left))) % max(1, size)).cast("long").alias(name))
    return df.select(*columns)


def linear(dims: Sequence[str], sizes: Sequence[int]) -> Column:
    """The row-major position of a cell."""
    out = F.lit(0).cast("long")
    for d, s in zip(dims, sizes, strict=True):
        out = out * s + F.col(d)
    return out


def fresh(dim: str, taken: Iterable[str]) -> str:
    taken = set(taken)
    while dim in taken:
        dim += "_"
    return dim
