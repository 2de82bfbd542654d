"""Elementwise operators with broadcasting: dims meet by name, or from the right; size 1 stretches."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce as fold
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.catalogue import BINARY, UNARY
from ..sources.scratch import durable
from ..tensor import MOST_CELLS, Tensor, fail_unless, grid, linear


def as_tensor(spark: SparkSession, x) -> Tensor:
    return x if isinstance(x, Tensor) else Tensor(spark.range(1).select(F.lit(float(x)).alias("value")), (), (), None)


def join_sizes(dim: str, a: int | None, b: int | None) -> int | None:
    fail_unless(a is None or b is None or a == b or 1 in (a, b), f"sizes {a} and {b} of {dim} do not broadcast")
    if a is None or b is None:
        return b if a is None else a
    return max(a, b) if 0 not in (a, b) else 0


def by_position(a: Tensor, b: Tensor) -> tuple[Tensor, Tensor]:
    """b with a's names, matched from the right (or the other way where b has the higher rank)."""
    if b.rank > a.rank:
        b2, a2 = by_position(b, a)
        return a2, b2
    names = dict(zip(reversed(b.dims), reversed(a.dims), strict=False))
    return a, b.rename(**names)


@dataclass(frozen=True)
class Pair:
    df: DataFrame
    dims: tuple[str, ...]
    sizes: tuple[int | None, ...]


def align(a: Tensor, b: Tensor, positional: bool = False, outer: bool = False) -> Pair:
    """Rows with the values of both at each cell, as `left` and `right`.

    Dense or product-like work joins inner; with `outer`, absent cells take each side's fill.
    """
    if positional:
        a, b = by_position(a, b)
    dims = (*a.dims, *(d for d in b.dims if d not in a.dims))
    sizes = []
    for d in dims:
        x, y = (t.size(d) if d in t.dims else 1 for t in (a, b))
        sizes.append(join_sizes(d, x, y) if d in a.dims and d in b.dims else (x if d in a.dims else y))
    shared = [d for d in a.dims if d in b.dims]
    drop_a = [d for d in shared if a.size(d) == 1 and b.size(d) != 1]
    drop_b = [d for d in shared if b.size(d) == 1 and a.size(d) != 1]
    keys = [d for d in shared if d not in drop_a and d not in drop_b]
    left = a.df.withColumnRenamed("value", "left").drop(*drop_a)
    right = b.df.withColumnRenamed("value", "right").drop(*drop_b)
    if keys:
        whole = outer and set(a.dims) == set(b.dims) and not drop_a and not drop_b
        df = left.join(right, keys, "full" if whole else "inner")
        if whole:
            df = df.withColumns({"left": F.coalesce("left", F.lit(a.fill)), "right": F.coalesce("right", F.lit(b.fill))})
    else:  # an outer product or a scalar: every pair is a cell of the result
        df = left.crossJoin(right)
    return Pair(df.select(*dims, "left", "right"), dims, tuple(sizes))


_fills: dict[str, object] = {}


def fill_of(spark: SparkSession, value: Column):
    """What a column expression without columns of a table comes to, as a number or a truth value."""
    key = str(value)
    if key not in _fills:
        _fills[key] = spark.range(1).select(value.alias("v")).first()["v"]
    return _fills[key]


@dataclass(frozen=True)
class Joined:
    """Rows with the values of several tensors at each cell, as v0_, v1_, …; absent rows have the values `fills` (None: no such cells)."""

    df: DataFrame
    dims: tuple[str, ...]
    sizes: tuple[int | None, ...]
    fills: tuple | None

    def map(self, expression) -> Tensor:
        """The tensor of expression(v0, v1, …), absent cells included."""
        columns = [F.col(c) for c in self.df.columns if c not in self.dims]
        fill = None if self.fills is None else fill_of(self.df.sparkSession, expression(*map(F.lit, self.fills)))
        return Tensor(self.df.select(*self.dims, expression(*columns).alias("value")), self.dims, self.sizes, fill)


def common_sizes(tensors: list[Tensor]) -> dict[str, int | None]:
    sizes: dict[str, int | None] = {}
    for t in tensors:
        for d, n in zip(t.dims, t.sizes, strict=True):
            sizes[d] = join_sizes(d, sizes[d], n) if d in sizes else n
    return sizes


def joined(*parts) -> Joined:
    """The parts, tensors or numbers, at every cell of their common shape; dims meet by name and size 1 stretches.

    A cell that is absent from a tensor counts with its fill; where the fill is None the cell is missing, in the result too.
    Tensors with all dims meet in full joins, and the result stays sparse. Where a tensor lacks a dim, its values stretch
    over absent cells of the others as well, so one of them is written out first.
    """
    tensors = {i: p for i, p in enumerate(parts) if isinstance(p, Tensor)}
    spark = next(iter(tensors.values())).spark
    sizes = common_sizes(list(tensors.values()))
    keys = {i: [d for d in t.dims if not (t.size(d) == 1 and sizes[d] != 1)] for i, t in tensors.items()}
    whole = [i for i in tensors if len(keys[i]) == len(sizes)]
    partial = [i for i in tensors if i not in whole]
    needed, filled = [i for i in whole if tensors[i].fill is None], [i for i in whole if tensors[i].fill is not None]
    stored = lambda i: (tensors[i] if keys[i] or not tensors[i].rank else tensors[i].dense()).df  # noqa: E731  a single cell is a row
    rows = lambda i: stored(i).select(*keys[i], F.col("value").alias(f"v{i}_"))

    def meet(df: DataFrame, i: int, how: str) -> DataFrame:
        return df.join(rows(i), keys[i], how) if keys[i] else df.crossJoin(F.broadcast(rows(i)))  # without dims one row

    fills, first = None, []
    if needed:
        df, first = rows(needed[0]), needed[:1]
    elif not partial:
        df, first = rows(whole[0]), whole[:1]
        fills = tuple(tensors[i].fill if i in tensors else float(p) for i, p in enumerate(parts))
    else:
        lengths = {d: n if n is not None else max(t.length(d) for t in tensors.values() if d in t.dims) for d, n in sizes.items()}
        sizes = lengths
        if filled:
            first = filled[:1]
            t = tensors[first[0]]
            df = t.with_sizes(**{d: lengths[d] for d in t.dims}).dense().df.withColumnRenamed("value", f"v{first[0]}_")
        else:
            cells = prod(lengths.values())
            fail_unless(cells <= MOST_CELLS, f"{cells} cells of {lengths} are too many to write out")
            df = grid(spark, lengths)
    for i in [*needed, *filled, *partial]:
        if i not in first:
            df = meet(df, i, "full" if fills is not None else "inner" if tensors[i].fill is None else "left")
    values = {f"v{i}_": F.lit(float(p)) if i not in tensors else F.col(f"v{i}_") if tensors[i].fill is None or not keys[i] else F.coalesce(f"v{i}_", F.lit(tensors[i].fill)) for i, p in enumerate(parts)}
    return Joined(df.select(*sizes, *(v.alias(c) for c, v in values.items())), tuple(sizes), tuple(sizes.values()), fills)


def elementwise(t: Tensor, f: str, *args, **options) -> Tensor:
    """A named function of every cell; absent cells have its value of their fill."""
    fail_unless(f in UNARY, f"unknown function {f}")
    return mapped(t, lambda v: UNARY[f](v, *args, **options))


def mapped(t: Tensor, f) -> Tensor:
    """f of the value column and of the fill."""
    return t.map(f, fill=None if t.fill is None else fill_of(t.spark, f(F.lit(t.fill))))


def binary(a, b, f: str | None = None, expression=None, positional: bool = False, outer: bool | None = None) -> Tensor:
    """f of the values of a and b, either of which may be a number. Absent cells count with their fill; `outer=False` asks
    for the cells that both store only."""
    if f is not None:
        fail_unless(f in BINARY, f"unknown function {f}")
    expression = expression or BINARY[f]
    if not isinstance(b, Tensor):
        return mapped(a, lambda v: expression(v, F.lit(float(b))))
    if not isinstance(a, Tensor):
        return mapped(b, lambda v: expression(F.lit(float(a)), v))
    if positional:
        a, b = by_position(a, b)
    zero = a.fill == b.fill == 0 and f in ("multiply", "mul")  # a cell that one of them lacks is 0
    if outer is False or zero:
        pair = align(a, b)
        return Tensor(pair.df.select(*pair.dims, expression(F.col("left"), F.col("right")).alias("value")), pair.dims, pair.sizes, 0.0 if zero else None)
    return joined(a, b).map(expression)


def where(condition: Tensor, x, y) -> Tensor:
    """x where the condition holds, else y; all three broadcast."""
    return joined(condition, x, y).map(lambda c, a, b: F.when(c.cast("boolean"), a).otherwise(b))


def select(conditions: list[Tensor], choices: list, default: float = 0.0) -> Tensor:
    """The choice of the first condition that holds."""
    fail_unless(len(conditions) == len(choices) and conditions, "as many choices as conditions are needed")
    n = len(conditions)

    def picked(*v):
        out = v[2 * n]
        for c, x in reversed(list(zip(v[:n], v[n : 2 * n], strict=True))):
            out = F.when(c.cast("boolean"), x).otherwise(out)
        return out

    return joined(*conditions, *choices, default).map(picked)


def clip(t: Tensor, low=None, high=None) -> Tensor:
    bounds = [(f, b) for f, b in (("maximum", low), ("minimum", high)) if b is not None]

    def bounded(v, *limits):
        for (f, _), limit in zip(bounds, limits, strict=True):
            v = BINARY[f](v, limit)
        return v

    return joined(t, *(b for _, b in bounds)).map(bounded)


def masked_fill(t: Tensor, mask: Tensor, value: float) -> Tensor:
    """value where the mask holds; cells without a value in the mask keep theirs."""
    fail_unless(set(mask.dims) <= set(t.dims), "the mask has other dims")
    mask = mask.map(lambda m: m.cast("boolean"), fill=bool(mask.fill))
    out = joined(t, mask).map(lambda v, m: F.when(F.coalesce(m, F.lit(False)), F.lit(value)).otherwise(v))
    return out.with_df(out.df, t.dims)


def numbered(df: DataFrame, order: list, column: str) -> DataFrame:
    """df with a dense 0-based number in the given order, without gathering all rows in one task: sorted by range,
    numbered within partitions, and shifted by the counts of the partitions before."""
    rows = durable(df.orderBy(*order).withColumn("row_at_", F.monotonically_increasing_id()))
    part, place = F.shiftright("row_at_", 33), F.col("row_at_").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(part.alias("row_part_")).count().withColumn("row_before_", F.coalesce(F.sum("count").over(Window.orderBy("row_part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = F.broadcast(counts.select("row_part_", "row_before_"))  # a row for each partition
    return rows.withColumn("row_part_", part).join(counts, "row_part_").withColumn(column, (place + F.col("row_before_")).cast("long")).drop("row_at_", "row_part_", "row_before_")


def masked_select(t: Tensor, mask: Tensor, dim: str = "i") -> Tensor:
    """The values where the mask holds, in row-major order, as a vector of a length that the data tell."""
    pair = joined(t, mask)
    if pair.fills is not None and pair.fills[1]:  # absent cells are among them
        pair = joined(t.dense(), mask)
    kept = pair.df.filter(F.col("v1_").cast("boolean")).select(*pair.dims, F.col("v0_").alias("value"))
    return Tensor(numbered(kept, list(pair.dims), "n_").select(F.col("n_").alias(dim), "value"), (dim,), (None,), None)


def nonzero(t: Tensor) -> DataFrame:
    """The coordinates of the cells that are not zero."""
    return (t if t.fill == 0 else t.dense()).df.filter(F.col("value").cast("double") != 0).select(*t.dims)


def glu(t: Tensor, dim: str | int = -1) -> Tensor:
    """First half times the sigmoid of the second; the dim's size must be even."""
    d, n = t.name(dim), t.length(dim)
    fail_unless(n % 2 == 0, f"size {n} of {d} is odd")
    half = n // 2
    a = t.with_df(t.df.filter(F.col(d) < half))
    b = t.with_df(t.df.filter(F.col(d) >= half).withColumn(d, F.col(d) - half))
    sizes = {d: half}
    return binary(a.with_sizes(**sizes), b.with_sizes(**sizes), expression=lambda x, y: x * UNARY["sigmoid"](y))


def dropout(t: Tensor, p: float, seed: int = 0, over: list[str] | None = None) -> Tensor:
    """Each cell (or, with `over`, each slice with these coordinates) is 0 with probability p, else scaled by 1 / (1 - p)."""
    fail_unless(0 <= p < 1, f"probability {p}")
    t = t if t.fill == 0 else t.dense()
    u = F.pmod(F.xxhash64(F.lit(seed), *(over or t.dims)), F.lit(1 << 30)) / float(1 << 30)
    return t.map(lambda v: F.when(u < p, 0.0).otherwise(v / (1 - p)))


#: Lower limit of the self-normalising activation: minus its scale times its alpha.
ALPHA_LIMIT = -1.0507009873554805 * 1.6732632423543772


def alpha_dropout(t: Tensor, p: float, seed: int = 0, over: list[str] | None = None) -> Tensor:
    """Each cell (or slice) takes the activation's lower limit with probability p; all are then scaled and shifted so that a
    mean of 0 and a variance of 1 stay."""
    fail_unless(0 <= p < 1, f"probability {p}")
    t = t.dense()
    u = F.pmod(F.xxhash64(F.lit(seed), *(over or t.dims)), F.lit(1 << 30)) / float(1 << 30)
    a = ((1 - p) * (1 + p * ALPHA_LIMIT**2)) ** -0.5
    return t.map(lambda v: F.when(u < p, F.lit(ALPHA_LIMIT)).otherwise(v) * a - a * ALPHA_LIMIT * p, fill=None)


def spread(t: Tensor, new: dict[str, int], first: bool = False) -> Tensor:
    """t repeated along new dims, row by row: no shuffle."""
    out = t.df
    for d, n in new.items():
        fail_unless(d not in t.dims, f"dim {d} is there")
        out = out.withColumn(d, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))) if n else out.limit(0).withColumn(d, F.lit(0).cast("long"))
    dims = (*new, *t.dims) if first else (*t.dims, *new)
    sizes = (*new.values(), *t.sizes) if first else (*t.sizes, *new.values())
    return Tensor(out.select(*dims, "value"), dims, sizes, t.fill)


def broadcast_to(t: Tensor, target: dict[str, int]) -> Tensor:
    """t with the target's dims; -1 keeps a size, 1 stretches, anything else must agree."""
    fail_unless(set(t.dims) <= set(target), f"{t.dims} are not all in {list(target)}")
    out, stretch, sizes = t.df, {}, {}
    for d, n in target.items():
        own = t.size(d) if d in t.dims else 1
        fail_unless(n != -1 or d in t.dims, f"size -1 of the new dim {d}")
        n = own if n == -1 else n
        fail_unless(own is None or own in (1, n), f"size {own} of {d} does not become {n}")
        sizes[d] = n
        if d not in t.dims:
            stretch[d] = n
        elif own == 1 and n != 1:
            out = out.drop(d)
            stretch[d] = n
    base = Tensor(out, tuple(d for d in t.dims if d not in stretch), tuple(t.size(d) for d in t.dims if d not in stretch), t.fill)
    wide = spread(base, stretch)
    return wide.with_df(wide.df, tuple(target), tuple(sizes.values()))


def broadcast_arrays(*tensors: Tensor) -> list[Tensor]:
    """Every input at the common shape."""
    target: dict[str, int] = {}
    for t in tensors:
        for d, n in zip(t.dims, t.measured, strict=True):
            target[d] = n if d not in target else join_sizes(d, target[d], n)
    return [broadcast_to(t, target) for t in tensors]


def total(tensors: list[Tensor]) -> Tensor:
    return fold(lambda a, b: binary(a, b, "add"), tensors)


def position(t: Tensor) -> Column:
    return linear(t.dims, t.measured)

