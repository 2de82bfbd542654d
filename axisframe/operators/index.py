"""Slicing, gathering and scattering: filters, renumbering, and joins with index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tensor import Tensor, fail_unless, fresh
from .broadcast import spread
from .reshape import expand_dims
from .segments import running_total


def resized(t: Tensor, d: str, n: int | None) -> list:
    return [n if x == d else s for x, s in zip(t.dims, t.sizes, strict=True)]


def slice_dim(t: Tensor, axis, start=None, stop=None, step: int = 1) -> Tensor:
    """Python's slice of one dim."""
    fail_unless(step != 0, "step is 0")
    d, n = t.name(axis), t.length(axis)
    a, b, s = slice(start, stop, step).indices(n)
    count = len(range(a, b, s))
    if s > 0:
        kept = t.df.filter((F.col(d) >= a) & (F.col(d) < b) & ((F.col(d) - a) % s == 0))
    else:
        kept = t.df.filter((F.col(d) <= a) & (F.col(d) > b) & ((F.lit(a) - F.col(d)) % -s == 0))
    return t.with_df(kept.withColumn(d, ((F.col(d) - a) / s).cast("long")), sizes=resized(t, d, count))


def index_dim(t: Tensor, axis, i: int) -> Tensor:
    """One slice; its dim goes."""
    d, n = t.name(axis), t.size(axis)
    if i < 0:
        n = t.length(axis)
        i += n
    fail_unless(i >= 0 and (n is None or i < n), f"index {i} of size {n}")
    return t.with_df(t.df.filter(F.col(d) == i), t.others(d))


def getitem(t: Tensor, *keys) -> Tensor:
    """x[...]: slices, integers, None for a new dim, an ellipsis, and lists of positions."""
    given = sum(k is not None and k is not Ellipsis for k in keys)
    fail_unless(given <= t.rank and keys.count(Ellipsis) <= 1, f"{given} indices for rank {t.rank}")
    if Ellipsis not in keys:
        keys = (*keys, Ellipsis)
    at = keys.index(Ellipsis)
    keys = (*keys[:at], *([slice(None)] * (t.rank - given)), *keys[at + 1 :])
    out, place, names = t, 0, iter(t.dims)
    for k in keys:
        if k is None:
            out = expand_dims(out, place, fresh("new", out.dims))
            place += 1
            continue
        d = next(names)
        if isinstance(k, int):
            out = index_dim(out, d, k)
            continue
        if isinstance(k, slice):
            if k != slice(None):
                out = slice_dim(out, d, k.start, k.stop, 1 if k.step is None else k.step)
        else:
            out = take(out, list(k), d)
        place += 1
    return out


def take(t: Tensor, at, axis) -> Tensor:
    """Slices at the given positions: a list keeps the dim, a tensor puts its own dims in the dim's place."""
    d = t.name(axis)
    if isinstance(at, list):
        n = t.length(axis)
        at = [i + n if i < 0 else i for i in at]
        fail_unless(all(0 <= i < n for i in at), f"positions {at} of size {n}")
        table = t.spark.createDataFrame([(k, i) for k, i in enumerate(at)], "new_ long, old_ long")
        out = t.df.withColumnRenamed(d, "old_").join(F.broadcast(table), "old_").withColumn(d, F.col("new_"))
        return t.with_df(out, sizes=resized(t, d, len(at)))
    fail_unless(not set(at.dims) & set(t.others(d)), "the index shares a dim with the data")
    table = at.dense().df.select(*(F.col(x).alias(f"{x}__") for x in at.dims), F.col("value").cast("long").alias("old_"))
    if t.sizes[t.axis(d)] is not None:
        table = table.withColumn("old_", F.when(F.col("old_") < 0, F.col("old_") + t.size(d)).otherwise(F.col("old_")))
    joined = t.df.withColumnRenamed(d, "old_").join(table, "old_").drop("old_")
    k = t.axis(d)
    dims = (*t.dims[:k], *at.dims, *t.dims[k + 1 :])
    out = joined.select(*(F.col(f"{x}__").alias(x) if x in at.dims else F.col(x) for x in dims), "value")
    return Tensor(out, dims, (*t.sizes[:k], *at.sizes, *t.sizes[k + 1 :]), t.fill)


def take_along(t: Tensor, at: Tensor, axis) -> Tensor:
    """The value at the index found in each cell of `at`, whose other dims are t's."""
    d = t.name(axis)
    fail_unless(set(at.dims) == set(t.dims), "the index needs the data's dims")
    table = at.dense().df.withColumnRenamed("value", "at_")
    source = t.dense().df.withColumnRenamed(d, "at_")
    rest = t.others(d)
    return Tensor(table.join(source, [*rest, "at_"]).select(*at.dims, "value"), at.dims, at.sizes, None)


def window_gather(t: Tensor, starts: DataFrame, axis, size: int, key: str = "window", offset: str = "offset") -> Tensor:
    """(key, offset, …): for each row (key, start), `size` slices from start on, the start clamped to the dim."""
    d, n = t.name(axis), t.length(axis)
    fail_unless(0 <= size <= n, f"window of {size} in size {n}")
    at = F.least(F.greatest(F.col("start"), F.lit(0)), F.lit(n - size))
    cells = starts.withColumn(offset, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")))).select(key, offset, (at + F.col(offset)).alias(d))
    dims = (key, offset, *t.others(d))
    return Tensor(t.dense().df.join(cells, d).select(*dims, "value"), dims, (None, size, *(t.size(x) for x in t.others(d))), None)


COMBINE = {"add": (F.sum, lambda a, b: a + b), "mul": (F.product, lambda a, b: a * b), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def scatter(t: Tensor, updates: Tensor, how: str = "set") -> Tensor:
    """Updates, whose coordinates may repeat, put into t: set (the largest of a cell's values), add, mul, min or max."""
    fail_unless(set(updates.dims) == set(t.dims), "updates need the data's dims")
    dims = list(t.dims)
    t = t.dense()
    if how == "set":
        new = updates.df.groupBy(*dims).agg(F.max("value").alias("value"))
        return t.with_df(t.df.join(new, dims, "left_anti").unionByName(new), fill=None)
    fail_unless(how in COMBINE, f"unknown combination {how}")
    agg, op = COMBINE[how]
    new = updates.df.groupBy(*dims).agg(agg("value").alias("new_"))
    both = t.df.join(new, dims, "full")
    value = F.when(F.col("new_").isNull(), F.col("value")).when(F.col("value").isNull(), F.col("new_")).otherwise(op(F.col("value"), F.col("new_")))
    return t.with_df(both.withColumn("value", value), fill=None)


def scatter_apply(t: Tensor, at: DataFrame, f) -> Tensor:
    """f of the values at the listed coordinates, once each."""
    marked = at.select(*t.dims).distinct().withColumn("hit_", F.lit(True))
    return t.with_df(t.dense().df.join(marked, list(t.dims), "left").withColumn("value", F.when(F.col("hit_"), f(F.col("value"))).otherwise(F.col("value"))), fill=None)


def dynamic_update_slice(t: Tensor, update: Tensor, start: dict[str, int]) -> Tensor:
    """update written over t from start on, the start clamped so that it fits."""
    out = update.dense().df
    for d in t.dims:
        n, m = t.length(d), update.length(d)
        fail_unless(m <= n, f"update of size {m} in size {n} of {d}")
        out = out.withColumn(d, F.col(d) + min(max(start.get(d, 0), 0), n - m))
    return scatter(t, Tensor(out, update.dims, update.sizes, None))


def narrow(t: Tensor, axis, start: int, length: int) -> Tensor:
    n = t.length(axis)
    start = start + n if start < 0 else start
    fail_unless(0 <= start and length >= 0 and start + length <= n, f"[{start}, {start + length}) of size {n}")
    return slice_dim(t, axis, start, start + length)


def lax_slice(t: Tensor, start: dict[str, int], limit: dict[str, int], strides: dict[str, int] | None = None) -> Tensor:
    for d in limit:
        n = t.length(d)
        fail_unless(0 <= start.get(d, 0) <= limit[d] <= n, f"[{start.get(d, 0)}, {limit[d]}) of size {n}")
        t = slice_dim(t, d, start.get(d, 0), limit[d], (strides or {}).get(d, 1))
    return t


def dynamic_slice(t: Tensor, start: dict[str, int], sizes: dict[str, int]) -> Tensor:
    for d, m in sizes.items():
        n = t.length(d)
        fail_unless(m <= n, f"slice of {m} in size {n}")
        at = min(max(start.get(d, 0), 0), n - m)
        t = slice_dim(t, d, at, at + m)
    return t


def embedding(ids: Tensor, table: Tensor) -> Tensor:
    """Each id's row of a table (id, width): appends the width."""
    fail_unless(table.rank == 2, "the table is a matrix")
    row, width = table.dims
    out = fresh(width, ids.dims)
    rows = table.df.select(F.col(row).alias("id_"), F.col(width).alias(out), F.col("value").alias("v_"))
    joined = ids.df.withColumn("id_", F.col("value").cast("long")).drop("value").join(rows, "id_")
    return Tensor(joined.select(*ids.dims, out, F.col("v_").alias("value")), (*ids.dims, out), (*ids.sizes, table.size(width)), None)


def searchsorted(a: DataFrame, values: DataFrame, column: str, side: str = "left") -> DataFrame:
    """values with `position`: how many of a's values lie before (left: below; right: not above).

    Counts per distinct value are accumulated over range-sorted data, so no task gets all rows.
    """
    fail_unless(side in ("left", "right"), f"unknown side {side}")
    counts = a.groupBy(F.col(column).alias("v_")).agg(F.count("*").alias("n_"))
    probes = values.select(F.col(column).alias("v_")).distinct().withColumn("n_", F.lit(0).cast("long"))
    steps = counts.unionByName(probes).groupBy("v_").agg(F.sum("n_").alias("n_"))
    sums = running_total(steps, [], ["v_"], "n_", "up_to_")
    position = F.col("up_to_") - F.col("n_") if side == "left" else F.col("up_to_")
    return values.join(sums, values[column] == F.col("v_")).withColumn("position", position.cast("long")).drop("v_", "n_", "up_to_")


def one_hot(t: Tensor, n: int, dim: str = "class", sparse: bool = False) -> Tensor:
    """Appends a dim of n with 1 at the value."""
    if sparse:
        out = t.df.withColumn(dim, F.col("value").cast("long")).filter(f"`{dim}` >= 0 AND `{dim}` < {n}").withColumn("value", F.lit(1.0))
        return Tensor(out.select(*t.dims, dim, "value"), (*t.dims, dim), (*t.sizes, n), 0.0)
    wide = spread(t, {dim: n})
    return wide.with_df(wide.df.withColumn("value", F.when(F.col("value") == F.col(dim), 1.0).otherwise(0.0)), fill=None)


def present(t: Tensor, coordinates: DataFrame, how: str = "left_semi") -> DataFrame:
    """The coordinates that have a cell (left_semi), or have none (left_anti)."""
    return coordinates.join(t.df.select(*t.dims), list(t.dims), how)


