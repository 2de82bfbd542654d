"""Operators along an axis: running totals, sorting, ranking, softmax and normalisers, windows, pooling and convolution."""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tensor import Tensor, fail_unless
from . import segments
from .broadcast import binary
from .reduce import aggregates
from .reshape import flatten, pad
from .segments import RUNNING, placed, running_total

WIDE = 16  # cells of a window from which running totals pay
SMALL = 1_000_000  # cells of a table that is sent to every task


def running(t: Tensor, axis, how: str) -> Tensor:
    """A running total along a dim with a named operation; without an axis, over the flattened cells."""
    fail_unless(how in RUNNING, f"unknown operation {how}")
    if axis is None:
        t, axis = flatten(t), 0
    d = t.name(axis)
    t = t.dense()
    totals = running_total(t.df, t.others(d), [d], "value", "sum_", how, small=t.length(d) <= segments.ONE_TASK)
    return t.with_df(totals.withColumn("value", F.col("sum_")))


def associative_scan(t: Tensor, axis, combine) -> Tensor:
    """A running combination along a dim under a user's associative operation on numpy arrays."""
    d = t.name(axis)
    t = t.dense()
    return t.with_df(segments.associative_scan(t.df, t.others(d), [d], ["value"], lambda a, b: [combine(a[0], b[0])]))


def cumsum(t: Tensor, axis=None) -> Tensor:
    return running(t, axis, "sum")


def cumprod(t: Tensor, axis=None) -> Tensor:
    return running(t, axis, "prod")


def sort_with_positions(t: Tensor, axis=-1, descending: bool = False) -> tuple[Tensor, Tensor]:
    """(values, old positions) in order along a dim; equal values keep their order."""
    t = t.dense()
    d = t.name(axis)
    rest = t.others(d)
    value = F.desc("value") if descending else F.asc("value")
    rows = placed(t.df, rest, [value, F.asc(d)], small=t.length(d) <= segments.ONE_TASK)
    cut = lambda c: Tensor(rows.select(*rest, F.col("r_").alias(d), c.alias("value")).select(*t.dims, "value"), t.dims, t.sizes, None)
    return cut(F.col("value")), cut(F.col(d))


def sort(t: Tensor, axis=-1, descending: bool = False) -> Tensor:
    return sort_with_positions(t, axis, descending)[0]


def argsort(t: Tensor, axis=-1, descending: bool = False) -> Tensor:
    return sort_with_positions(t, axis, descending)[1]


def sort_key_val(keys: Tensor, values: Tensor, axis=-1) -> tuple[Tensor, Tensor]:
    """Both sorted by the keys."""
    from .index import take_along

    ordered, at = sort_with_positions(keys, axis)
    return ordered, take_along(values, at, axis)


def top_k(t: Tensor, k: int, axis=-1, largest: bool = True) -> tuple[Tensor, Tensor]:
    """(values, positions) of the k largest or smallest along a dim; the earlier position first on ties."""
    d = t.name(axis)
    n = t.size(d)
    fail_unless(k >= 0 and (n is None or k <= n), f"k = {k} of size {n}")
    t = t.dense()
    rest = t.others(d)
    value = F.desc("value") if largest else F.asc("value")
    if rest:
        kept = t.df.withColumn("r_", F.row_number().over(Window.partitionBy(*rest).orderBy(value, d))).filter(F.col("r_") <= k)
    else:  # the limit keeps k rows of each task, then k rows in all
        kept = t.df.orderBy(value, d).limit(k).withColumn("r_", F.row_number().over(Window.orderBy(value, d)))
    kept = kept.withColumn("r_", (F.col("r_") - 1).cast("long"))
    sizes = [k if x == d else s for x, s in zip(t.dims, t.sizes, strict=True)]
    cut = lambda c: Tensor(kept.select(*rest, F.col("r_").alias(d), c.alias("value")).select(*t.dims, "value"), t.dims, sizes, None)
    return cut(F.col("value")), cut(F.col(d))


def ranks(t: Tensor, axis, kind: str = "rank", descending: bool = False, step: int = 1) -> Tensor:
    """Ranks along a dim (rank, dense_rank, row_number), or differences to the cell `step` before or after (lag, lead)."""
    t = t.dense()
    d = t.name(axis)
    rest = t.others(d)
    if kind in ("lag", "lead"):
        near = t.df.select(*rest, (F.col(d) + (step if kind == "lag" else -step)).alias(d), F.col("value").alias("near_"))
        change = F.col("value") - F.col("near_") if kind == "lag" else F.col("near_") - F.col("value")
        return t.with_df(t.df.join(near, list(t.dims), "left").withColumn("value", change))
    order = F.desc("value") if descending else F.asc("value")
    by_value = Window.partitionBy(*rest).orderBy(order)
    forms = {"rank": lambda: F.rank().over(by_value), "dense_rank": lambda: F.dense_rank().over(by_value), "row_number": lambda: F.row_number().over(Window.partitionBy(*rest).orderBy(order, d))}
    fail_unless(kind in forms, f"unknown rank {kind}")
    if rest and t.length(d) <= segments.ONE_TASK:
        return t.with_df(t.df.withColumn("value", forms[kind]()))
    by = segments.Sorted(t.df, *rest, order, d)
    rows = by.places(by.rows, rest, "r_") if kind != "dense_rank" else by.rows
    if kind != "row_number":
        rows = by.places(rows, [*rest, "value"], "tie_")
    if kind == "dense_rank":
        rows = by.running(rows, rest, "sum", (F.col("tie_") == 0).cast("long"), "r_")
    return t.with_df(rows.withColumn("value", {"row_number": F.col("r_") + 1, "rank": F.col("r_") + 1 - F.col("tie_") if kind == "rank" else F.lit(0), "dense_rank": F.col("r_")}[kind]))


def with_totals(df: DataFrame, keys: list, *totals: Column) -> DataFrame:
    """df with aggregates of each row's group, combined on the map side before they are joined back, so that no task holds
    a group, however large; without keys one row is sent to every task."""
    if not keys:
        return df.crossJoin(F.broadcast(df.agg(*totals)))
    named = {f"g{i}_": k if isinstance(k, Column) else F.col(k) for i, k in enumerate(keys)}
    rows = df.withColumns(named)
    return rows.join(rows.groupBy(*named).agg(*totals), list(named)).drop(*named)


def softmax(t: Tensor, axis=-1, log: bool = False, negative: bool = False) -> Tensor:
    """Exponentials over their sum along a dim, shifted by the largest; `negative` gives softmin."""
    t = t.dense()
    keys = t.others(axis)
    x = -F.col("value") if negative else F.col("value")
    shifted = with_totals(t.df.withColumn("x_", x), keys, F.max("x_").alias("top_")).withColumn("x_", F.col("x_") - F.col("top_"))
    whole = with_totals(shifted, keys, F.sum(F.exp("x_")).alias("total_"))
    return t.with_df(whole.withColumn("value", F.col("x_") - F.log("total_") if log else F.exp("x_") / F.col("total_")))


def normalise(t: Tensor, axis, eps: float = 1e-5, kind: str = "standard", group: Column | None = None) -> Tensor:
    """(x - mean) / sqrt(var + eps) over dims ('standard'), x over its root mean square ('rms') or over its L2 norm ('l2').

    Layer, batch, group and instance forms differ only in the dims given; `group` splits a kept dim into groups.
    """
    t = t.dense()
    gone = t.names(axis)
    keys = [F.col(d) for d in t.dims if d not in gone] + ([group] if group is not None else [])
    v = F.col("value")
    forms = {
        "standard": ([F.avg(v).alias("mean_"), F.var_pop(v).alias("var_")], (v - F.col("mean_")) / F.sqrt(F.col("var_") + eps)),
        "rms": ([F.avg(v * v).alias("square_")], v / F.sqrt(F.col("square_") + eps)),
        "l2": ([F.sum(v * v).alias("square_")], v / F.greatest(F.sqrt("square_"), F.lit(eps))),
    }
    fail_unless(kind in forms, f"unknown form {kind}")
    totals, value = forms[kind]
    return t.with_df(with_totals(t.df, keys, *totals).withColumn("value", value))


def group_norm(t: Tensor, groups: int, channel, axis, eps: float = 1e-5) -> Tensor:
    c, n = t.name(channel), t.length(channel)
    fail_unless(n % groups == 0, f"{n} channels in {groups} groups")
    return normalise(t, [*t.names(axis), c], eps, group=F.floor(F.col(c) / (n // groups)))


def local_response_norm(t: Tensor, channel, size: int, alpha: float = 1e-4, beta: float = 0.75, k: float = 1.0) -> Tensor:
    """x over (k + alpha * mean of squares of the channels around) ** beta; absent channels count as 0."""
    t = t.dense()
    c = t.name(channel)
    w = Window.partitionBy(*t.others(c)).orderBy(c).rangeBetween(-(size // 2), (size - 1) // 2)
    return t.with_df(t.df.withColumn("value", F.col("value") / F.pow(k + alpha * F.sum(F.col("value") ** 2).over(w) / size, F.lit(beta))))


def window_count(n: int, size: int, stride: int, low: int, high: int, dilation: int = 1, ceil_mode: bool = False) -> int:
    reach = (size - 1) * dilation + 1
    room = n + low + high - reach
    count = (-(-room // stride) if ceil_mode else room // stride) + 1
    if ceil_mode and (count - 1) * stride >= n + low:
        count -= 1
    return max(0, count)


def padding_of(n: int, size: int, stride: int, padding, dilation: int = 1) -> tuple[int, int]:
    if padding == "VALID":
        return 0, 0
    if padding == "SAME":
        need = max(0, (-(-n // stride) - 1) * stride + (size - 1) * dilation + 1 - n)
        return need // 2, need - need // 2
    return (padding, padding) if isinstance(padding, int) else tuple(padding)


@dataclass(frozen=True)
class Along:
    """Windows along a dim of n cells: their size, stride, dilation and number; window o starts at o * stride - low."""

    n: int
    window: int
    stride: int
    low: int
    dilation: int
    count: int


def reduce_window(t: Tensor, windows: dict[str, int], strides: dict[str, int] | None = None, padding=None, how: str = "max", dilation: dict[str, int] | None = None, ceil_mode: bool = False, count_padding: bool = False) -> Tensor:
    """An aggregate over the window at each output cell. padding: VALID, SAME, or by dim a number or a pair.

    Small windows send each cell to the windows that hold it; sums and extremes combine on the map side. Where a window of a
    sum, mean or extreme has more than WIDE cells, dims are taken one after the other, and one of more than WIDE cells from two
    running totals a cell (`by_blocks`), so its cost does not grow with it. With count_padding a mean divides by the window's size.
    """
    t = t.dense()
    strides, dilation = strides or windows, dilation or {}
    shape = {}
    for d, w in windows.items():
        n, s, e = t.length(d), strides.get(d, w), dilation.get(d, 1)
        fail_unless(w > 0 and s > 0 and e > 0, f"window {w}, stride {s}, dilation {e}")
        given = padding if padding is None or isinstance(padding, str) else padding.get(d, 0)
        lo, hi = padding_of(n, w, s, given or 0, e)
        count = window_count(n, w, s, lo, hi, e, ceil_mode)
        fail_unless(count > 0, f"window of {w} in size {n} of {d}")
        shape[d] = Along(n, w, s, lo, e, count)
    sizes = [shape[d].count if d in shape else s for d, s in zip(t.dims, t.sizes, strict=True)]
    whole = float(prod(windows.values()))
    if how in (*RUNNING, "mean") and whole > WIDE:
        out = t.df
        for d, a in shape.items():
            out = (by_blocks if a.window > WIDE and a.dilation == 1 else by_cells)(out, t.dims, d, a, "sum" if how == "mean" else how)
        if how == "mean":
            cells = F.lit(whole)
            if not count_padding:
                for i, (d, a) in enumerate(shape.items()):
                    cells = inside(F.col(d), a) if i == 0 else cells * inside(F.col(d), a)
            out = out.withColumn("value", F.col("value") / cells)
        return Tensor(out.select(*t.dims, "value"), t.dims, sizes, None)
    out = t.df
    for d, a in shape.items():
        out = exploded(out, d, a)
    agg = F.sum("value") / whole if how == "mean" and count_padding else aggregates()[how]
    return Tensor(out.groupBy(*t.dims).agg(agg.alias("value")), t.dims, sizes, None)


def exploded(df: DataFrame, d: str, a: Along) -> DataFrame:
    """Every cell for each window that holds it, d being the window."""
    first = F.col(d) + a.low - F.col("k_") * a.dilation
    out = df.withColumn("k_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(a.window - 1).cast("long"))))
    return out.filter((first % a.stride == 0) & (first >= 0) & (first < a.count * a.stride)).withColumn(d, (first / a.stride).cast("long")).drop("k_")


def by_cells(df: DataFrame, dims, d: str, a: Along, how: str) -> DataFrame:
    return exploded(df, d, a).groupBy(*dims).agg(RUNNING[how]("value").alias("value"))


def by_blocks(df: DataFrame, dims, d: str, a: Along, how: str) -> DataFrame:
    """Windows along one dim from blocks as long as the window: a window reaches over two blocks at most, so it is what its first
    cell has up to its block's end, and what its last cell has from its block's start. Each cell gives two rows whatever the
    window, and a task holds blocks, not slices."""
    rest = [x for x in dims if x != d]
    block = Window.partitionBy(*rest, F.floor(F.col(d) / a.window))
    upto = lambda order: RUNNING[how]("value").over(block.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("from_start_", upto(F.asc(d))).withColumn("to_end_", upto(F.desc(d)))
    at = F.col(d)
    as_first = F.when((at + a.low) % a.stride == 0, F.array((at + a.low) / a.stride)).otherwise(F.array())  # of which window it is the first cell
    last = at + a.low - a.window + 1
    beyond = F.sequence(F.greatest(F.ceil(last / a.stride), F.lit(0)).cast("long"), F.lit(a.count - 1).cast("long"))  # all that end there or behind
    none = F.array().cast("array<long>")
    as_last = F.when(at == a.n - 1, F.when(last <= (a.count - 1) * a.stride, beyond).otherwise(none)).when((last >= 0) & (last % a.stride == 0), F.array((last / a.stride).cast("long"))).otherwise(none)
    start = lambda o: o * a.stride - a.low
    reaches = F.filter(as_last, lambda o: F.floor(at / a.window) > F.floor(start(o) / a.window))
    ends = F.concat(F.transform(as_first.cast("array<long>"), lambda o: F.struct(o.alias("o"), F.col("to_end_").alias("v"))), F.transform(reaches, lambda o: F.struct(o.alias("o"), F.col("from_start_").alias("v"))))
    parts = rows.select(*rest, F.explode(ends).alias("e_")).select(*rest, F.col("e_.o").alias(d), F.col("e_.v").alias("value")).filter((F.col(d) >= 0) & (F.col(d) < a.count))
    return parts.groupBy(*dims).agg(RUNNING[how]("value").alias("value"))


def inside(o: Column, a: Along) -> Column:
    """How many cells of window o lie in the tensor."""
    start = o * a.stride - a.low
    before = F.when(start < 0, F.ceil(-start / a.dilation)).otherwise(0)
    upto = F.floor((a.n - 1 - start) / a.dilation) + 1
    return F.least(upto, F.lit(a.window)) - before


def pool(t: Tensor, size, how: str = "max", stride=None, padding: int = 0, dilation: int = 1, ceil_mode: bool = False, spatial: int = 2) -> Tensor:
    """max or mean over the last dims, the stride being the window's size unless given."""
    fail_unless(padding * 2 <= (size if isinstance(size, int) else min(size)), "padding is over half of the window")
    dims = t.dims[-spatial:]
    each = lambda x: dict(zip(dims, [x] * spatial if isinstance(x, int) else x, strict=True))
    return reduce_window(t, each(size), each(stride or size), each(padding), how, each(dilation), ceil_mode, count_padding=how == "mean")


def adaptive_pool(t: Tensor, sizes: dict[str, int], how: str = "mean") -> Tensor:
    """Bins from floor(i n / o) to ceil((i + 1) n / o): each cell goes to the bins that hold it."""
    t = t.dense()
    out = t.df
    for d, o in sizes.items():
        n = t.length(d)
        fail_unless(o > 0, f"size {o}")
        first, last = F.floor(F.col(d) * o / F.lit(n)), F.ceil((F.col(d) + 1) * o / F.lit(n)) - 1
        out = out.withColumn(d, F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return Tensor(out.groupBy(*t.dims).agg(aggregates()[how].alias("value")), t.dims, [sizes.get(d, s) for d, s in zip(t.dims, t.sizes, strict=True)], None)


def unfold(t: Tensor, axis, size: int, step: int = 1, dim: str = "window") -> Tensor:
    """Sliding windows: the dim counts windows, a new last dim their cells."""
    d, n = t.name(axis), t.length(axis)
    fail_unless(0 < size <= n and step > 0, f"windows of {size} in size {n}")
    count = (n - size) // step + 1
    at = F.col(d) - F.col(dim)
    out = t.df.withColumn(dim, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")))).filter((at % step == 0) & (at >= 0) & (at < count * step)).withColumn(d, (at / step).cast("long"))
    return Tensor(out.select(*t.dims, dim, "value"), (*t.dims, dim), (*(count if x == d else s for x, s in zip(t.dims, t.sizes, strict=True)), size), t.fill)


def im2col(t: Tensor, size: tuple[int, int], stride: int = 1, padding: int = 0, dilation: int = 1) -> Tensor:
    """(…, C, H, W) to (…, C kh kw, L): the patches of an image, channel first, window second."""
    c, h, w = t.dims[-3:]
    wide = pad(t, {h: (padding, padding), w: (padding, padding)}) if padding else t.dense()
    counts = {d: window_count(wide.length(d), k, stride, 0, 0, dilation) for d, k in zip((h, w), size, strict=True)}
    fail_unless(min(counts.values()) > 0, "the window does not fit")
    out = wide.df
    for d, k, name in zip((h, w), size, ("kh_", "kw_"), strict=True):
        at = F.col(d) - F.col(name) * dilation
        out = out.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))).filter((at % stride == 0) & (at >= 0) & (at < counts[d] * stride)).withColumn(d, (at / stride).cast("long"))
    row = (F.col(c) * size[0] + F.col("kh_")) * size[1] + F.col("kw_")
    place = F.col(h) * counts[w] + F.col(w)
    lead = t.dims[:-3]
    return Tensor(out.select(*lead, row.alias("patch"), place.alias("place"), "value"), (*lead, "patch", "place"), (*t.sizes[:-3], t.length(c) * size[0] * size[1], counts[h] * counts[w]), None)


def col2im(t: Tensor, image: tuple[int, int], size: tuple[int, int], stride: int = 1, padding: int = 0, dilation: int = 1) -> Tensor:
    """The sum of all patches at their places: the inverse form of im2col."""
    k = size[0] * size[1]
    across = window_count(image[1], size[1], stride, padding, padding, dilation)
    down = window_count(image[0], size[0], stride, padding, padding, dilation)
    fail_unless(t.size(-1) in (None, across * down), f"{t.size(-1)} patches, {across * down} places")
    fail_unless(t.length(-2) % k == 0, "patch size does not divide")
    p, q = F.col(t.dims[-2]), F.col(t.dims[-1])
    y = F.floor(q / across) * stride + F.floor(p % k / size[1]) * dilation - padding
    x = q % across * stride + p % size[1] * dilation - padding
    lead = t.dims[:-2]
    out = t.df.select(*lead, F.floor(p / k).cast("long").alias("channel"), y.cast("long").alias("row"), x.cast("long").alias("column"), "value")
    inside = out.filter(f"row >= 0 AND row < {image[0]} AND column >= 0 AND column < {image[1]}")
    dims = (*lead, "channel", "row", "column")
    return Tensor(inside.groupBy(*dims).agg(F.sum("value").alias("value")), dims, (*t.sizes[:-2], t.length(-2) // k, *image), 0.0)


def sent(df: DataFrame, t: Tensor) -> DataFrame:
    """df, sent to every task where t has at most SMALL cells."""
    return F.broadcast(df) if prod(t.measured) <= SMALL else df


def convolve(x: Tensor, kernel: Tensor, stride: int = 1, padding=0, dilation: int = 1, groups: int = 1, bias: Tensor | None = None) -> Tensor:
    """(…, C, spatial…) with a kernel (O, C / groups, spatial…): cross-correlation, as the array libraries have it.

    A kernel of at most SMALL cells is sent to every task, a larger one is joined; products are summed per output cell.
    """
    spatial = kernel.rank - 2
    fail_unless(spatial >= 1 and x.rank >= spatial + 1, f"kernel of rank {kernel.rank} on rank {x.rank}")
    space, c = x.dims[-spatial:], x.dims[-spatial - 1]
    channels, outs = x.length(c), kernel.length(0)
    fail_unless(channels % groups == 0 and outs % groups == 0 and kernel.length(1) == channels // groups, f"{channels} channels, {groups} groups, kernel {kernel.measured}")
    k = kernel.df.toDF("o_", "c_", *(f"k{i}_" for i in range(spatial)), "w_")
    both = x.df.withColumn("c_", F.col(c) % (channels // groups)).withColumn("g_", F.floor(F.col(c) / (channels // groups))).join(sent(k, kernel), "c_").filter(F.floor(F.col("o_") / (outs // groups)) == F.col("g_"))
    sizes = []
    for i, d in enumerate(space):
        n, w = x.length(d), kernel.length(2 + i)
        lo, hi = padding_of(n, w, stride, padding.upper() if isinstance(padding, str) else padding, dilation)
        count = window_count(n, w, stride, lo, hi, dilation)
        fail_unless(count > 0, f"kernel of {w} in size {n}")
        sizes.append(count)
        at = F.col(d) + lo - F.col(f"k{i}_") * dilation
        both = both.filter((at % stride == 0) & (at >= 0) & (at < count * stride)).withColumn(d, (at / stride).cast("long"))
    lead = x.dims[: -spatial - 1]
    out = both.groupBy(*lead, F.col("o_").alias(c), *space).agg(F.sum(F.col("value") * F.col("w_")).alias("value"))
    t = Tensor(out.select(*x.dims, "value"), x.dims, (*x.sizes[: -spatial - 1], outs, *sizes), 0.0)
    return t if bias is None else binary(t, bias.rename(**{bias.dims[0]: c}), "add")


def convolve_transposed(x: Tensor, kernel: Tensor, stride: int = 1, padding: int = 0, output_padding: int = 0, dilation: int = 1) -> Tensor:
    """(…, C, spatial…) with a kernel (C, O, spatial…): every cell adds its scaled kernel to the output."""
    spatial = kernel.rank - 2
    space, c = x.dims[-spatial:], x.dims[-spatial - 1]
    fail_unless(kernel.length(0) == x.length(c), f"{x.length(c)} channels, kernel {kernel.measured}")
    k = kernel.df.toDF("c_", "o_", *(f"k{i}_" for i in range(spatial)), "w_")
    both = x.df.withColumnRenamed(c, "c_").join(sent(k, kernel), "c_")
    sizes = []
    for i, d in enumerate(space):
        n = (x.length(d) - 1) * stride - 2 * padding + dilation * (kernel.length(2 + i) - 1) + output_padding + 1
        fail_unless(n > 0, f"size {n}")
        sizes.append(n)
        both = both.withColumn(d, F.col(d) * stride - padding + F.col(f"k{i}_") * dilation).filter(f"`{d}` >= 0 AND `{d}` < {n}")
    out = both.groupBy(*x.dims[: -spatial - 1], F.col("o_").alias(c), *space).agg(F.sum(F.col("value") * F.col("w_")).alias("value"))
    return Tensor(out.select(*x.dims, "value"), x.dims, (*x.sizes[: -spatial - 1], kernel.length(1), *sizes), 0.0)


