"""Shape transforms: index arithmetic on coordinates, without a shuffle except where cells are copied from a grid."""

from __future__ import annotations

import re
from math import prod

from pyspark.sql import functions as F

from ..tensor import ShapeError, Tensor, fail_unless, fresh, grid, linear
from .broadcast import spread
from .reduce import reduce


def split_index(position, dims: list[str], sizes: list[int]) -> dict:
    """Columns that give row-major coordinates back from a position."""
    out, left = {}, prod(sizes)
    for d, s in zip(dims, sizes, strict=True):
        left //= max(1, s)
        out[d] = (F.floor(position / F.lit(max(1, left))) % max(1, s)).cast("long")
    return out


def reshape(t: Tensor, sizes: dict[str, int]) -> Tensor:
    """The same cells in row-major order under new dims; one size may be -1."""
    total = prod(t.measured)
    unknown = [d for d, s in sizes.items() if s == -1]
    fail_unless(len(unknown) <= 1, "only one size may be -1")
    known = prod(s for s in sizes.values() if s != -1)
    if unknown:
        fail_unless(known > 0 and total % known == 0, f"{total} cells do not divide by {known}")
        sizes = {d: total // known if s == -1 else s for d, s in sizes.items()}
    fail_unless(prod(sizes.values()) == total, f"{total} cells do not fit {sizes}")
    out = t.df.select(linear(t.dims, t.measured).alias("at_"), "value")
    new = split_index(F.col("at_"), list(sizes), list(sizes.values()))
    return Tensor(out.select(*(c.alias(d) for d, c in new.items()), "value"), tuple(sizes), tuple(sizes.values()), t.fill)


def resize(t: Tensor, sizes: dict[str, int]) -> Tensor:
    """The data repeated to fill a new shape."""
    n = prod(t.measured)
    fail_unless(n > 0, "nothing to repeat")
    cells = grid(t.spark, sizes)
    target = cells.withColumn("at_", linear(list(sizes), list(sizes.values())) % n)
    source = t.dense().df.select(linear(t.dims, t.measured).alias("at_"), "value")
    return Tensor(target.join(source, "at_").select(*sizes, "value"), tuple(sizes), tuple(sizes.values()), None)


def flatten(t: Tensor, start: int = 0, end: int = -1, dim: str = "flat") -> Tensor:
    """Dims from start to end become one."""
    if not t.rank:
        return Tensor(t.df.select(F.lit(0).cast("long").alias(dim), "value"), (dim,), (1,), t.fill)
    a, b = t.axis(start), t.axis(end)
    fail_unless(a <= b, "start is after end")
    name = t.dims[a] if a == b else fresh(dim, (*t.dims[:a], *t.dims[b + 1 :]))
    merged = t.df.withColumn("at_", linear(t.dims[a : b + 1], t.measured[a : b + 1]))
    out = merged.select(*t.dims[:a], F.col("at_").alias(name), *t.dims[b + 1 :], "value")
    return Tensor(out, (*t.dims[:a], name, *t.dims[b + 1 :]), (*t.sizes[:a], prod(t.measured[a : b + 1]), *t.sizes[b + 1 :]), t.fill)


def unflatten(t: Tensor, dim: str | int, sizes: dict[str, int]) -> Tensor:
    d, n = t.name(dim), t.length(dim)
    if -1 in sizes.values():
        known = prod(s for s in sizes.values() if s != -1)
        fail_unless(known and n % known == 0, f"{n} does not divide by {known}")
        sizes = {k: n // known if s == -1 else s for k, s in sizes.items()}
    fail_unless(prod(sizes.values()) == n, f"{n} does not split into {sizes}")
    parts = split_index(F.col(d), list(sizes), list(sizes.values()))
    k = t.axis(d)
    dims = (*t.dims[:k], *sizes, *t.dims[k + 1 :])
    out = t.df.select(*t.dims[:k], *(c.alias(x) for x, c in parts.items()), *t.dims[k + 1 :], "value")
    return Tensor(out, dims, (*t.sizes[:k], *sizes.values(), *t.sizes[k + 1 :]), t.fill)


def transpose(t: Tensor, axes: list | None = None) -> Tensor:
    """Dims in a new order: only the columns move."""
    order = list(reversed(t.dims)) if axes is None else t.names(axes)
    fail_unless(len(order) == t.rank, f"{len(order)} axes for rank {t.rank}")
    return t.with_df(t.df, order)


def swapaxes(t: Tensor, a, b) -> Tensor:
    i, j = t.axis(a), t.axis(b)
    order = list(t.dims)
    order[i], order[j] = order[j], order[i]
    return transpose(t, order)


def moveaxis(t: Tensor, source, destination) -> Tensor:
    source, destination = ([source], [destination]) if isinstance(source, (int, str)) else (source, destination)
    moved = t.names(source)
    fail_unless(len(moved) == len(destination), "as many places as dims")
    order = [d for d in t.dims if d not in moved]
    for at, d in sorted((t.axis(x), m) for x, m in zip(destination, moved, strict=True)):
        order.insert(at, d)
    return transpose(t, order)


def rollaxis(t: Tensor, axis, start: int = 0) -> Tensor:
    k = t.axis(axis)
    fail_unless(-t.rank <= start <= t.rank, "start is out of range")
    start = start + t.rank if start < 0 else start
    order = [d for d in t.dims if d != t.dims[k]]
    order.insert(start - (k < start), t.dims[k])
    return transpose(t, order)


def expand_dims(t: Tensor, at: int, dim: str) -> Tensor:
    fail_unless(-t.rank - 1 <= at <= t.rank, "place is out of range")
    at = at + t.rank + 1 if at < 0 else at
    fail_unless(dim not in t.dims, f"dim {dim} is there")
    dims = [*t.dims[:at], dim, *t.dims[at:]]
    return t.with_df(t.df.withColumn(dim, F.lit(0).cast("long")), dims, [*t.sizes[:at], 1, *t.sizes[at:]])


def squeeze(t: Tensor, axis=None, lenient: bool = False) -> Tensor:
    """Drops dims of size 1; a dim of another size is refused, or with `lenient` kept."""
    asked = [d for d in t.dims if t.size(d) == 1] if axis is None else t.names(axis)
    bad = [d for d in asked if t.length(d) != 1]
    fail_unless(lenient or not bad, f"size of {bad} is not 1")
    kept = [d for d in t.dims if d not in asked or d in bad]
    return t.with_df(t.df, kept)


def atleast(t: Tensor, rank: int) -> Tensor:
    """(n) to (1, n), to (1, n, 1); (m, n) to (m, n, 1)."""
    if t.rank == 0:
        t = expand_dims(t, 0, "d0")
    if t.rank < 2 <= rank:
        t = expand_dims(t, 0, fresh("d0", t.dims))
    if t.rank < 3 <= rank:
        t = expand_dims(t, 2, fresh("d2", t.dims))
    return t


def flip(t: Tensor, axis=None) -> Tensor:
    out = t.df
    for d in t.names(axis):
        out = out.withColumn(d, F.lit(t.length(d) - 1) - F.col(d))
    return t.with_df(out)


def roll(t: Tensor, shift: int, axis=None) -> Tensor:
    """Indices move around; without an axis, the flattened cells do."""
    if axis is None:
        sizes = dict(zip(t.dims, t.measured, strict=True))
        return reshape(roll(flatten(t), shift, 0), sizes)
    d = t.name(axis)
    return t.with_df(t.df.withColumn(d, F.pmod(F.col(d) + shift, F.lit(t.length(d)))))


def fftshift(t: Tensor, axis=None, inverse: bool = False) -> Tensor:
    for d in t.names(axis):
        n = t.length(d)
        t = roll(t, -(n // 2) if inverse else n // 2, d)
    return t


def rot90(t: Tensor, k: int = 1, axes=(0, 1)) -> Tensor:
    i, j = t.name(axes[0]), t.name(axes[1])
    fail_unless(i != j, "two dims are needed")
    k %= 4
    if k == 0:
        return t
    if k == 2:
        return flip(t, [i, j])
    a, b = (i, j) if k == 1 else (j, i)
    n = t.length(b)
    out = t.df.select(*(F.col(d) for d in t.dims if d not in (i, j)), (F.lit(n - 1) - F.col(b)).alias(a), F.col(a).alias(b), "value")
    sizes = {d: t.size(d) for d in t.dims} | {i: t.size(j), j: t.size(i)}
    return Tensor(out.select(*t.dims, "value"), t.dims, [sizes[d] for d in t.dims], t.fill)


def pad(t: Tensor, widths: dict[str, tuple[int, int]], mode: str = "constant", value: float = 0.0, interior: dict[str, int] | None = None) -> Tensor:
    """Cells before and after each dim: constant, edge, reflect, symmetric or wrap; `interior` puts cells between."""
    fail_unless(mode in ("constant", "edge", "reflect", "symmetric", "wrap"), f"unknown mode {mode}")
    interior = interior or {}
    sizes, shifted = {}, t.df
    for d in t.dims:
        n, (lo, hi), gap = t.length(d), widths.get(d, (0, 0)), interior.get(d, 0)
        fail_unless(mode == "constant" or (min(lo, hi) >= 0 and not gap), "only constant padding may be negative or interior")
        fail_unless(mode != "reflect" or max(lo, hi) < n, f"reflection of {max(lo, hi)} in size {n}")
        sizes[d] = lo + hi + n + gap * max(0, n - 1)
        fail_unless(sizes[d] >= 0, f"padding makes the size of {d} negative")
        if mode == "constant":
            shifted = shifted.withColumn(d, F.col(d) * (gap + 1) + lo).filter(f"`{d}` >= 0 AND `{d}` < {sizes[d]}")
    if mode == "constant":
        return Tensor(shifted.select(*t.dims, "value"), t.dims, list(sizes.values()), value).dense() if t.fill is None or t.fill != value else Tensor(shifted.select(*t.dims, "value"), t.dims, list(sizes.values()), value)
    cells = grid(t.spark, sizes)
    back = {}
    for d in t.dims:
        n, at = t.length(d), F.col(d) - widths.get(d, (0, 0))[0]
        back[d] = {
            "edge": F.least(F.greatest(at, F.lit(0)), F.lit(n - 1)),
            "wrap": F.pmod(at, F.lit(n)),
            "reflect": F.lit(n - 1) - F.abs(F.lit(n - 1) - F.pmod(at, F.lit(max(1, 2 * n - 2)))),
            "symmetric": F.least(F.pmod(at, F.lit(2 * n)), F.lit(2 * n - 1) - F.pmod(at, F.lit(2 * n))),
        }[mode]
    target = cells.select(*(F.col(d) for d in t.dims), *(c.alias(f"{d}__") for d, c in back.items()))
    source = t.dense().df.select(*(F.col(d).alias(f"{d}__") for d in t.dims), "value")
    return Tensor(target.join(source, [f"{d}__" for d in t.dims]).select(*t.dims, "value"), t.dims, list(sizes.values()), None)


def torch_pad(t: Tensor, widths: list[int], mode: str = "constant", value: float = 0.0) -> Tensor:
    """Widths from the last dim backwards, before and after."""
    fail_unless(len(widths) % 2 == 0 and len(widths) <= 2 * t.rank, f"{len(widths)} widths for rank {t.rank}")
    named = {t.dims[-1 - k]: (widths[2 * k], widths[2 * k + 1]) for k in range(len(widths) // 2)}
    return pad(t, named, {"replicate": "edge", "circular": "wrap"}.get(mode, mode), value)


def insert(t: Tensor, at: int, new: Tensor, axis) -> Tensor:
    """new's slices before position `at` of a dim."""
    d = t.name(axis)
    n, m = t.length(d), new.length(d)
    fail_unless(-n <= at <= n, f"position {at} of size {n}")
    at = at + n if at < 0 else at
    moved = t.df.withColumn(d, F.when(F.col(d) >= at, F.col(d) + m).otherwise(F.col(d)))
    out = moved.unionByName(new.df.withColumn(d, F.col(d) + at))
    return t.with_df(out, sizes=[n + m if x == d else s for x, s in zip(t.dims, t.sizes, strict=True)])


def delete(t: Tensor, at: list[int], axis) -> Tensor:
    """Without the slices at the given positions; the others close up."""
    d, n = t.name(axis), t.length(axis)
    gone = sorted({i + n if i < 0 else i for i in at})
    fail_unless(all(0 <= i < n for i in gone), f"positions {at} of size {n}")
    before = sum((F.when(F.col(d) > i, 1).otherwise(0) for i in gone), F.lit(0))
    out = t.df.filter(~F.col(d).isin(gone)).withColumn(d, (F.col(d) - before).cast("long")) if gone else t.df
    return t.with_df(out, sizes=[n - len(gone) if x == d else s for x, s in zip(t.dims, t.sizes, strict=True)])


def tile(t: Tensor, reps: dict[str, int], new: dict[str, int] | None = None) -> Tensor:
    """The whole repeated along dims, and along new leading dims."""
    out, sizes = t.df, []
    for d, s in zip(t.dims, t.measured, strict=True):
        r = reps.get(d, 1)
        fail_unless(r >= 0, "negative repeats")
        if r != 1:
            copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(r - 1).cast("long")))
            out = out.withColumn("r_", copies).withColumn(d, F.col("r_") * s + F.col(d)).drop("r_") if r else out.limit(0)
        sizes.append(s * r)
    wide = Tensor(out.select(*t.dims, "value"), t.dims, sizes, t.fill)
    return spread(wide, new, first=True) if new else wide


def repeat(t: Tensor, n, axis) -> Tensor:
    """Each slice n times in a row; with a tensor of counts over the dim, each as often as told, and the size unknown."""
    d = t.name(axis)
    if isinstance(n, Tensor):
        from .window import running

        counts = n.rename(**{n.dims[0]: d})
        ends = running(counts, d, "sum").df.withColumnRenamed("value", "end_")
        plan = counts.df.withColumnRenamed("value", "n_").join(ends, d).filter("n_ > 0")
        out = t.df.join(plan, d).withColumn(d, F.explode(F.sequence((F.col("end_") - F.col("n_")).cast("long"), (F.col("end_") - 1).cast("long"))))
        return t.with_df(out, sizes=[None if x == d else s for x, s in zip(t.dims, t.sizes, strict=True)])
    fail_unless(n >= 0, "negative repeats")
    out = t.df.withColumn("r_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).withColumn(d, F.col(d) * n + F.col("r_")) if n else t.df.limit(0)
    return t.with_df(out, sizes=[(None if s is None else s * n) if x == d else s for x, s in zip(t.dims, t.sizes, strict=True)])


def parse_side(side: str) -> list[list[str]]:
    tokens = re.findall(r"\(|\)|\.\.\.|\w+", side)
    fail_unless("".join(tokens) == side.replace(" ", ""), f"cannot read {side!r}")
    out, group = [], None
    for x in tokens:
        if x == "(":
            fail_unless(group is None, "nested brackets")
            group = []
        elif x == ")":
            fail_unless(group is not None, "unmatched bracket")
            out.append(group)
            group = None
        elif group is not None:
            group.append(x)
        else:
            out.append([x])
    fail_unless(group is None, "unmatched bracket")
    return out


def unpack_pattern(t: Tensor, side: str, known: dict[str, int]) -> Tensor:
    """t with a dim for every name on the left side; one unknown factor of a group is found by division."""
    groups = parse_side(side)
    dots = [i for i, g in enumerate(groups) if g == ["..."]]
    fail_unless(len(dots) <= 1, "one ellipsis at most")
    if dots:
        extra = t.rank - len(groups) + 1
        fail_unless(extra >= 0, f"{side!r} for rank {t.rank}")
        groups[dots[0] : dots[0] + 1] = [[f"dots{k}"] for k in range(extra)]
    fail_unless(len(groups) == t.rank, f"{side!r} for rank {t.rank}")
    out = Tensor(t.df.toDF(*(f"g{i}_" for i in range(t.rank)), "value"), [f"g{i}_" for i in range(t.rank)], t.sizes, t.fill)
    for i, g in enumerate(groups):
        if g == ["1"] or not g:
            out = squeeze(out, f"g{i}_")
        elif len(g) == 1:
            if g[0] in known:
                fail_unless(out.size(f"g{i}_") in (None, known[g[0]]), f"size of {g[0]}")
            out = out.rename(**{f"g{i}_": g[0]})
        else:
            out = unflatten(out, f"g{i}_", {x: known.get(x, -1) for x in g})
    return out


def pack_pattern(t: Tensor, side: str) -> Tensor:
    groups = parse_side(side)
    order: list[str] = []
    for i, g in enumerate(groups):
        if g == ["..."]:
            groups[i : i + 1] = [[d] for d in t.dims if d.startswith("dots")]
            break
    for g in groups:
        order += [x for x in g if x != "1"]
    fail_unless(sorted(order) == sorted(t.dims), f"{side!r} does not name the dims {t.dims}")
    out, at = transpose(t, order), 0
    for i, g in enumerate(groups):
        g = [x for x in g if x != "1"]
        if not g:
            out = expand_dims(out, at, f"one{i}")
        elif len(g) > 1:
            out = flatten(out, at, at + len(g) - 1, "_".join(g))
        at += 1
    return out


def rearrange(t: Tensor, pattern: str, **known: int) -> Tensor:
    """Dims merged, split and permuted as in 'b n d -> b (n d)'."""
    left, arrow, right = pattern.partition("->")
    fail_unless(bool(arrow), "no arrow in the pattern")
    return pack_pattern(unpack_pattern(t, left, known), right)


def einops_reduce(t: Tensor, pattern: str, how: str, **known: int) -> Tensor:
    left, _, right = pattern.partition("->")
    out = unpack_pattern(t, left, known)
    kept = {x for g in parse_side(right) for x in g}
    gone = [d for d in out.dims if d not in kept and not (d.startswith("dots") and "..." in kept)]
    return pack_pattern(reduce(out, how, gone) if gone else out, right)


def einops_repeat(t: Tensor, pattern: str, **known: int) -> Tensor:
    left, _, right = pattern.partition("->")
    names = {x for g in parse_side(left) for x in g}
    new = [x for g in parse_side(right) for x in g if x not in names and x not in ("1", "...")]
    for x in new:
        if x not in known:
            raise ShapeError(f"no size for {x}")
    out = unpack_pattern(t, left, {k: v for k, v in known.items() if k not in new})
    return pack_pattern(spread(out, {x: known[x] for x in new}), right)


def pixel_shuffle(t: Tensor, r: int) -> Tensor:
    """(…, C r r, H, W) to (…, C, H r, W r)."""
    c, h, w = t.dims[-3:]
    fail_unless(t.length(c) % (r * r) == 0, f"{t.length(c)} channels do not divide by {r * r}")
    lead = " ".join(t.dims[:-3])
    out = rearrange(t, f"{lead} (c_ r1_ r2_) h_ w_ -> {lead} c_ (h_ r1_) (w_ r2_)", r1_=r, r2_=r)
    return Tensor(out.df.toDF(*t.dims, "value"), t.dims, out.sizes, t.fill)


def pixel_unshuffle(t: Tensor, r: int) -> Tensor:
    c, h, w = t.dims[-3:]
    fail_unless(t.length(h) % r == 0 and t.length(w) % r == 0, f"sizes do not divide by {r}")
    lead = " ".join(t.dims[:-3])
    out = rearrange(t, f"{lead} c_ (h_ r1_) (w_ r2_) -> {lead} (c_ r1_ r2_) h_ w_", r1_=r, r2_=r)
    return Tensor(out.df.toDF(*t.dims, "value"), t.dims, out.sizes, t.fill)


def interpolate(t: Tensor, sizes: dict[str, int] | None = None, scale: dict[str, float] | None = None) -> Tensor:
    """Nearest cells at new sizes, given or as floored multiples."""
    new = dict(sizes or {}) | {d: int(t.length(d) * s) for d, s in (scale or {}).items()}
    fail_unless(all(n > 0 for n in new.values()), f"sizes {new}")
    out = t.dense().df
    for d, n in new.items():
        old = t.length(d)
        # target positions i with floor(i * old / n) = source position
        first, last = F.ceil(F.col(d) * n / F.lit(old)), F.ceil((F.col(d) + 1) * n / F.lit(old)) - 1
        out = out.filter(first <= last).withColumn(d, F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return Tensor(out.select(*t.dims, "value"), t.dims, [new.get(d, t.size(d)) for d in t.dims], None)
