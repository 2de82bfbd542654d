"""Joining and splitting: unions with shifted coordinates."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tensor import Tensor, fail_unless, fresh, grid
from .index import index_dim, slice_dim
from .reshape import atleast, expand_dims, flatten, unflatten

MOST_PIECES = 256


def concatenate(tensors: list[Tensor], axis=0, skip_empty: bool = False) -> Tensor:
    """Sizes along one dim add; the others must agree. `skip_empty` leaves out empty vectors."""
    fail_unless(bool(tensors), "nothing to join")
    if skip_empty and len(tensors) > 1:
        tensors = [t for t in tensors if not (t.rank == 1 and t.size(0) == 0)] or tensors[:1]
    if len({t.fill for t in tensors}) > 1:  # absent cells differ: all become rows
        tensors = [t.dense() for t in tensors]
    first = tensors[0]
    d = first.name(axis)
    parts, at = [], 0
    for t in tensors:
        fail_unless(t.rank == first.rank, "ranks differ")
        t = t.rename(**dict(zip(t.dims, first.dims, strict=True)))
        for x in first.others(d):
            fail_unless(None in (t.size(x), first.size(x)) or t.size(x) == first.size(x), f"sizes of {x} differ")
        parts.append(t.df.withColumn(d, F.col(d) + at).select(*first.dims, "value"))
        at += t.length(d)
    out = fold(DataFrame.unionByName, parts)
    return Tensor(out, first.dims, [at if x == d else s for x, s in zip(first.dims, first.sizes, strict=True)], first.fill)


def stack(tensors: list[Tensor], at: int = 0, dim: str = "stack") -> Tensor:
    """Equal shapes along a new dim."""
    fail_unless(bool(tensors), "nothing to stack")
    shapes = {t.sizes for t in tensors if None not in t.sizes}
    fail_unless(len(shapes) <= 1, f"shapes {shapes} differ")
    return concatenate([expand_dims(t, at, fresh(dim, t.dims)) for t in tensors], at)


def vstack(tensors: list[Tensor]) -> Tensor:
    return concatenate([atleast(t, 2) for t in tensors], 0)


def hstack(tensors: list[Tensor]) -> Tensor:
    tensors = [atleast(t, 1) for t in tensors]
    return concatenate(tensors, 0 if tensors[0].rank == 1 else 1)


def dstack(tensors: list[Tensor]) -> Tensor:
    return concatenate([atleast(t, 3) for t in tensors], 2)


def column_stack(tensors: list[Tensor]) -> Tensor:
    return concatenate([expand_dims(t, 1, "column") if t.rank == 1 else t for t in tensors], 1)


def append(a: Tensor, b: Tensor, axis=None) -> Tensor:
    return concatenate([flatten(a), flatten(b)]) if axis is None else concatenate([a, b], axis)


def pack(tensors: list[Tensor], keep: list[str]) -> tuple[Tensor, list[dict[str, int]]]:
    """Dims that are not kept are flattened and joined; the sizes tell how to undo it."""
    flat, shapes = [], []
    for t in tensors:
        free = [d for d in t.dims if d not in keep]
        shapes.append({d: t.length(d) for d in free})
        ordered = t.with_df(t.df, [*free, *(d for d in t.dims if d in keep)])
        one = flatten(ordered, 0, len(free) - 1, "packed") if len(free) > 1 else (ordered.rename(**{free[0]: "packed"}) if free else expand_dims(ordered, 0, "packed"))
        flat.append(one)
    return concatenate(flat, 0), shapes


def unpack(t: Tensor, shapes: list[dict[str, int]]) -> list[Tensor]:
    out, at = [], 0
    for shape in shapes:
        n = 1
        for s in shape.values():
            n *= s
        part = slice_dim(t, 0, at, at + n)
        out.append(unflatten(part, 0, shape) if len(shape) > 1 else part.rename(**{part.dims[0]: next(iter(shape))}) if shape else index_dim(part, 0, 0))
        at += n
    return out


def bounds(n: int, sections, even: bool = True) -> list[tuple[int, int]]:
    """Edges of pieces: so many equal ones (uneven: larger first), or cut at points."""
    if isinstance(sections, int):
        fail_unless(0 < sections <= MOST_PIECES, f"{sections} pieces")
        fail_unless(not even or n % sections == 0, f"{n} does not divide into {sections}")
        small, more = divmod(n, sections)
        edges = [0]
        for k in range(sections):
            edges.append(edges[-1] + small + (k < more))
    else:
        fail_unless(len(sections) < MOST_PIECES, "too many pieces")
        clipped = [min(max(p + n if p < 0 else p, 0), n) for p in sections]
        edges = [0, *clipped, n]
    return [(a, max(a, b)) for a, b in zip(edges, edges[1:], strict=False)]


def split(t: Tensor, sections, axis=0, even: bool = True) -> list[Tensor]:
    return [slice_dim(t, axis, a, b) for a, b in bounds(t.length(axis), sections, even)]


def array_split(t: Tensor, sections, axis=0) -> list[Tensor]:
    return split(t, sections, axis, even=False)


def split_sizes(t: Tensor, size, axis=0) -> list[Tensor]:
    """Pieces of one size, the last one shorter, or of the sizes given."""
    n = t.length(axis)
    if isinstance(size, int):
        fail_unless(size > 0, "size is not positive")
        points = list(range(size, n, size))
    else:
        fail_unless(sum(size) == n, f"sizes {size} do not add up to {n}")
        points = [sum(size[:k]) for k in range(1, len(size))]
    return split(t, points, axis)


def chunk(t: Tensor, count: int, axis=0) -> list[Tensor]:
    """At most count pieces of equal size, the last one shorter."""
    return split_sizes(t, max(1, -(-t.length(axis) // count)), axis)


def unbind(t: Tensor, axis=0) -> list[Tensor]:
    n = t.length(axis)
    fail_unless(n <= MOST_PIECES, f"{n} pieces")
    return [index_dim(t, axis, k) for k in range(n)]


def pieces(t: Tensor, sections, axis=0, dim: str = "piece") -> Tensor:
    """All pieces in one table with a dim that numbers them."""
    d = t.name(axis)
    edges = bounds(t.length(axis), sections, even=False)
    which = sum((F.when(F.col(d) >= b, 1).otherwise(0) for _, b in edges[:-1]), F.lit(0)).cast("long")
    start = F.element_at(F.array(*(F.lit(a) for a, _ in edges)), (which + 1).cast("int"))
    out = t.df.withColumn(dim, which).withColumn(d, F.col(d) - start)
    return Tensor(out.select(dim, *t.dims, "value"), (dim, *t.dims), (len(edges), *(None if x == d else s for x, s in zip(t.dims, t.sizes, strict=True))), t.fill)


def pad_sequence(t: Tensor, axis=-1, value: float = 0.0) -> Tensor:
    """Ragged slices filled up to the longest."""
    d = t.name(axis)
    rest = t.others(d)
    n = t.df.agg(F.max(d).alias("n")).first()["n"]
    n = 0 if n is None else n + 1
    rows = t.df.select(*rest).distinct().withColumn(d, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, n - 1)).cast("long"))))
    out = rows.join(t.df, [*rest, d], "left").withColumn("value", F.coalesce("value", F.lit(value)))
    return t.with_df(out, sizes=[n if x == d else s for x, s in zip(t.dims, t.sizes, strict=True)], fill=None)


def block(rows: list[list[Tensor]]) -> Tensor:
    """A matrix from a nested list of blocks."""
    return concatenate([concatenate(list(r), 1) for r in rows], 0)


def block_diag(*blocks: Tensor) -> Tensor:
    i, j = blocks[0].dims
    parts, at, to = [], 0, 0
    for b in blocks:
        fail_unless(b.rank == 2, "blocks are matrices")
        b = b.rename(**dict(zip(b.dims, (i, j), strict=True)))
        parts.append(b.df.withColumn(i, F.col(i) + at).withColumn(j, F.col(j) + to))
        at, to = at + b.length(0), to + b.length(1)
    return Tensor(fold(DataFrame.unionByName, parts), (i, j), (at, to), 0.0)


def cell_union(a: Tensor, b: Tensor) -> DataFrame:
    return a.df.unionByName(b.df).distinct()


def cell_intersection(a: Tensor, b: Tensor) -> DataFrame:
    return a.df.intersect(b.df)


def cell_difference(a: Tensor, b: Tensor) -> DataFrame:
    return a.df.exceptAll(b.df)


def missing_cells(t: Tensor) -> DataFrame:
    return grid(t.spark, dict(zip(t.dims, t.measured, strict=True))).join(t.df.select(*t.dims), list(t.dims), "left_anti")
