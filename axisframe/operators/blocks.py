"""Products of two large tensors by tiles, so that tiles are shuffled and not elementary products.

The dims of a contraction fall into batch dims (kept, on both sides), rows (kept, left only), columns (kept, right only) and
summed dims. Rows, columns and summed positions are numbered and cut into tiles, each packed into one binary value. Tiles of
neighbouring rows, or columns, make a strip of at most HELD cells. A tile of one side is sent once to every strip of the other
that it has a partner in, so the traffic grows with the number of strips and not of tiles; there the tiles of up to GROUP
summed ranges are multiplied into one output tile after the other, and the output tiles of further groups are added by a
grouped sum. A tile holds at most TILE * DEPTH cells whatever the keys' shares of the rows, so a summed position that meets
every row and column is split over all output tiles. `row_totals` sums up the product's rows where they arise.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..sources.scratch import durable
from ..tensor import Tensor, linear

TILE, DEPTH = 1024, 512  # rows or columns of an output tile; summed positions of an input tile
GROUP = 32  # summed ranges of one task
HELD = 1 << 22  # cells of a strip, were all cells there
PAIRS = 64  # pairs of strips at least, as far as there are tiles
MUCH = 10**8  # elementary products, were all cells there, from which tiles pay
MOST_TILES = 10**6  # pairs of tiles; beyond it the sizes are so large that tiles would be all but empty
EMITTED = 1 << 18


def pays(a: Tensor, b: Tensor, over: list[str]) -> bool:
    """Whether the sizes, known beforehand, ask for tiles: enough products, and not more tiles than can be filled."""
    if None in a.sizes or None in b.sizes:
        return False
    if any(a.size(d) != b.size(d) for d in a.dims if d in b.dims):
        return False
    if not all(isinstance(t.df.schema["value"].dataType, (DoubleType, FloatType)) for t in (a, b)):
        return False
    batch, rows, columns, depth = sizes_of(a, b, over)
    pairs = batch * -(-rows // TILE) * -(-columns // TILE) * -(-depth // DEPTH)
    return batch * rows * columns * depth >= MUCH and pairs <= MOST_TILES


def parts_of(a: Tensor, b: Tensor, over: list[str]) -> tuple[list[str], list[str], list[str], list[str]]:
    batch = [d for d in a.dims if d in b.dims and d not in over]
    return batch, [d for d in a.dims if d not in b.dims], [d for d in b.dims if d not in a.dims], [d for d in over if d in a.dims]


def sizes_of(a: Tensor, b: Tensor, over: list[str]) -> tuple[int, int, int, int]:
    parts = parts_of(a, b, over)
    return tuple(prod((a if d in a.dims else b).length(d) for d in dims) for dims in parts)


def runs(batches, keys: list[str]) -> Iterator[tuple[tuple, list]]:
    """(key, record batches) of each key in turn, from batches sorted by the keys."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for k in keys:
            x = batch[k].to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
        starts = np.flatnonzero(change).tolist()
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(batch[k][start].as_py() for k in keys)
            if held and key != last:
                yield last, held
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield last, held


def tiles(t: Tensor, batch: list[str], first: list[str], second: list[str], shape: tuple[int, int], names: tuple[str, str]) -> DataFrame:
    """(batch…, two tile numbers, data): the cells of each tile as packed (row, column, value)."""
    size = lambda dims: [t.length(d) for d in dims]
    p, q = linear(first, size(first)), linear(second, size(second))
    keys = [*batch, *names]
    cells = t.df.select(*batch, F.floor(p / shape[0]).cast("long").alias(names[0]), F.floor(q / shape[1]).cast("long").alias(names[1]), (p % shape[0]).cast("int").alias("r_"), (q % shape[1]).cast("int").alias("c_"), F.col("value").cast("double").alias("v_"))

    def pack(batches):
        import pyarrow as pa

        for key, parts in runs(batches, keys):
            r, c, v = (np.concatenate([x[n].to_numpy() for x in parts]) for n in ("r_", "c_", "v_"))
            data = np.rec.fromarrays([r, c, v], dtype=CELL).tobytes()
            yield pa.RecordBatch.from_arrays([*(parts[0][k].slice(0, 1) for k in keys), pa.array([data], pa.binary())], [*keys, "data"])

    kinds = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys)
    return cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(pack, f"{kinds}, data binary")


CELL = np.dtype([("r", "<i4"), ("c", "<i4"), ("v", "<f8")])


def multiplied(x: np.ndarray, y: np.ndarray, out: np.ndarray, there: np.ndarray | None = None) -> None:
    """Add the product of two tiles of cells to an array; only rows, columns and summed positions that have cells take part.
    Where two cells meet, `there` is set."""
    k = np.intersect1d(x["c"], y["r"])
    if not len(k):
        return
    at = np.full(DEPTH, -1)
    at[k] = np.arange(len(k))
    x, y = x[at[x["c"]] >= 0], y[at[y["r"]] >= 0]
    rows, r = np.unique(x["r"], return_inverse=True)
    columns, c = np.unique(y["c"], return_inverse=True)
    left, right = np.zeros((len(rows), len(k))), np.zeros((len(k), len(columns)))
    left[r, at[x["c"]]] = x["v"]
    right[at[y["r"]], c] = y["v"]
    out[np.ix_(rows, columns)] += left @ right
    if there is not None:
        left[r, at[x["c"]]] = 1
        right[at[y["r"]], c] = 1
        there[np.ix_(rows, columns)] |= left @ right > 0


class Tile:
    """A tile's cells, and its array where it has a cell for each row, from the first on, and each of its columns likewise."""

    def __init__(self, data):
        self.cells = np.frombuffer(data, CELL)
        shape = int(self.cells["r"].max()) + 1, int(self.cells["c"].max()) + 1
        self.full = None
        if shape[0] * shape[1] == len(self.cells):
            self.full = np.empty(shape)
            self.full[self.cells["r"], self.cells["c"]] = self.cells["v"]
            self.cells = None

    def as_cells(self) -> np.ndarray:
        if self.full is None:
            return self.cells
        r, c = np.indices(self.full.shape, "<i4")
        return np.rec.fromarrays([r.ravel(), c.ravel(), self.full.ravel()], dtype=CELL)


def added(x: Tile, y: Tile, out: np.ndarray, there: np.ndarray | None) -> None:
    """Add the product of two tiles to an array, as `multiplied`."""
    if x.full is not None and y.full is not None and x.full.shape[1] == y.full.shape[0]:
        out[: len(x.full), : y.full.shape[1]] += x.full @ y.full
        if there is not None:
            there[: len(x.full), : y.full.shape[1]] = True
    else:
        multiplied(x.as_cells(), y.as_cells(), out, there)


def strips(rows: int, columns: int, depth: int) -> tuple[int, int]:
    """Tiles of a strip of rows and of columns: few strips, but enough pairs of them, of at most HELD cells where a tile is not more."""
    most = max(1, HELD // (TILE * max(1, depth)))
    i, j = max(1, -(-rows // TILE)), max(1, -(-columns // TILE))
    of = lambda tiles, wanted: max(-(-tiles // most), min(tiles, wanted))
    many = of(j, -(-PAIRS // of(i, int(PAIRS**0.5))))
    return -(-i // of(i, -(-PAIRS // many))), -(-j // many)


def output_tiles(held: list, strip: bool, side: int, n_rows: int, n_columns: int, meets: bool):
    """(row tile, column tile, product, where cells met) of one pair of strips of tiles with so long a side, whose rows come left
    side first, then column by column, or, of strips of one tile each, position by position."""
    empty = lambda ib, jb: tuple(np.zeros((min(side, n_rows - ib * side), min(side, n_columns - jb * side)), kind) for kind in (float, bool))
    rows = ((ib, jb, kb, Tile(data.as_buffer())) for part in held for ib, jb, kb, data in zip(*(part[c].to_pylist() for c in ("ib_", "jb_", "kb_")), part["data"], strict=True))
    if not strip:
        out, x = None, None
        for ib, jb, kb, tile in rows:
            if jb is None:
                x = ib, kb, tile
            elif x is not None and x[1] == kb:
                if out is None:
                    at, (out, there) = (x[0], jb), empty(x[0], jb)
                added(x[2], tile, out, there if meets else None)
        if out is not None:
            yield *at, out, there
        return
    left, right, last = {}, {}, None

    def column():
        for ib, own in left.items():
            both = own.keys() & right.keys()
            if both:
                out, there = empty(ib, last)
                for kb in sorted(both):
                    added(own[kb], right[kb], out, there if meets else None)
                yield ib, last, out, there

    for ib, jb, kb, tile in rows:
        if jb is None:
            left.setdefault(ib, {})[kb] = tile
            continue
        if right and jb != last:
            yield from column()
            right = {}
        last = jb
        right[kb] = tile
    if right:
        yield from column()


def met(a: Tensor, b: Tensor, over: list[str], group: int | None) -> tuple[DataFrame, list[str], bool]:
    """(tiles of both sides beside each other, the keys of a pair of strips, whether strips hold more tiles than one)."""
    batch, rows, columns, summed = parts_of(a, b, over)
    _, n_rows, n_columns, depth = sizes_of(a, b, over)
    left = durable(tiles(a, batch, rows, summed, (TILE, DEPTH), ("ib_", "kb_")), "left-tiles")
    right = durable(tiles(b, batch, summed, columns, (DEPTH, TILE), ("kb_", "jb_")), "right-tiles")
    tall, wide = strips(n_rows, n_columns, depth if group is None else min(depth, DEPTH * group))
    left = left.withColumn("ig_", F.floor(F.col("ib_") / tall).cast("long"))
    right = right.withColumn("jg_", F.floor(F.col("jb_") / wide).cast("long"))
    meet = [*batch, "kb_"]
    few = not batch and -(-depth // DEPTH) * max(-(-n_rows // (TILE * tall)), -(-n_columns // (TILE * wide))) <= 10**5

    def sent(t, other, column):  # to every strip with a partner
        partners = other.select(*meet, column).distinct()
        return t.join(F.broadcast(partners) if few else partners, meet)

    x = sent(left, right, "jg_").withColumn("jb_", F.lit(None).cast("long"))
    y = sent(right, left, "ig_").withColumn("ib_", F.lit(None).cast("long"))
    keys = [*batch, "ig_", "jg_", "kg_"]
    kg = F.lit(0) if group is None else F.floor(F.col("kb_") / group)
    pairs = x.unionByName(y).withColumn("kg_", kg.cast("long"))
    strip = tall * wide > 1
    order = ["jb_", "kb_", "ib_"] if strip else ["kb_", "jb_"]  # nulls, the left side's, come first
    return pairs.repartition(*keys).sortWithinPartitions(*keys, *order), keys, strip


def named(found: DataFrame, dims: list[str], parts: list[tuple[list[str], str]], size: dict[str, int], *values: str) -> DataFrame:
    """The dims' coordinates from numbers of rows and columns."""
    columns_of = {}
    for names, at in parts:
        stride = 1
        for d in reversed(names):
            columns_of[d] = (F.floor(F.col(at) / stride) % size[d]).cast("long")
            stride *= size[d]
    return found.select(*(columns_of[d].alias(d) if d in columns_of else F.col(d) for d in dims), *values)


def blocked(a: Tensor, b: Tensor, over: list[str], dims: list[str]) -> Tensor:
    """The sum over the dims `over`, all of them on both sides, of the products of a and b, in tiles; absent cells are 0.

    The result has rows for the cells that are not 0. A NaN or an infinity stays where it multiplies a cell that is there.
    """
    batch, rows, columns, summed = parts_of(a, b, over)
    size = {d: (a if d in a.dims else b).length(d) for d in dims}
    _, n_rows, n_columns, depth = sizes_of(a, b, over)
    pairs, keys, strip = met(a, b, over, GROUP)

    def multiply(batches):
        import pyarrow as pa

        for key, held in runs(batches, keys):
            for ib, jb, out, _ in output_tiles(held, strip, TILE, n_rows, n_columns, False):
                r, c = np.nonzero(out)
                for start in range(0, len(r), EMITTED):
                    i, j = r[start : start + EMITTED], c[start : start + EMITTED]
                    same = [held[0][d].slice(0, 1).take(pa.array(np.zeros(len(i), np.int64))) for d in batch]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(i + ib * TILE), pa.array(j + jb * TILE), pa.array(out[i, j])], [*batch, "i_", "j_", "value"])

    kinds = "".join(f"`{d}` {a.df.schema[d].dataType.simpleString()}, " for d in batch)
    found = pairs.mapInArrow(multiply, f"{kinds}i_ long, j_ long, value double")
    if depth > DEPTH * GROUP:
        found = found.groupBy(*batch, "i_", "j_").agg(F.sum("value").alias("value"))
    return Tensor(named(found, dims, [(rows, "i_"), (columns, "j_")], size, "value"), dims, [size[d] for d in dims], 0.0)


def row_totals(a: Tensor, b: Tensor, over: list[str]) -> DataFrame:
    """(kept dims of a, total, most, square): of each row of the product of a and b over the dims `over`, the sum, the largest
    value but that of the column with the row's own number, and the sum of squares.

    Absent cells are missing: a value of the product is there where two cells meet, zeros too. Each task sums up what it
    multiplies, so no value of the product leaves it, and gives one row for each row of its strip.
    """
    batch, rows, columns, summed = parts_of(a, b, over)
    size = {d: a.length(d) for d in rows}
    _, n_rows, n_columns, _ = sizes_of(a, b, over)
    pairs, keys, strip = met(a, b, over, None)

    def multiply(batches):
        import pyarrow as pa

        for key, held in runs(batches, keys):
            sums = {}
            for ib, jb, out, there in output_tiles(held, strip, TILE, n_rows, n_columns, True):
                if ib not in sums:
                    sums[ib] = [np.zeros(len(out), np.int64), np.zeros(len(out), np.int64), np.zeros(len(out)), np.full(len(out), -np.inf), np.zeros(len(out))]
                n, others, total, most, square = sums[ib]
                n += there.sum(axis=1)
                if not there.all():
                    out[~there] = 0
                total += out.sum(axis=1)
                square += np.einsum("ij,ij->i", out, out)
                own = np.arange(min(out.shape)) if ib == jb else np.zeros(0, np.int64)
                others += there.sum(axis=1)
                others[own] -= there[own, own]
                if not there.all():
                    out[~there] = -np.inf
                out[own, own] = -np.inf
                np.maximum(most, out.max(axis=1), out=most)
            for ib, (n, others, total, most, square) in sums.items():
                at = np.flatnonzero(n)
                same = [held[0][d].slice(0, 1).take(pa.array(np.zeros(len(at), np.int64))) for d in batch]
                yield pa.RecordBatch.from_arrays([*same, pa.array(at + ib * TILE), pa.array(total[at]), pa.array(most[at], mask=others[at] == 0), pa.array(square[at])], [*batch, "i_", "total", "most", "square"])

    kinds = "".join(f"`{d}` {a.df.schema[d].dataType.simpleString()}, " for d in batch)
    found = pairs.mapInArrow(multiply, f"{kinds}i_ long, total double, most double, square double")
    found = found.groupBy(*batch, "i_").agg(F.sum("total").alias("total"), F.max("most").alias("most"), F.sum("square").alias("square"))
    return named(found, [*batch, *rows], [(rows, "i_")], size, "total", "most", "square")
