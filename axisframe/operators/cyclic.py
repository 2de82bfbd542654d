"""Cyclic sums of products in one round: shares of the labels, and a worst-case optimal join in each cell.

Whatever two operands of `ab,bc,ca->` are joined first, the intermediate may be far larger than inputs and result. Here every
label gets a share, each row goes to the cells that agree with its hashed labels (all cells along the labels that it lacks),
and a cell joins its rows of all operands label by label: a partial binding is extended by the operand that offers it the
fewest values, the others are asked for each. So no more bindings arise than the result of the worst input of this size has.

Rows for the same cells are sent in bundles, a few bytes each, and not one by one.

Shares are chosen for the least traffic such that a cell's expected rows stay under LOAD; the real largest load is then
measured, and shares of the fullest operand's labels are doubled until it fits too, so a hot value is spread over the cells
of the operand's other labels.
"""

from __future__ import annotations

import zlib
from itertools import combinations_with_replacement
from math import prod

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..sources.scratch import durable
from ..tensor import Tensor
from .blocks import runs

LOAD = 1 << 20  # rows of all operands in a cell
LEAST_BITS, MOST_BITS = 5, 20  # of the number of cells
CHUNK = 1 << 18  # bindings extended at once
BUNDLED = 1 << 19  # rows that a task puts in bundles at once


def is_cyclic(terms: list[set[str]]) -> bool:
    """Whether taking away labels of one term only, and terms that lie in others, leaves more than one term."""
    terms = [set(t) for t in terms]
    while True:
        lone = {c for t in terms for c in t if sum(c in u for u in terms) == 1}
        left = [t - lone for t in terms]
        left = [t for i, t in enumerate(left) if not any(t < u or (t == u and j < i) for j, u in enumerate(left))]
        if left == terms:
            return len(terms) > 1
        terms = left


def shares(counts: list[int], terms: list[tuple[str, ...]]) -> dict[str, int]:
    """Powers of two by label with the least rows sent, among those whose cells expect at most LOAD rows."""
    labels = sorted({c for t in terms for c in t})
    for bits in range(LEAST_BITS, MOST_BITS + 1):
        best = None
        for chosen in combinations_with_replacement(labels, bits):
            p = {c: 1 << chosen.count(c) for c in labels}
            sent = sum(n * prod(p[c] for c in labels if c not in t) for n, t in zip(counts, terms, strict=True))
            if best is None or sent < best[0]:
                best = sent, p
        if best[0] / prod(best[1].values()) <= LOAD:
            break
    return best[1]


def place(c: str, p: int):
    return F.pmod(F.xxhash64(F.lit(c), F.col(c)), F.lit(p)).cast("long")


def fullest(df: DataFrame, term: tuple[str, ...], p: dict[str, int]) -> int:
    return df.groupBy(*(place(c, p[c]).alias(c) for c in term)).count().agg(F.max("count")).first()[0] or 0


def spread_hot(parts: list[DataFrame], terms: list[tuple[str, ...]], p: dict[str, int]) -> dict[str, int]:
    """Shares whose real cells hold at most LOAD rows, as far as MOST_BITS allow."""
    while prod(p.values()) < 1 << MOST_BITS:
        loads = [fullest(df, t, p) for df, t in zip(parts, terms, strict=True)]
        if sum(loads) <= LOAD:
            break
        at = int(np.argmax(loads))
        tried = {c: fullest(parts[at], terms[at], p | {c: 2 * p[c]}) for c in terms[at]}
        c = min(tried, key=tried.get)
        p = p | {c: 2 * p[c]}
        if tried[c] > 0.9 * loads[at] and len(terms[at]) == 1:
            break
    return p


class Trie:
    """An operand's rows by its labels in the order of the join: at each level the nodes' values, and where their children start."""

    def __init__(self, columns: list[np.ndarray], value: np.ndarray, ranks: list[np.ndarray]):
        order = np.lexsort(columns[::-1])
        columns, self.value = [c[order] for c in columns], value[order]
        change, number = np.zeros(len(order), bool), None
        self.rank, self.key, self.starts = [], [], []
        for c, known in zip(columns, ranks, strict=True):
            change = change | np.r_[True, c[1:] != c[:-1]][: len(c)]
            at = np.flatnonzero(change)
            parent = np.zeros(len(at), np.int64) if number is None else number[at]
            if number is not None:
                self.starts.append(np.searchsorted(parent, np.arange(number[-1] + 2 if len(number) else 1)))
            number = np.cumsum(change) - 1
            self.rank.append(np.searchsorted(known, c[at]))
            self.key.append(parent * (len(known) + 1) + self.rank[-1])

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first child of each node one level up, and their number."""
        if level == 0:
            return np.zeros(len(node), np.int64), np.full(len(node), len(self.rank[0]))
        s = self.starts[level - 1]
        return s[node], s[node + 1] - s[node]

    def find(self, level: int, node: np.ndarray, rank: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
        """(child with the value, whether it is there)."""
        key = (node if level else np.zeros(len(node), np.int64)) * (known + 1) + rank
        at = np.minimum(np.searchsorted(self.key[level], key), len(self.key[level]) - 1)
        return at, self.key[level][at] == key


def bindings(tries: list[Trie], terms: list[tuple[str, ...]], labels: list[str], known: list[np.ndarray]):
    """(ranks by label, product of the values) of the join, in chunks; every term lists its labels in the order of `labels`."""

    def extend(depth: int, bound: np.ndarray, nodes: np.ndarray):
        if depth == len(labels):
            yield bound, np.prod([t.value[n] for t, n in zip(tries, nodes, strict=True)], axis=0)
            return
        c = labels[depth]
        asked = [(i, terms[i].index(c)) for i in range(len(terms)) if c in terms[i]]
        offers = [tries[i].children(level, nodes[i]) for i, level in asked]
        fewest = np.argmin([n for _, n in offers], axis=0)
        for k, (i, level) in enumerate(asked):
            mine = np.flatnonzero(fewest == k)
            first, n = offers[k][0][mine], offers[k][1][mine]
            ends = np.cumsum(n)
            start = 0
            while start < len(mine):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK, "right")))
                size = n[start:stop]
                of = np.repeat(mine[start:stop], size)
                child = np.arange(size.sum()) + np.repeat(first[start:stop] - (np.cumsum(size) - size), size)
                rank = tries[i].rank[level][child]
                new, there = nodes[:, of], np.ones(len(of), bool)
                new[i] = child
                for j, at in asked:
                    if j != i:
                        new[j], found = tries[j].find(at, nodes[j][of], rank, len(known[depth]))
                        there &= found
                if there.any():
                    yield from extend(depth + 1, np.vstack([bound[:, of], rank])[:, there], new[:, there])
                start = stop

    yield from extend(0, np.zeros((0, 1), np.int64), np.zeros((len(tries), 1), np.int64))


def summed_in_cell(columns: list[list[np.ndarray]], values: list[np.ndarray], terms: list[tuple[str, ...]], labels: list[str], output: list[str]):
    """(output columns, sum of products) of one cell's join, equal outputs together within a chunk."""
    known = [np.unique(np.concatenate([cs[t.index(c)] for cs, t in zip(columns, terms, strict=True) if c in t])) for c in labels]
    tries = [Trie(cs, v, [known[labels.index(c)] for c in t]) for cs, v, t in zip(columns, values, terms, strict=True)]
    at = [labels.index(c) for c in output]
    for bound, product in bindings(tries, terms, labels, known):
        rows = bound[at]
        order = np.lexsort(rows[::-1]) if at else np.arange(len(product))
        heads = np.flatnonzero(np.r_[True, (rows[:, order][:, 1:] != rows[:, order][:, :-1]).any(axis=0)]) if at else np.zeros(1, np.int64)
        yield [known[k][rows[i, order[heads]]] for i, k in enumerate(at)], np.add.reduceat(product[order], heads)


def bundled(columns: list[np.ndarray], value: np.ndarray) -> bytes:
    """Rows, in order, as few bytes: each column in the narrowest whole numbers, the first as differences."""
    stored, kinds = [], ""
    for k, x in enumerate(columns):
        x = np.diff(x, prepend=np.int64(0)) if k == 0 else x
        kinds += next(t for t in "bhiq" if np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max)
        stored.append(x.astype(kinds[-1]).tobytes())
    return zlib.compress(b"".join([len(kinds).to_bytes(2, "little"), kinds.encode(), len(value).to_bytes(8, "little"), *stored, value.astype("d").tobytes()]), 1)


def unbundled(data) -> list[np.ndarray]:
    """The columns and the values of a bundle."""
    raw = zlib.decompress(data)
    labels = int.from_bytes(raw[:2], "little")
    kinds, at = raw[2 : 2 + labels].decode(), 2 + labels
    n, at = int.from_bytes(raw[at : at + 8], "little"), at + 8
    out = []
    for t in kinds + "d":
        out.append(np.frombuffer(raw, t, n, at))
        at += out[-1].nbytes
    return [np.cumsum(out[0].astype(np.int64)), *(x.astype(np.int64) for x in out[1:-1]), out[-1]] if labels else out


def unpacked(held: list, operands: int) -> list[list[np.ndarray]] | None:
    """Columns and values of a cell by operand; nothing where one has no rows. One operand's bundles are open at a time."""
    data = [[x for b in held for k, x in zip(b["operand_"].to_pylist(), b["data"], strict=True) if k == i] for i in range(operands)]
    if not all(data):
        return None
    return [[np.concatenate(x) for x in zip(*(unbundled(x.as_buffer()) for x in own), strict=True)] for own in data]


def bundles(df: DataFrame, term: tuple[str, ...]) -> DataFrame:
    """(own_, data): the rows of up to BUNDLED neighbours in a task that share own_, as one binary value, with no shuffle."""
    names = ["own_", *term, "value"]

    def pack(batches):
        import pyarrow as pa

        def made(held):
            own, *columns, value = (np.concatenate([b[c].to_numpy(zero_copy_only=False) for b in held]) for c in names)
            order = np.lexsort([*columns[::-1], own])
            own, columns, value = own[order], [c[order] for c in columns], value[order]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            data = [bundled([c[i:j] for c in columns], value[i:j]) for i, j in zip(starts, [*starts[1:], len(own)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(own[starts]), pa.array(data, pa.binary())], ["own_", "data"])

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BUNDLED:
                yield made(held)
                held, rows = [], 0
        if rows:
            yield made(held)

    return df.mapInArrow(pack, "own_ long, data binary")


def applies(parts: list[Tensor]) -> bool:
    return len(parts) > 2 and is_cyclic([set(t.dims) for t in parts]) and all(isinstance(t.df.schema[d].dataType, IntegralType) for t in parts for d in t.dims)


def cyclic_sum(parts: list[Tensor], output: list[str]) -> DataFrame:
    """(output labels…, value): the sum of products over all other labels, dims being labels."""
    tables, terms = [], []
    for i, t in enumerate(parts):
        others = set(output).union(*(u.dims for j, u in enumerate(parts) if j != i))
        kept = [d for d in t.dims if d in others]
        df = t.df if len(kept) == t.rank else t.df.groupBy(*kept).agg(F.sum("value").alias("value"))
        terms.append(tuple(kept))
        tables.append(durable(df.filter("value IS NOT NULL AND value <> 0").select(*(F.col(d).cast("long").alias(d) for d in kept), F.col("value").cast("double").alias("value")), f"operand{i}"))
    labels = sorted({c for t in terms for c in t}, key=lambda c: (-sum(c in t for t in terms), c))
    terms = [tuple(sorted(t, key=labels.index)) for t in terms]
    counts = [df.count() for df in tables]
    p = spread_hot(tables, terms, shares(counts, terms))
    weight, cells = {}, 1
    for c in labels:
        weight[c], cells = cells, cells * p[c]
    sent = None
    for i, (df, term) in enumerate(zip(tables, terms, strict=True)):
        own = F.lit(0).cast("long")
        for c in term:
            own = own + place(c, p[c]) * weight[c]
        df, cell = bundles(df.select(own.alias("own_"), *term, "value"), term), F.col("own_")
        for c in labels:
            if c not in term:
                df = df.withColumn(f"{c}_at_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(p[c] - 1).cast("long"))))
                cell = cell + F.col(f"{c}_at_") * weight[c]
        row = df.select(cell.alias("cell_"), F.lit(i).alias("operand_"), "data")
        sent = row if sent is None else sent.unionByName(row)

    def join(batches):
        import pyarrow as pa

        for _, held in runs(batches, ["cell_"]):
            parts = unpacked(held, len(terms))
            if parts:
                for out, sums in summed_in_cell([own[:-1] for own in parts], [own[-1] for own in parts], terms, labels, output):
                    yield pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(sums)], [*output, "value"])
            del parts, held

    kinds = "".join(f"`{c}` long, " for c in output)
    found = sent.repartition("cell_").sortWithinPartitions("cell_").mapInArrow(join, f"{kinds}value double")
    total = F.sum("value")
    return found.groupBy(*output).agg((total if output else F.coalesce(total, F.lit(0.0))).alias("value"))
