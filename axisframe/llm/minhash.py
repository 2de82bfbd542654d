"""Near-duplicates by MinHash signatures, with candidates verified in sequence by their posterior similarity.

A document's set holds the distinct shingles of so many words (with fewer words, the whole sequence is one shingle).
Documents with equal sets form one node. A node's signature has BANDS * ROWS minima; nodes that agree on all rows of a
band are candidates. At a similarity of 0.8 a pair has no band in common with probability (1 - 0.8**ROWS)**BANDS, about
1.3e-7. A candidate's signatures are compared STEP minima at a time: with a uniform prior, m agreements of n leave
the similarity a Beta(m + 1, n - m + 1) distribution, and the pair is dropped once the chance of its reaching the
threshold is below MISS. Whole sets decide about every survivor, so each link is exact.

To avoid all pairs within a bucket, every bucket first ties its members to one leader, the node with the most company in
all its buckets, which stands near the middle of a group of variants; only members
that lie in different components after that meet, block by block: signatures first, then whole sets, both compared where the
block lies, so that pairs never become rows, only links that tie. Words, shingles and sets stand as 64-bit digests of good
dispersion: among n different ones of a kind two coincide with probability below n**2 / 2**65.

A null or empty text, or one without words, has an empty set, is linked with nothing and is kept; its component is its
own id. Repeated rows are copies with the same answer. A null id takes part, but names a component only where no other
id does, and is kept only there. Ties of similarity need no order: a pair at the threshold is a link. Empty tables give
no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import B, bounded_batches, durable, forget, mix, table, trimmed
from .graph import components
from .jaccard import node_of, shingles

BANDS, ROWS = 40, 5
STEP = 40
MISS = 1e-6
BITS = 1 << 23  # of the table that says which ids to read again
SEEN = 50_000  # nodes a task remembers, to leave out copies early
CHUNK = 4096  # shingles hashed at once
BLOCK = 1000  # members of a bucket's part
PAIRS = 50_000  # compared at once

_numbers = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
FACTORS = (_numbers[::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
SHIFTS = (_numbers[1::2] >> np.uint64(32)).astype(np.uint32)


def minima(tokens: np.ndarray) -> np.ndarray:
    """The signature of a set of 64-bit tokens: its least value under each hash function."""
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    short = (tokens >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(short), CHUNK):
        np.minimum(least, (short[start : start + CHUNK, None] * FACTORS + SHIFTS).min(axis=0), out=least)
    return least


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(sets, BANDS) 64-bit names of each band's rows, the last 16 bits of the minima, different for each band."""
    rows = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    keys = np.arange(BANDS, dtype=np.uint64) * B
    for r in range(ROWS):
        keys = mix(keys + rows[:, :, r])
    return keys


def chance(m: int, n: int, threshold: float) -> float:
    """Probability of a similarity of at least the threshold after m agreements of n, a uniform prior given."""
    return sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))


def fewest_agreements(percent: int, miss: float = MISS) -> list[tuple[int, int]]:
    """(n, fewest agreements among the first n minima that leave the threshold a chance of `miss`), step by step."""
    steps = [*range(STEP, BANDS * ROWS, STEP), BANDS * ROWS]
    return [(n, next(m for m in range(n + 1) if chance(m, n, percent / 100) >= miss)) for n in steps]


def signed(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, node, n, signature, bands): the last two where a task meets a node for the first time. Minima keep their
    last 16 bits; a chance agreement, one in 65,536, can only add or spare a pair."""
    names = ["doc_id", "node", "n", "signature", "bands"]

    def run(batches):
        seen: set = set()
        for batch in batches:
            nodes, sizes, new, of = [], [], [], {}
            for row, text in enumerate(batch["text"].to_pylist()):
                s = shingles(text, width)
                node = node_of(s) if len(s) else None
                nodes.append(node)
                sizes.append(len(s))
                if node is not None and node not in seen:
                    if len(seen) < SEEN:
                        seen.add(node)
                    of[row] = len(new)
                    new.append(minima(s))
            all_new = np.array(new, np.uint32).reshape(len(new), BANDS * ROWS)
            short = all_new.astype(np.uint16)
            keys = band_keys(short).view(np.int64)
            at = [of.get(row) for row in range(len(nodes))]
            signature = pa.array([None if k is None else short[k].tobytes() for k in at], pa.binary())
            bands = pa.array([None if k is None else keys[k] for k in at], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), signature, bands], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, node long, n long, signature binary, bands array<long>")


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that no step of signature comparison drops."""
    steps = fewest_agreements(percent)
    side = lambda name, to: nodes.select(F.col("node").alias(name), F.col("signature").alias(to))

    def run(batches):
        for batch in batches:
            as_rows = lambda c: np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)  # noqa: E731, B023
            x, y = as_rows("x"), as_rows("y")
            left, agreed, done = np.arange(len(x)), np.zeros(len(x), np.int64), 0
            for n, fewest in steps:
                agreed = agreed + (x[left, done:n] == y[left, done:n]).sum(axis=1)
                left, agreed, done = left[agreed >= fewest], agreed[agreed >= fewest], n
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).take(pa.array(left))

    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(trimmed(run), "a long, b long")


def whole_sets(docs: DataFrame, nodes: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(node, tokens) of the nodes asked for, each read again from the document with its smallest id. A bit table of fixed size
    over the ids lets most other documents go unread; it may let some through, whose digest then tells."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS)).cast("int")
    wanted = np.zeros(BITS, bool)
    wanted[nodes.join(asked, "node", "left_semi").select(place("first").alias("bit")).distinct().toArrow()["bit"].to_numpy()] = True
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def run(batches):
        want = np.unpackbits(wanted.value).astype(bool)
        for batch in batches:
            found = [s for s in (shingles(t, width) for t in batch.filter(pa.array(want[batch["bit"].to_numpy()]))["text"].to_pylist()) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "tokens"])

    read = docs.select("text", place("doc_id").alias("bit")).mapInArrow(trimmed(run), "node long, tokens binary")
    return read.join(asked, "node", "left_semi").dropDuplicates(["node"])


def reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""

    def run(batches):
        for batch in batches:
            keep = [reaches(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda name, to: sets.select(F.col("node").alias(name), F.col("tokens").alias(to))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(trimmed(run), "a long, b long")


def confirmed_in_cells(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that tie all that the cells' pairs tie: whole sets are sent to a cell once, all its pairs are decided there,
    and a pair that the cell's links already tie together needs no link of its own."""
    cell = ["key", "i", "j"]
    asked = met.select(*cell, F.explode(F.array_distinct(F.concat("a", "b"))).alias("node")).distinct()

    def decide(members: pa.Table, pairs: pa.Table) -> pa.Table:
        tokens = dict(zip(members["node"].to_pylist(), map(lambda t: np.frombuffer(t, np.uint64), members["tokens"].to_pylist()), strict=True))
        up, links = {n: n for n in tokens}, []

        def top(n):
            while up[n] != n:
                up[n] = n = up[up[n]]
            return n

        for xs, ys in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True):
            for x, y in zip(xs, ys, strict=True):
                if (p := top(x)) != (q := top(y)) and reaches(tokens[x], tokens[y], percent):
                    up[p] = q
                    links.append((x, y))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    rows = asked.join(sets, "node").select(*(F.col(c).alias(f"{c}_") for c in cell), "node", "tokens")
    return rows.groupBy("key_", "i_", "j_").cogroup(met.groupBy(*cell)).applyInArrow(decide, "a long, b long")


def similar_sizes(x, y, percent: int):
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def met_again(posted: DataFrame, roots: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Plausible pairs that share a bucket and lie in different components, each in its first shared band only, as rows (key, i,
    j, a, b): lists of pairs for a cell.

    A bucket's largest component and the rest of it are cut into blocks of about BLOCK members each, and a cell compares a block of
    the rest with itself or with another block, so no task holds a large bucket. Signatures are compared in place: only pairs that no step drops become rows.
    """
    steps = fewest_agreements(percent)
    own = durable(posted.select("key", "band", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    roots_of = own.groupBy("key", "root").agg(F.count("*").alias("members")).groupBy("key").agg(F.max(F.struct("members", "root")).alias("major"), F.sum("members").alias("all"), F.count("*").alias("roots"))
    parts = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = roots_of.filter("roots > 1").select("key", F.col("major.root").alias("top"), parts(F.col("major.members")).alias("p"), parts(F.col("all") - F.col("major.members")).alias("q"))
    at = F.xxhash64("node")
    inside = F.col("root") == F.col("top")  # the largest component's members have nothing to ask of each other
    cells = own.join(mixed, "key").withColumn("block", F.when(inside, F.pmod(at, F.col("p"))).otherwise(F.col("p") + F.pmod(at, F.col("q"))).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.when(inside, F.col("p")).otherwise(0), F.col("p") + F.col("q") - 1)))
    cells = cells.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "band", "block", "node", "n", "root")
    rows = cells.join(nodes.select("node", "signature"), "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def pairs_of(start: int, end: int, first: bool, block) -> tuple[np.ndarray, np.ndarray]:
        if first:  # a block with itself
            x, y = np.triu_indices(end - start, 1)
            return x + start, y + start
        at = np.arange(start, end)
        x, y = at[block[start:end] == block[start:end].min()], at[block[start:end] != block[start:end].min()]
        return np.repeat(x, len(y)), np.tile(y, len(x))

    def compared(batch: pa.RecordBatch):
        cell, band, block, node, n, root = (np.stack([batch[c].to_numpy() for c in ("key", "i", "j")], axis=1), *(batch[c].to_numpy() for c in ("band", "block", "node", "n", "root")))
        signature = np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)
        starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(axis=1)])
        ends = np.r_[starts[1:], len(cell)]
        waiting, size = [], 0
        for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
            waiting.append(pairs_of(start, end, cell[start, 1] == cell[start, 2], block))
            size += len(waiting[-1][0])
            if size < PAIRS and end < len(cell):
                continue
            xs, ys = (np.concatenate(z) for z in zip(*waiting, strict=True))
            waiting, size = [], 0
            for at in range(0, len(xs), PAIRS):
                x, y = xs[at : at + PAIRS], ys[at : at + PAIRS]
                fits = (root[x] != root[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
                x, y = x[fits], y[fits]
                agreed, done = np.zeros(len(x), np.int64), 0
                for up_to, fewest in steps:
                    agreed = agreed + (signature[x, done:up_to] == signature[y, done:up_to]).sum(axis=1)
                    likely, done = agreed >= fewest, up_to
                    x, y, agreed = x[likely], y[likely], agreed[likely]
                first = (signature[x] == signature[y]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band[x]
                x, y = x[first], y[first]
                of = np.searchsorted(starts, x, "right")
                heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)])
                cuts = pa.array(np.r_[heads, len(of)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(z)) for z in (node[x], node[y])]
                yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(x[heads])) for c in ("key", "i", "j")), *lists], ["key", "i", "j", "a", "b"])

    def run(batches):
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key, i, j = (whole[c].to_numpy() for c in ("key", "i", "j"))
            done = int(np.argmax((key == key[-1]) & (i == i[-1]) & (j == j[-1])))  # more rows of the last cell may follow
            held = [whole.slice(done)]
            if done:
                yield from compared(whole.slice(0, done))
        if held:
            yield from compared(held[0])

    return rows.mapInArrow(trimmed(run), "key long, i int, j int, a array<long>, b array<long>")


def minhash_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): component_id is the smallest id that links reach, links being candidates with
    100 * intersection >= percent * union; kept is true for the documents that carry it."""
    bounded_batches(docs.sparkSession)
    every = durable(signed(docs, width), "signed")
    members = every.select("doc_id", "node", "n")
    one = lambda c: F.first(c, ignorenulls=True).alias(c)
    nodes = durable(every.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"), one("n"), one("signature"), one("bands")), "nodes")

    posted = nodes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    posted = durable(posted.join(shared, "key"), "buckets")
    weight = posted.groupBy("node").agg(F.sum("members").alias("weight"))
    lead = posted.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node", "n")).alias("lead"))

    led = posted.join(lead, "key").filter((F.col("node") != F.col("lead.node")) & similar_sizes(F.col("n"), F.col("lead.n"), percent))
    stars = durable(led.select(F.least("lead.node", "node").alias("a"), F.greatest("lead.node", "node").alias("b")).distinct(), "stars")
    left = durable(plausible(stars, nodes, percent), "plausible")
    sets = durable(whole_sets(docs, nodes, left.select(F.explode(F.array("a", "b")).alias("node")).distinct(), width), "sets")
    links = durable(confirmed(left, sets, percent), "links")
    roots = durable(components(links), "roots")
    forget(stars, left, sets)

    met = durable(met_again(posted, roots, nodes, percent), "met")
    forget(posted)
    if not met.isEmpty():
        sets = durable(whole_sets(docs, nodes, met.select(F.explode(F.array_distinct(F.concat("a", "b"))).alias("node")).distinct(), width), "sets")
        forget(roots)
        roots = durable(components(links.unionByName(confirmed_in_cells(met, sets, percent))), "roots")
        forget(sets)
    forget(met)

    rooted = durable(nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "classes")
    least = durable(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")  # a table, so that a root with many nodes can be split
    of = rooted.join(least, "root").select("node", "component_id")
    found = members.join(of, "node", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents"), width=2, percent=80)


OP13_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
d AS (SELECT g, count(*) AS d FROM g GROUP BY g),
r AS (SELECT doc_id, n, g, row_number() OVER (PARTITION BY doc_id ORDER BY d, g) AS pos FROM g JOIN d USING (g)),
p AS (SELECT * FROM r WHERE pos <= n - (80 * n + 99) // 100 + 1),
m AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
c AS (SELECT m.a, m.b FROM m JOIN g x ON x.doc_id = m.a JOIN g y ON y.doc_id = m.b AND y.g = x.g GROUP BY m.a, m.b HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
e AS (SELECT a, b FROM c UNION ALL SELECT b, a FROM c),
cc(node, root) USING KEY (node) AS (SELECT doc_id, doc_id FROM s UNION (SELECT p.node, min(i.root) FROM recurring.cc p JOIN e x ON x.a = p.node JOIN cc i ON i.node = x.b WHERE i.root < p.root GROUP BY p.node))
SELECT doc_id, len(s)::BIGINT AS n_shingles, root AS component_id, doc_id = root AS kept FROM s JOIN cc ON node = doc_id
"""
