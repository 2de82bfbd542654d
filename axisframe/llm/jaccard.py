"""N-gram Jaccard join with filters under several global token orders.

A document's set holds the distinct shingles of so many words (with fewer words, the whole sequence is one shingle).
Documents with equal sets form one node. Two sets whose similarity reaches the threshold share a token among the
first n - ceil(t n) + 1 of each, under whatever order of all tokens. The first order puts rare tokens first and gives
candidates by a join on prefix tokens with filters on sizes, positions and the number of shared prefix tokens; a candidate must then share prefix tokens under
further orders too; what is left is verified on whole sets.

Rarity comes from a count of all shingles in a table of fixed size, so hot passages stand at the end of every order;
a shared cell changes an order, never a result. To avoid all pairs within a group, each posting list first ties its
members to one leader, the set with the fewest rare tokens; only members of different components then meet. Components
come from alternating stars. Words, shingles and sorted sets stand as 64-bit digests of good dispersion: among n different
ones of a kind two coincide with probability below n**2 / 2**65.

A null or empty text has an empty set and is linked with nothing; its component is its own id. Repeated rows are
copies. A null id takes part, but gives no component id where there is another. Empty tables give no rows; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import B, bounded_batches, durable, forget, mix, table, trimmed
from .graph import components

CELLS = 1 << 20
SLICE = 1 << 14
ORDERS = 3
BITS = 1 << 23
SEEN = 50_000  # nodes a task remembers, to leave out copies early

def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit tokens of a text's shingles; A-Z count as a-z, words lie between ASCII white space."""
    words = (text or "").encode().lower().split()
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if not len(w):
        return w
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = mix(h + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def node_of(tokens: np.ndarray) -> int:
    """A signed 64-bit digest of a set."""
    return xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def ordered(tokens: np.ndarray, levels: np.ndarray, order: int) -> tuple[np.ndarray, int]:
    """The set in the given global order (rare levels first, then by a hash of the order's own) and its number of rare tokens."""
    level = levels[tokens & np.uint64(CELLS - 1)]
    key = (level.astype(np.uint64) << np.uint64(59)) | (mix(tokens + np.uint64(order * int(B) % 2**64)) >> np.uint64(5))
    return tokens[np.argsort(key, kind="stable")], int((level == 0).sum())


def count_sets(docs: DataFrame, width: int, carry: list[str]) -> DataFrame:
    """Rows (doc_id, carry…, node, n) of documents, and rows (at, cells, task) of each task's slices of the token count table."""
    own = ["doc_id", *carry]
    names = [*own, "node", "n", "at", "cells", "task"]

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        cells, seen, kinds = np.zeros(CELLS, np.uint32), set(), None
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in own]
            nodes, sizes, gathered = [], [], []
            for text in batch["text"].to_pylist():
                s = shingles(text, width)
                node = node_of(s) if len(s) else None
                nodes.append(node)
                sizes.append(len(s))
                if node is not None and node not in seen:
                    if len(seen) < SEEN:
                        seen.add(node)
                    gathered.append(s)
            if gathered:
                cells += np.bincount((np.concatenate(gathered) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.uint32)
            none = pa.nulls(len(nodes), pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in own), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), none, pa.nulls(len(nodes), pa.binary()), none], names)
        if kinds is not None:
            at = [i for i in range(0, CELLS, SLICE) if cells[i : i + SLICE].any()]
            raw = [cells[i : i + SLICE].tobytes() for i in at]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(at), k) for k in (*kinds, pa.int64(), pa.int64())), pa.array(at, pa.int32()), pa.array(raw, pa.binary()), pa.array([task] * len(at), pa.int32())], names)

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own)
    return docs.select(*own, "text").mapInArrow(trimmed(run), f"{fields}, node long, n long, at int, cells binary, task int")


def rarity_levels(slices: DataFrame) -> np.ndarray:
    """0 for cells within the noise of rare tokens, else growing with the logarithm of the count; CELLS bytes."""

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.uint32).astype(np.uint64) for c in group["cells"].to_pylist())
        return pa.table({"at": group["at"][:1].combine_chunks().cast(pa.int32()), "cells": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    schema = "at int, cells binary"
    some = slices.withColumn("tasks", (F.col("task") / 64).cast("int")).groupBy("at", "tasks").applyInArrow(add, schema)
    counts = np.zeros(CELLS)
    for row in some.groupBy("at").applyInArrow(add, schema).toLocalIterator():
        counts[row["at"] : row["at"] + SLICE] = np.frombuffer(row["cells"], np.uint32)
    usual = float(np.median(counts))
    return np.clip(np.floor(np.log2(np.maximum(counts, 1) / (usual + 6 * np.sqrt(usual) + 4))) + 1, 0, 30).astype(np.uint8)


def prefixes(docs: DataFrame, width: int, percent: int, levels) -> DataFrame:
    """(token, node, n, pos, rare): the first order's prefix of every set, copies left out within a task."""
    names = ["token", "node", "n", "pos", "rare"]

    def run(batches):
        seen: set = set()
        table_of = levels.value
        for batch in batches:
            tokens, nodes, sizes, places, rares, counts = [], [], [], [], [], []
            for text in batch["text"].to_pylist():
                s = shingles(text, width)
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(node)
                o, rare = ordered(s, table_of, 0)
                k = prefix_length(len(s), percent)
                tokens.append(o[:k])
                places.append(np.arange(k))
                nodes.append(node)
                sizes.append(len(s))
                rares.append(rare)
                counts.append(k)
            if nodes:
                each = lambda x, t: pa.array(np.repeat(np.array(x, np.int64), counts), t)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), each(nodes, pa.int64()), each(sizes, pa.int32()), pa.array(np.concatenate(places), pa.int32()), each(rares, pa.int32())], names)

    return docs.select("text").mapInArrow(trimmed(run), "token long, node long, n int, pos int, rare int")


def possible(na, nb, ia, ib, percent: int):
    """Whether sizes and the places of a shared token allow the threshold (a pair's first shared token always does)."""
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * F.least(na - ia, nb - ib) >= percent * (na + nb))


def enough_shared(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """The pairs whose prefixes share as many tokens as the threshold needs.

    A common token that is not in both prefixes lies behind the prefix that ends first, so the intersection is at most
    the number of shared prefix tokens plus the longer of the two rests.
    """
    side = lambda name, to: lists.select(F.col("node").alias(name), F.col("tokens").alias(f"t{to}"), F.col("n").alias(f"n{to}"))
    need = F.ceil(percent * (F.col("n1") + F.col("n2")) / (100 + percent))
    rest = lambda n: F.ceil(percent * F.col(n) / 100) - 1  # noqa: E731  what lies behind the prefix
    shared = F.size(F.array_intersect("t1", "t2"))
    return pairs.join(side("a", 1), "a").join(side("b", 2), "b").filter(shared + F.greatest(rest("n1"), rest("n2")) >= need).select("a", "b")


def candidate_sets(docs: DataFrame, firsts: DataFrame, pairs: DataFrame, width: int, percent: int, levels) -> DataFrame:
    """(node, others, tokens): for nodes in pairs, the prefixes under the further orders and the whole set.

    Each node is read from the document with its smallest id. A bit table of fixed size over the ids lets most other
    documents go unread; it may let some through, whose digest then tells.
    """
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS)).cast("int")
    wanted = np.zeros(BITS, bool)
    wanted[firsts.join(nodes, "node", "left_semi").select(place("first").alias("bit")).distinct().toArrow()["bit"].to_numpy()] = True
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))
    others = pa.list_(pa.list_(pa.int32()))

    def run(batches):
        want, table_of = np.unpackbits(wanted.value).astype(bool), levels.value
        for batch in batches:
            out = [[], [], []]
            for text in batch.filter(pa.array(want[batch["bit"].to_numpy()]))["text"].to_pylist():
                s = shingles(text, width)
                if not len(s):
                    continue
                k = prefix_length(len(s), percent)
                out[0].append(node_of(s))
                out[1].append([(ordered(s, table_of, order)[0][:k] >> np.uint64(32)).astype(np.uint32).view(np.int32) for order in range(1, ORDERS)])
                out[2].append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], others), pa.array(out[2], pa.binary())], ["node", "others", "tokens"])

    read = docs.select("text", place("doc_id").alias("bit")).mapInArrow(trimmed(run), "node long, others array<array<int>>, tokens binary")
    return read.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def verified(docs: DataFrame, firsts: DataFrame, pairs: DataFrame, width: int, percent: int, levels) -> DataFrame:
    """The pairs (a, b) that pass the further orders' filters and whose whole sets reach the threshold."""
    sets = durable(candidate_sets(docs, firsts, pairs, width, percent, levels), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("others").alias("p"))
    right = sets.select(F.col("node").alias("b"), F.col("others").alias("q"))
    share = F.lit(True)
    for i in range(ORDERS - 1):
        share = share & F.arrays_overlap(F.col("p")[i], F.col("q")[i])
    close = pairs.join(left, "a").join(right, "b").filter(share).select("a", "b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    whole = close.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    return whole.select("a", "b", "x", "y").mapInArrow(trimmed(run), "a long, b long")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, root, carry…): component_id is the smallest id that links reach, links being pairs
    of documents with 100 * intersection >= percent * union; root tells components apart where ids are null and is null
    itself for an empty set. `carry` names further columns of docs to bring along."""
    spark = docs.sparkSession
    bounded_batches(spark)
    carry = list(carry)
    counted = durable(count_sets(docs, width, carry), "sizes")
    members = counted.filter("at IS NULL").select("doc_id", "node", "n", *carry)
    levels = spark.sparkContext.broadcast(rarity_levels(counted.filter("at IS NOT NULL").select("at", "cells", "task")))
    firsts = durable(members.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first")), "firsts")

    rows = durable(prefixes(docs, width, percent, levels), "prefixes")
    shared = rows.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("token")
    posted = durable(rows.join(shared, "token").distinct(), "postings")  # copies of a set met in several tasks count once
    forget(rows)
    lists = durable(posted.groupBy("node").agg(F.collect_set("token").alias("tokens"), F.max("n").alias("n")), "lists")

    lead = posted.groupBy("token").agg(F.min(F.struct("rare", "node", "n", "pos")).alias("l"))
    lo, hi = F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b")
    led = posted.join(lead, "token").filter((F.col("node") != F.col("l.node")) & possible(F.col("n"), F.col("l.n"), F.col("pos"), F.col("l.pos"), percent))
    stars = durable(enough_shared(led.select(lo, hi).distinct(), lists, percent), "candidates")
    links = durable(verified(docs, firsts, stars, width, percent, levels), "links")
    roots = durable(components(links), "roots")

    own = durable(posted.select("token", "node", "n", "pos").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    forget(posted)
    mixed = own.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("token")
    open_ = durable(own.join(mixed, "token"), "open")
    forget(own)
    x, y = open_.alias("x"), open_.alias("y")
    meet = (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & possible(F.col("x.n"), F.col("y.n"), F.col("x.pos"), F.col("y.pos"), percent)
    rest = x.join(y, meet).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    rest = durable(enough_shared(rest, lists, percent), "rest")
    forget(open_, lists, stars)
    if not rest.isEmpty():
        roots = durable(components(links.unionByName(verified(docs, firsts, rest, width, percent, levels))), "roots")

    rooted = durable(firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "classes")
    least = durable(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")  # a table, so that a root with many nodes can be split
    of = rooted.join(least, "root").select("node", "component_id", "root")
    found = members.join(of, "node", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "root", *carry)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85).drop("root")


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT a, b FROM c UNION ALL SELECT b, a FROM c),
cc(node, root) USING KEY (node) AS (SELECT doc_id, doc_id FROM s UNION (SELECT p.node, min(i.root) FROM recurring.cc p JOIN e x ON x.a = p.node JOIN cc i ON i.node = x.b WHERE i.root < p.root GROUP BY p.node))
SELECT doc_id, len(s)::BIGINT AS n_shingles, root AS component_id FROM s JOIN cc ON node = doc_id
"""
