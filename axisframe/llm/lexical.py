"""Ranked lexical search with posting lists cut into geometric blocks.

Documents stand as sparse vectors over the items' terms, and a document's score for an item is the inner product of its
values with the terms' weights. The index is dealt by documents: each task indexes CHUNK entries of its own documents at a
time, so no list passes through a shuffle or meets in one task. Three passes give exact results:

1. Vectors, and the counts N, L and df that weights and lengths need.
2. A floor for each item: the exact scores of the documents that hold its rarest terms. The k-th best of them is a score
   that the answer reaches at least. The same pass finds each term's largest value.
3. The search. An item's cheap terms, whose largest values together stay under the floor, cannot carry a document over it,
   so only the lists of its other terms are read. Each list is clustered: its pivots are documents of the list, one for BLOCK
   members, and every member joins the pivot it is most similar to (cosine of random projections). A block's summary is the
   coordinatewise maximum of its documents over the terms of the items that read the list; its product with an item's
   weights bounds every score in the block. A block is skipped only if this bound is below the floor; all other members
   are scored in full.

All rows of one item_id together are one item, its terms counting once. A null or empty text has no terms: as an item it
gets no rows, as a document it is in no count. Each row of the documents is a document of its own, so repeated rows appear
as often as they stand there. Ties go to the smaller doc_id, null ids last. Empty tables give no rows; other columns are
not read. Items are searched ITEMS at a time, so what is broadcast (their terms) has a bound for items of bounded length.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, durable, forget, table, trimmed

ITEMS = 1000
CHUNK = 1 << 20  # entries of document vectors that a task indexes at once
BLOCK = 64  # members of a list for one pivot
SEEDS = 64  # documents that hold an item's rarest terms, all with the last of these terms included
WIDTH = 16  # of the projections that cluster a list
TEXT = 2 << 20  # bytes of text split at once
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
END = b"\xff"  # stands in no UTF-8 text


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, term), each once."""

    def run(batches):
        for batch in batches:
            words = [sorted(set((x or b"").translate(FOLD).split())) for x in batch["text"].cast(pa.binary()).to_pylist()]
            at = np.repeat(np.arange(len(words)), [len(w) for w in words])
            yield pa.RecordBatch.from_arrays([batch["item"].take(pa.array(at)), pa.array([w.decode() for ws in words for w in ws], pa.string())], ["item", "term"])

    kind = items.schema[item].dataType.simpleString()
    return items.select(F.col(item).alias("item"), F.col(text).alias("text")).mapInArrow(run, f"item {kind}, term string").distinct()


def vectors(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Rows (doc_id, n, terms, tfs) of the documents that hold a term, n being the document's terms with repeats; and rows (term,
    count) of each task: df of a term, N for term -1 and L for term -2."""
    place = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(terms)} | {END: -2})
    width, names = len(terms), ["doc_id", "n", "terms", "tfs", "term", "count"]

    def run(batches):
        get, df, of_all, kind = place.value.get, np.zeros(width, np.int64), np.zeros(2, np.int64), None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            raw, at = [x or b"" for x in batch["text"].cast(pa.binary()).to_pylist()], 0
            while at < len(raw):
                start, size = at, 0
                while at < len(raw) and size < TEXT:
                    size += len(raw[at])
                    at += 1
                words = b" \xff ".join(raw[start:at]).translate(FOLD).split()
                words.append(END)
                ids = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                ends = np.flatnonzero(ids == -2)
                n = np.diff(np.r_[-1, ends]) - 1
                of_all += (n > 0).sum(), n.sum()
                of = np.repeat(np.arange(len(n)), n + 1)
                key, tf = np.unique(of[ids >= 0] * width + ids[ids >= 0], return_counts=True)
                doc, term = key // width, key % width
                df += np.bincount(term, minlength=width)
                first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]][: len(doc)])
                cuts = pa.array(np.r_[first, len(doc)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (term, tf)]
                has, none = doc[first], pa.nulls(len(first), pa.int32())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(has + start)), pa.array(n[has]), *lists, none, pa.nulls(len(first), pa.int64())], names)
        if kind is not None:
            found = np.flatnonzero(df)
            at, count = np.r_[found, -1, -2].astype(np.int32), np.r_[df[found], of_all]
            lists = [pa.nulls(len(at), pa.list_(pa.int32()))] * 2
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), kind), pa.nulls(len(at), pa.int64()), *lists, pa.array(at), pa.array(count)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, n long, terms array<int>, tfs array<int>, term int, count long")


def rows_at(cuts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the entries of some rows one after another, and where each row starts among them."""
    sizes = cuts[rows + 1] - cuts[rows]
    starts = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(cuts[rows] - starts, sizes), starts


class Chunk:
    """Some documents' vectors by document and, for each term, its list of documents."""

    def __init__(self, batches: list[pa.RecordBatch], number: int, length: int, width: int):
        rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        self.ids = rows["doc_id"]
        self.cuts = rows["terms"].offsets.to_numpy().astype(np.int64) - rows["terms"].offsets[0].as_py()
        self.term, tf = (rows[c].flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
        sizes = np.diff(self.cuts)
        m = 10 + 90 * rows["n"].to_numpy() * number // length
        self.value = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes))
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.order = np.argsort(self.term, kind="stable")
        self.term_cuts = np.r_[0, np.cumsum(np.bincount(self.term, minlength=width))]

    def holders(self, term: int) -> np.ndarray:
        return self.doc[self.order[self.term_cuts[term] : self.term_cuts[term + 1]]]

    def largest(self) -> tuple[np.ndarray, np.ndarray]:
        """The terms of the chunk and the largest value of each."""
        found = np.flatnonzero(np.diff(self.term_cuts))
        return found, np.maximum.reduceat(self.value[self.order], self.term_cuts[found]) if len(found) else found

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        at, starts = rows_at(self.cuts, docs)
        return np.add.reduceat(weights[self.term[at]] * self.value[at], starts) if len(docs) else docs

    def projected(self, weights: np.ndarray) -> np.ndarray:
        """Unit vectors of WIDTH numbers whose products are near the documents' cosines."""
        signs = np.random.default_rng(11).choice(np.array([-1, 1], np.float32), (len(weights), WIDTH))
        out = np.zeros((len(self.cuts) - 1, WIDTH), np.float32)
        for start in range(0, len(out), 1000):
            lo, hi = self.cuts[start], self.cuts[min(start + 1000, len(out))]
            parts = signs[self.term[lo:hi]] * (weights[self.term[lo:hi]] * self.value[lo:hi]).astype(np.float32)[:, None]
            out[start : start + 1000] = np.add.reduceat(parts, self.cuts[start : min(start + 1000, len(out))] - lo, axis=0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def chunks(batches, number: int, length: int, width: int):
    held, size = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 256):  # a document has at most as many entries as there are terms
            held.append(batch.slice(start, 256))
            size += len(held[-1]["terms"].flatten())
            if size >= CHUNK:
                yield Chunk(held, number, length, width)
                held, size = [], 0
    if size:
        yield Chunk(held, number, length, width)


def best(ids: pa.Array, docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores above 0, ties to smaller ids, nulls last."""
    docs, scores = docs[scores > 0], scores[scores > 0]
    if len(docs) > k:
        kept = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        docs, scores = docs[kept], scores[kept]
    ranked = pa.table({"s": pa.array(scores), "i": ids.take(pa.array(docs)), "d": pa.array(docs)}).sort_by([("s", "descending"), ("i", "ascending")])
    return ranked["d"].to_numpy()[:k], ranked["s"].to_numpy()[:k]


def clusters(points: np.ndarray) -> np.ndarray:
    """The block of each member of a list: its most similar pivot, pivots being members at even distances."""
    count = -(-len(points) // BLOCK)
    pivots = points[np.arange(count) * len(points) // count]
    return np.concatenate([(points[i : i + 4096] @ pivots.T).argmax(axis=1) for i in range(0, len(points), 4096)])


def floors(rows: DataFrame, shared, k: int) -> DataFrame:
    """Rows (item, term, value): up to k exact scores an item and task, and each task's largest value of a term."""

    def run(batches):
        weights, lists, seeds, number, length = shared.value
        for chunk in chunks(batches, number, length, len(weights)):
            items, values = [], []
            for i, terms in enumerate(lists):
                docs = np.unique(np.concatenate([chunk.holders(t) for t in seeds[i]])) if len(seeds[i]) else np.arange(0)
                if len(docs):
                    own = np.zeros(len(weights), np.int64)
                    own[terms] = weights[terms]
                    values.append(np.sort(chunk.scores(docs, own))[-k:])
                    items.append(np.full(len(values[-1]), i))
            term, most = chunk.largest()
            item = np.concatenate([*items, np.full(len(term), -1)]).astype(np.int32)
            term = np.concatenate([np.full(len(item) - len(term), -1), term]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(term), pa.array(np.concatenate([*values, most]).astype(np.int64))], ["item", "term", "value"])

    return rows.select("doc_id", "n", "terms", "tfs").mapInArrow(trimmed(run), "item int, term int, value long")


def needed_terms(terms: np.ndarray, most: np.ndarray, floor: int) -> np.ndarray:
    """An item's terms without the cheapest, whose largest scores together stay under the floor."""
    order = np.argsort(most[terms], kind="stable")
    return terms[order][np.cumsum(most[terms][order]) >= max(1, floor)]


def found_in(chunk: Chunk, weights, lists, readers, floor, k: int):
    """(item, documents, scores) of the chunk's candidates for the answer, and (blocks, blocks skipped) over all lists and items."""
    points, wanted = chunk.projected(weights), [[] for _ in lists]
    column, seen = np.full(len(weights), -1), np.zeros(2, np.int64)
    for term, items in readers.items():
        docs = chunk.holders(term)
        if not len(docs):
            continue
        block = clusters(points[docs])
        terms = np.unique(np.concatenate([lists[i] for i in items]))
        column[terms] = np.arange(len(terms))
        at, _ = rows_at(chunk.cuts, docs)
        of = np.repeat(block, chunk.cuts[docs + 1] - chunk.cuts[docs])
        used = column[chunk.term[at]] >= 0
        summary = np.zeros((block.max() + 1, len(terms)), np.int64)
        np.maximum.at(summary, (of[used], column[chunk.term[at[used]]]), chunk.value[at[used]])
        queries = np.zeros((len(terms), len(items)))
        for j, i in enumerate(items):
            queries[column[lists[i]], j] = weights[lists[i]]
        open_ = summary.astype(float) @ queries >= floor[items]  # sums stay far under 2**53, so they are exact
        column[terms] = -1
        seen += open_.size, open_.size - open_.sum()
        for j, i in enumerate(items):
            if open_[:, j].any():
                wanted[i].append(docs[open_[block, j]])
    out = []
    for i, parts in enumerate(wanted):
        if parts:
            own = np.zeros(len(weights), np.int64)
            own[lists[i]] = weights[lists[i]]
            docs = np.unique(np.concatenate(parts))
            scores = chunk.scores(docs, own)
            docs, scores = best(chunk.ids, docs[scores >= floor[i]], scores[scores >= floor[i]], k)
            out.append((i, docs, scores))
    return out, seen


def ranked_block(docs: DataFrame, named: list, lists: list[list[str]], kind: T.DataType, k: int, report: bool) -> DataFrame:
    """The answer for a block of items, given their ids and terms."""
    spark = docs.sparkSession
    terms = sorted({t for ts in lists for t in ts})
    at = {t: i for i, t in enumerate(terms)}
    lists = [np.array([at[t] for t in ts], np.int64) for ts in lists]
    every = durable(vectors(docs, terms), "vectors")
    counts = {r["term"]: r["n"] for r in every.filter("term IS NOT NULL").groupBy("term").agg(F.sum("count").alias("n")).toLocalIterator()}
    number, length = counts.pop(-1, 0), counts.pop(-2, 0)
    df = np.array([counts.get(i, 0) for i in range(len(terms))], np.int64)
    weights = np.array([math.floor(1000 * math.log((2 * number + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    seeds = []
    for ts in lists:
        rare = ts[df[ts] > 0][np.argsort(df[ts[df[ts] > 0]], kind="stable")]
        seeds.append(rare[: int(np.searchsorted(np.cumsum(df[rare]), SEEDS)) + 1])
    rows = every.filter("term IS NULL")
    told = durable(floors(rows, spark.sparkContext.broadcast((weights, lists, seeds, number, length)), k), "floors")
    most = np.zeros(len(terms), np.int64)
    for r in told.filter("item < 0").groupBy("term").agg(F.max("value").alias("v")).toLocalIterator():
        most[r["term"]] = r["v"] * weights[r["term"]]
    kth = told.filter("item >= 0").withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("value")))).filter(F.col("r") == k)
    floor = np.zeros(len(lists), np.int64)
    for r in kth.toLocalIterator():
        floor[r["item"]] = r["value"]
    readers: dict[int, list[int]] = {}
    for i, ts in enumerate(lists):
        for t in needed_terms(ts, most, int(floor[i])).tolist():
            readers.setdefault(t, []).append(i)
    shared = spark.sparkContext.broadcast((weights, lists, readers, floor, number, length))

    def run(batches):
        weights, lists, readers, floor, number, length = shared.value
        for chunk in chunks(batches, number, length, len(weights)):
            out, seen = found_in(chunk, weights, lists, readers, floor, k)
            if report:
                yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in (*seen, sum(len(d) for _, d, _ in out), len(chunk.ids))], ["blocks", "skipped", "kept", "documents"])
            elif out:
                item = np.concatenate([np.full(len(d), i, np.int32) for i, d, _ in out])
                yield pa.RecordBatch.from_arrays([pa.array(item), chunk.ids.take(pa.array(np.concatenate([d for _, d, _ in out]))), pa.array(np.concatenate([s for *_, s in out]).astype(np.int64))], ["item", "doc_id", "score"])

    read = rows.select("doc_id", "n", "terms", "tfs")
    if report:
        return read.mapInArrow(trimmed(run), "blocks long, skipped long, kept long, documents long")
    found = read.mapInArrow(trimmed(run), f"item int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(named)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)]))
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def lexical_top_k(docs: DataFrame, items: DataFrame, k: int = 10, report: bool = False) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents with the highest scores above 0. With `report` the counts (blocks,
    skipped, kept, documents) of each chunk instead, blocks and skips counted for each item that reads the list."""
    spark = docs.sparkSession
    bounded_batches(spark)
    terms = durable(item_terms(items, "item_id", "text"), "items")
    kind = items.schema["item_id"].dataType
    parts = max(1, -(-terms.select("item").distinct().count() // ITEMS))
    answers = []
    for part in range(parts):
        own = terms.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).groupBy("item").agg(F.sort_array(F.collect_list("term")).alias("terms")).toArrow()
        if own.num_rows:
            answers.append(ranked_block(docs, own["item"].to_pylist(), own["terms"].to_pylist(), kind, k, report))
    if not answers:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.LongType())]))
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
s AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
w AS (SELECT t, floor(1000 * ln((2 * s.n + 2) / (2 * df + 1)))::BIGINT AS w FROM f, s),
v AS (SELECT doc_id, t, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * p.n * s.n) // s.l)) AS v FROM p, s),
r AS (SELECT item_id, doc_id, sum(w.w * v.v)::BIGINT AS score FROM q JOIN w ON w.t = q.t JOIN v ON v.t = q.t GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
