"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A document's terms are its words (A-Z in lower case), its pairs of adjacent words, and the trigrams of its bytes'
classes (letters, digits, white space, each punctuation mark), all hashed into a fixed number of buckets. A pair of words
is hashed by the difference of their hashes, so a word said again gives the same term whichever word it is. The tf-idf
matrix over a bounded sample of labelled documents is reduced by a truncated singular value decomposition; the sample's
vectors are broadcast, every document's cosines with all of them are computed exactly in blocks, and the nearest ones
vote with their label, weighted by similarity and by how many labelled documents of its class each one stands for, so
that the sample's bound does not shift the classes' balance. Vectors are stored as whole numbers, so products are the
same in every block, and ties go to the sample's earlier row.

A null, empty or unreadable text has a zero vector, no neighbours, and scores the share of good ones among all labelled
documents. Repeated rows score alike. Without labelled rows every score is 1: nothing speaks against a document. Empty
tables give no rows; other columns of the input are not read. A word of more than PART bytes counts as several.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, remainder, table, texts_of
from .labelled import class_totals, fitted

PER_CLASS = 1500
RANK = 48
NEIGHBOURS = 15
BLOCK = 256
BITS = 15  # of a term's bucket; 16 at most
UNIT = 1 << 19  # what 1 is in a stored vector
WORD, PAIR, SHAPE = (np.uint32(k * 0x3C6EF372 & 0xFFFFFFFF) for k in (1, 2, 3))
CLASS = np.full(256, 30, np.uint8)  # other controls and marks
for _at, _marks in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", bytes(range(128, 256)), b"\t\r\x0b\x0c", *(bytes([c]) for c in b"!#$%&*+,-./:;<=>?@|~_'"), b"\"()[]{}`^\\"]):
    CLASS[list(_marks)] = _at
PART = 1 << 20


def bucket_of(hashes: np.ndarray, kind: np.uint32) -> np.ndarray:
    mixed = hashes + kind
    mixed ^= mixed >> np.uint32(15)
    return (mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def term_parts(raw: bytes):
    """The buckets of a text's terms, a bounded part of the text at a time."""
    at, last = 0, None
    while at < len(raw):
        end = len(raw)
        if end - at > PART:
            end = max(raw.rfind(b" ", at, at + PART), raw.rfind(b"\n", at, at + PART))
            end = end if end > at else at + PART
        c = CLASS[np.frombuffer(raw[at : min(end + 2, len(raw))], np.uint8)].astype(np.uint32)
        words = np.array([*last.tolist(), *map(xxhash.xxh32_intdigest, raw[at:end].lower().split())] if last is not None else [*map(xxhash.xxh32_intdigest, raw[at:end].lower().split())], np.uint32)
        own = words if last is None else words[len(last) :]
        yield np.concatenate([bucket_of((c[:-2] << np.uint32(10)) + (c[1:-1] << np.uint32(5)) + c[2:], SHAPE) if len(c) > 2 else c[:0], bucket_of(own.copy(), WORD), bucket_of(words[1:] - words[:-1], PAIR)])
        at, last = end, words[-1:]


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the text's terms and their frequencies per thousand bytes."""
    raw = text.encode()
    parts = [np.unique(p, return_counts=True) for p in term_parts(raw)]
    if len(parts) == 1:
        found, n = parts[0]
    else:
        counts = np.zeros(1 << BITS)
        for f, k in parts:
            counts[f] += k
        found = np.flatnonzero(counts)
        n = counts[found]
    return found.astype(np.int64), n * (1000 / max(1, len(raw)))


def sample_terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """terms in as few bytes as hold them, for a sample that lies in one task."""
    found, n = terms(text)
    return found.astype(np.uint16), n.astype(np.float32)


def weighted(found: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return np.log1p(n) * idf[found]


def latent(found: np.ndarray, n: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The unit vector of a document's terms in the latent space, as whole numbers of 1 / UNIT; zero without terms."""
    v = weighted(found, n, idf) @ basis[found]
    size = np.linalg.norm(v)
    return np.round(v * (UNIT / size)) if size > 0 else np.zeros(basis.shape[1])


def term_basis(rows: list[tuple[np.ndarray, np.ndarray]], width: int, rank: int, seed: int) -> np.ndarray:
    """(width, rank): the right singular vectors of the sparse unit rows (columns, values) with the largest singular values,
    by subspace iteration from random directions."""

    def times(m: np.ndarray) -> np.ndarray:
        return np.stack([v @ m[f] for f, v in rows])

    def transposed_times(m: np.ndarray) -> np.ndarray:
        out = np.zeros((width, m.shape[1]), np.float32)
        for (f, v), x in zip(rows, m, strict=True):
            out[f] += np.outer(v, x)
        return out

    start = np.random.default_rng(seed).normal(size=(width, min(rank + 16, width, len(rows)))).astype(np.float32)
    q = np.linalg.qr(times(start))[0]
    for _ in range(3):
        q = np.linalg.qr(times(transposed_times(q)))[0]
    return np.linalg.svd(transposed_times(q).T, full_matrices=False)[2][:rank].T


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: list[int], totals: list[int] | None = None, rank: int = RANK, seed: int = 3) -> dict | None:
    """idf and basis of the latent space, the sample's vectors, labels and weights, and the share of label 1, from the
    sample's terms.

    totals: how many documents of each class the sample stands for; its own numbers where None.
    """
    df = np.zeros(1 << BITS)
    for f, _ in rows:
        df[f] += 1
    used = np.flatnonzero(df)
    if not len(used):
        return None
    idf = np.zeros(1 << BITS, np.float32)
    idf[used] = np.log((1 + len(rows)) / (1 + df[used])) + 1
    units = []
    for f, n in rows:
        v = weighted(f, n, idf)
        units.append((np.searchsorted(used, f).astype(np.uint16), (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)))
    found = term_basis(units, len(used), rank, seed)
    basis = np.zeros((1 << BITS, found.shape[1]), np.float32)
    basis[used] = found
    sampled = np.bincount(y, minlength=2)
    all_ = sampled if totals is None else np.array(totals)
    weight = (all_ / np.maximum(sampled, 1))[np.array(y)]
    return {"idf": idf, "basis": basis, "sample": np.stack([latent(f, n, idf, basis) for f, n in rows]), "y": np.array(y, float), "weight": weight, "share": float(all_[1] / all_.sum())}


def votes(model: dict, v: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores of a block of stored vectors: mean label of each one's nearest sample vectors, weighted by similarity and by
    what each stands for. Products of whole numbers are exact, so a row's score does not depend on its block."""
    cos = v @ model["sample"].T
    room = 1 << max(1, (cos.shape[1] - 1).bit_length())
    key = cos * room + (room - 1 - np.arange(cos.shape[1]))  # no two alike; below 2 ** 53
    k = min(neighbours, cos.shape[1])
    near = np.argpartition(-key, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(key, near, axis=1), axis=1), axis=1)
    w = np.maximum(np.take_along_axis(cos, near, axis=1), 0) / UNIT**2 * model["weight"][near]
    total = w.sum(axis=1)
    return np.where(total > 0, np.clip((w * model["y"][near]).sum(axis=1) / np.maximum(total, 1e-12), 0, 1), model["share"])


def scores(model: dict | None, texts: list[str]) -> list[float]:
    if model is None:
        return [1.0] * len(texts)
    out: list[float] = []
    for at in range(0, len(texts), BLOCK):
        out += votes(model, np.stack([latent(*terms(t), model["idf"], model["basis"]) for t in texts[at : at + BLOCK]])).tolist()
    return out


def quality_scores(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, score) of every whole text; the broadcast's size is fixed by the sample's bound and the rank."""
    bounded_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores(known.value, texts_of(batch)), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def quality_model(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict | None:
    """Fitted on a bounded sample of labelled documents of each class, which stand for all of their class."""
    return fitted(docs, labels, "quality", per_class, sample_terms, partial(train, totals=class_totals(docs, labels, "quality")))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model(docs, table(spark, sf_dir, "labels").filter(remainder("doc_id", 4) != 2))
    return quality_scores(docs, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
