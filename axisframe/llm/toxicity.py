"""Toxicity by subword bags: embeddings of character n-grams averaged into a linear softmax, trained jointly in numpy.

A bag is a window of words; a document is as toxic as its most toxic window, so a few words in a long text are not
averaged away, and its score is the softmax's probability of that window. Which window of a toxic document is toxic is
learned in turns: the model picks each document's highest windows, and is fitted again on them. A misspelling shares
most character n-grams with the word it hides.

A null or empty text has no window and scores 0. Repeated rows score alike. Without labelled rows of both classes
every score is 0. Empty tables give no rows; other columns of the input are not read. Texts longer than PART bytes
are read in parts cut at white space, with windows across the cuts; the margins are whole numbers of 2 ** -SHIFT, so
that parts change no sum.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, remainder, table, texts_of
from .labelled import fitted

BUCKETS = 1 << 17
SIDE = 8  # embedding width
WINDOW = 8  # words
PER_CLASS = 1500
TURNS, TURN = 6, 25  # choices of windows, and steps on each
PART = 1 << 18
SHIFT = 24
STEPS = np.array([0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0x9E3779B1], dtype=np.uint32)
LEAST = 64  # n-grams of a bag; shorter bags are filled with grams of value 0
BREAK = re.compile(rb"\s")


def parts_of(text: str) -> list[bytes]:
    """The words of the lower-case text as UTF-8, in parts that end at the first white space after PART bytes. Every part
    after the first starts with the last WINDOW - 1 words before it and has new words, and where there are several, each
    has WINDOW words at least: their windows are those of the whole text."""
    raw, out, words, start = text.lower().encode(), [], [], 0
    while start < len(raw):
        found = BREAK.search(raw, start + PART)
        end = found.start() if found else len(raw)
        new = raw[start:end].split()
        words, start = words + new, end
        if new and len(words) >= WINDOW:
            out.append(b" ".join(words))
            words = words[1 - WINDOW :]
    return out or [b" ".join(words)]


def grams(raw: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of all character n-grams of 3 to 5 bytes that lie in one word with its bounds; each one's word; number of words."""
    words = raw.split()
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    space = b == 32
    word = np.cumsum(space) - 1
    b32 = b.astype(np.uint32)
    code = b32[:-2] * STEPS[0] + b32[1:-1] * STEPS[1] + b32[2:] * STEPS[2] if len(b) > 2 else np.zeros(0, np.uint32)
    buckets, of = [], []
    for n in (3, 4, 5):
        if n > 3:
            code = code[:-1] + b32[n - 1 :] * STEPS[n - 1] if len(b) >= n else np.zeros(0, np.uint32)
        first = word[1 : 1 + len(code)]
        i = np.flatnonzero((first == word[n - 2 : n - 2 + len(code)]) & ~space[1 : 1 + len(code)])
        mixed = code[i] + np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)
        mixed ^= mixed >> np.uint32(15)
        buckets.append((mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - 17))
        of.append(first[i])
    return np.concatenate(buckets), np.concatenate(of), len(words)


def gathered(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, ends) of each text: its n-grams word by word, and where each word's end; the buckets are slices of one
    array, sized beforehand and as narrow as the numbers allow."""
    room = 3 * sum(len(t.lower().encode()) + 2 for t in texts)
    buckets, end, out = np.empty(room, np.int32), 0, []
    for t in texts:
        b, w, n = grams(t.lower().encode())
        buckets[end : end + len(b)] = b[np.argsort(w, kind="stable")]
        out.append((buckets[end : end + len(b)], np.concatenate([[0], np.cumsum(np.bincount(w, minlength=n))]).astype(np.int32)))
        end += len(b)
    return out


def windows(values: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """The mean value of the n-grams of each window of WINDOW words, a window for every word that one can start at; values
    are whole numbers."""
    if not n:
        return np.zeros(0)
    total = np.concatenate([[0], np.cumsum(np.bincount(word, values, n).astype(np.int64))])  # exact below 2 ** 53
    return means(total, np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n))]))


def means(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The windows' means from running sums and numbers of n-grams, each with a first 0."""
    start = np.arange(max(1, len(total) - WINDOW))
    end = np.minimum(start + WINDOW, len(total) - 1)
    return (total[end] - total[start]) / np.maximum(count[end] - count[start], LEAST)


class Bags:
    """Bags of n-gram buckets with labels, for training."""

    def __init__(self, bags: list[np.ndarray], y: np.ndarray):
        self.y = y
        self.size = np.array([max(LEAST, len(b)) for b in bags], dtype=np.float32)
        self.bag = np.repeat(np.arange(len(bags), dtype=np.int32), [len(b) for b in bags])
        self.bucket = np.concatenate(bags) if bags else np.zeros(0, np.int32)


def loss_and_slopes(bags: Bags, embed: np.ndarray, out: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean cross-entropy of the softmax, the classes counting alike, and its slopes in embeddings and output weights
    (the last row of `out` is the bias)."""
    weight = np.where(bags.y == 1, 0.5 / max(1, (bags.y == 1).sum()), 0.5 / max(1, (bags.y == 0).sum()))
    target = np.stack([1 - bags.y, bags.y], axis=1)
    scalar = embed @ out[:SIDE]
    logits = np.stack([np.bincount(bags.bag, scalar[bags.bucket, c], len(bags.y)) / bags.size for c in (0, 1)], axis=1) + out[SIDE]
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    slope = (p - target) * weight[:, None]
    per_gram = (slope / bags.size[:, None])[:, 1]
    g = np.bincount(bags.bucket, per_gram[bags.bag], len(embed))  # of class 1; class 0 has the opposite
    half = embed.T @ g
    loss = float(-(weight * np.log(np.maximum(p[np.arange(len(p)), bags.y], 1e-300))).sum())
    return loss, g[:, None] * (out[:SIDE, 1] - out[:SIDE, 0]), np.vstack([np.stack([-half, half], axis=1), slope.sum(axis=0)])


def fit(bags: Bags, embed: np.ndarray, out: np.ndarray, steps: int, rate: float = 0.05) -> None:
    """Adam on embeddings and output weights together."""
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (embed, out)]
    for t in range(1, steps + 1):
        _, g_embed, g_out = loss_and_slopes(bags, embed, out)
        for x, grad, (m, v) in zip((embed, out), (g_embed + 1e-7 * embed, g_out), state, strict=True):
            m += (0.1 * (grad - m)).astype(np.float32)
            v += (0.001 * (grad * grad - v)).astype(np.float32)
            x -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)).astype(np.float32)


def highest(w: np.ndarray, most: int) -> list[int]:
    """The starts of the highest windows that share no word."""
    w, out = w.copy(), []
    while len(out) < most and len(w) and (k := int(w.argmax())) >= 0 and w[k] > -np.inf:
        out.append(k)
        w[max(0, k - WINDOW + 1) : k + WINDOW] = -np.inf
    return out


def train(texts: list[str], y: list[int], seed: int = 7) -> dict | None:
    """The margin of class 1 that each bucket adds, in units of 2 ** -SHIFT, and the softmax's bias."""
    y = np.array(y)
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    docs = gathered(texts)
    used = np.zeros(BUCKETS, bool)
    for b, _ in docs:
        used[b] = True
    used = np.flatnonzero(used)
    for b, _ in docs:
        b[:] = np.searchsorted(used, b)
    embed = rng.normal(0, 0.1, (len(used), SIDE)).astype(np.float32)
    out = np.vstack([rng.normal(0, 0.5, (SIDE, 2)), np.zeros(2)]).astype(np.float32)

    def margins():
        return np.round((embed @ (out[:SIDE, 1] - out[:SIDE, 0])).astype(float) * 2**SHIFT).astype(np.int64)

    def bag(d, k):
        bucket, ends = docs[d]
        return bucket[ends[min(k, len(ends) - 1)] : ends[min(k + WINDOW, len(ends) - 1)]]

    chosen, labels = [], []
    for d, (_, ends) in enumerate(docs):  # first turn: windows anywhere
        for k in rng.integers(0, max(1, len(ends) - WINDOW), 6):
            chosen.append(bag(d, k))
            labels.append(y[d])
    fit(Bags(chosen, np.array(labels)), embed, out, TURN)
    for _ in range(TURNS):
        v, chosen, labels = margins(), [], []
        for d, (bucket, ends) in enumerate(docs):
            w = means(np.concatenate([[0], np.cumsum(v[bucket])])[ends], ends) if len(ends) > 1 else np.zeros(0)
            more = rng.integers(0, len(w), 2) if len(w) and not y[d] else []
            for k in [*highest(w, 1 if y[d] else 6), *more]:
                chosen.append(bag(d, int(k)))
                labels.append(y[d])
        fit(Bags(chosen, np.array(labels)), embed, out, TURN)
    margin = np.zeros(BUCKETS, np.int64)
    margin[used] = margins()
    return {"margin": margin, "bias": float(out[SIDE, 1] - out[SIDE, 0])}


def score(model: dict | None, text: str) -> float:
    """The softmax's probability of class 1 for the text's most toxic window."""
    if model is None:
        return 0.0
    best = -np.inf
    for raw in parts_of(text):
        bucket, word, n = grams(raw)
        if n:
            best = max(best, windows(model["margin"][bucket], word, n).max())
    return float(1 / (1 + np.exp(np.clip(-best / 2**SHIFT - model["bias"], -700, 700)))) if best > -np.inf else 0.0


def toxicity_scores(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, score) of every whole text; the model's size is fixed by its number of buckets."""
    bounded_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            m = known.value
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([score(m, t) for t in texts_of(batch)], pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity_model(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict | None:
    """Fitted on a bounded sample of labelled documents of each class."""
    return fitted(docs, labels, "toxic", per_class, str, train)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0))
    return toxicity_scores(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
