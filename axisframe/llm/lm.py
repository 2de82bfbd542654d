"""Language-model scores by deleted interpolation.

Bigram, unigram and uniform maximum-likelihood estimates of words are mixed; the weights depend on a bucket of the
context word's frequency and are learned by expectation-maximisation on the counts of a held-out part of the training
documents. Every word and every pair of adjacent words has its own count over all training documents, however rare;
the uniform estimate shares its mass among the known words and one for all unknown ones. A bucket holds the contexts
seen equally often, so a weight learned for contexts of so many fitting occurrences serves those of as many
occurrences in all training documents.

Documents are coded once into blocks of so many tokens, a part (fitting, held-out, other) each to itself. A block asks
for each of its distinct words and pairs once: the keys, sorted by hash, travel to the bucket that owns their range
of hashes, the bucket adds up what all blocks hold, and answers each block in the order that it asked in, so no key
travels back and no word or pair has its own row. Scores are then summed within blocks. A bucket holds a bounded
number of distinct keys, whatever the corpus; its number grows with the tokens. Words are counted by their bytes,
pairs by a 64-bit digest: among n distinct pairs two share a count with probability below n**2 / 2**65.

A null text is the empty text: one end token. Repeated rows are scored each. Without training rows every count is
0 and all scores are those of the empty model. Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, durable, mix, remainder, table

BLOCK = 1_000_000  # tokens of a block; a longer text has a block of its own
KEYS = 1_500_000  # tokens that one bucket stands for
END = b""  # no word is empty
FIT, HELD, OTHER = range(3)


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, then one end."""
    return [*(text or "").encode().lower().split(), END]


def squeezed(a: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def expanded(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def packed_words(words: list[bytes]) -> bytes | None:
    """Words as one compressed text; none as null, since the end alone is an empty text."""
    return zstandard.ZstdCompressor(level=3).compress(b" ".join(words)) if words else None


def unpacked_words(raw: bytes | None) -> list[bytes]:
    return [] if raw is None else zstandard.ZstdDecompressor().decompress(raw).split(b" ")


def coded_blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(block, part, ids, sizes, n, words, codes): documents of one part, each one's number of tokens and their sum, the
    distinct words (the end first), and every token's number among them. docs has doc_id, text and part."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        task, number, id_type = TaskContext.get().partitionId() << 32, 0, None
        fresh = lambda: ({END: 0}, [], [], [])  # noqa: E731  words, codes, ids, sizes
        open_, filled = [fresh() for _ in (FIT, HELD, OTHER)], [0, 0, 0]

        def closed(part):
            nonlocal number
            at, codes, ids, sizes = open_[part]
            columns = [[task + number], [part], [ids], [sizes], [filled[part]], [packed_words(list(at))], [squeezed(np.concatenate(codes))]]
            open_[part], filled[part], number = fresh(), 0, number + 1
            kinds = [pa.int64(), pa.int32(), pa.list_(id_type), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "part", "ids", "sizes", "n", "words", "codes"])

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, text, part in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["part"].to_pylist(), strict=True):
                words = tokens(text)
                if filled[part] and filled[part] + len(words) > block:
                    yield closed(part)
                filled[part] += len(words)
                at, codes, ids, sizes = open_[part]
                codes.append(np.fromiter((at.setdefault(w, len(at)) for w in words), np.uint32, len(words)))
                ids.append(doc_id)
                sizes.append(len(words))
        for part in (FIT, HELD, OTHER):
            if filled[part]:
                yield closed(part)

    return docs.select("doc_id", "text", "part").mapInArrow(run, f"block long, part int, ids array<{kind}>, sizes array<long>, n long, words binary, codes binary")


def pairs_of(words: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(digest, context, word, n, of): a block's distinct pairs in order of their digests, an end standing before each
    text's first word; words by number; `of` leads from each token to its pair."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    codes = codes.astype(np.int64)
    pair, of, n = np.unique(np.concatenate([[0], codes[:-1]]) * len(words) + codes, return_inverse=True, return_counts=True)
    context, word = pair // len(words), pair % len(words)
    digest = mix(mix(hashes[context]) + hashes[word])
    order = np.argsort(digest, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return digest[order], context[order], word[order], n[order], place[of]


def word_order(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes in order, and which word each belongs to."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    order = np.argsort(hashes, kind="stable")
    return hashes[order], order


def edges_of(digests: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range begins among sorted digests, and the end."""
    return np.searchsorted((digests >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))


REQUEST = ["bucket", "block", "part", "words", "word_counts", "pairs", "pair_counts"]
ANSWER = ["block", "bucket", "part", "words", "words_fit", "pairs", "pairs_fit", "v", "n", "n_fit"]


def requests(blocks: DataFrame, buckets: int) -> DataFrame:
    """A row for every block and bucket: the words and pairs of that range that the block holds, and how often."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words, codes = unpacked_words(row["words"]), expanded(row["codes"], np.uint32)
                digest, _, _, n, _ = pairs_of(words, codes)
                hashes, order = word_order(words)
                seen = np.bincount(codes, minlength=len(words))[order]
                out = []
                for b, (w0, w1, p0, p1) in enumerate(zip(*(e for x in (hashes, digest) for e in (edges_of(x, buckets)[:-1], edges_of(x, buckets)[1:])), strict=True)):
                    if w1 > w0 or p1 > p0:
                        keys = digest[p0:p1]
                        out.append((b, packed_words([words[i] for i in order[w0:w1]]), squeezed(seen[w0:w1]), squeezed(np.diff(keys, prepend=np.uint64(0))), squeezed(n[p0:p1])))
                b, *blobs = zip(*out, strict=True)
                same = lambda x, k: pa.array([x] * len(b), k)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), same(row["block"], pa.int64()), same(row["part"], pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], REQUEST)

    return blocks.select("block", "part", "words", "codes").mapInArrow(run, "bucket int, block long, part int, words binary, word_counts binary, pairs binary, pair_counts binary")


def totals(asked: pa.Table) -> pa.Table:
    """The answers of one bucket: for each block, in its order, how often training (and its fitting part, where the block
    is held out) has each word and pair; and one row without a block for the bucket's distinct and all training words."""
    rows, at = asked.to_pylist(), {}
    part = np.array([r["part"] for r in rows])
    words = [np.fromiter((at.setdefault(w, len(at)) for w in unpacked_words(r["words"])), np.int64) for r in rows]
    keys = [np.cumsum(expanded(r["pairs"], np.uint64), dtype=np.uint64) for r in rows]
    _, pairs = np.unique(np.concatenate(keys), return_inverse=True)
    out = []
    for ends, of, kind in ((np.cumsum([0, *map(len, words)]), np.concatenate(words), "word_counts"), (np.cumsum([0, *map(len, keys)]), pairs, "pair_counts")):
        n = np.concatenate([expanded(r[kind], np.int64) for r in rows])
        parts = np.repeat(part, np.diff(ends))
        size = int(of.max(initial=-1)) + 1
        fit, held = (np.bincount(of[parts == k], n[parts == k], size).astype(np.int64) for k in (FIT, HELD))
        out.append((ends, of, fit, fit + held))
    (word_ends, word_of, word_fit, word_train), (pair_ends, pair_of, pair_fit, pair_train) = out
    answers = []
    for k, r in enumerate(rows):
        w, p = word_of[word_ends[k] : word_ends[k + 1]], pair_of[pair_ends[k] : pair_ends[k + 1]]
        held = r["part"] == HELD
        answers.append((r["block"], r["bucket"], r["part"], squeezed(word_train[w]), squeezed(word_fit[w]) if held else None, squeezed(pair_train[p]), squeezed(pair_fit[p]) if held else None, None, None, None))
    answers.append((None, rows[0]["bucket"], None, None, None, None, None, int((word_train > 0).sum()), int(word_train.sum()), int(word_fit.sum())))
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4, *[pa.int64()] * 3]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*answers, strict=True), kinds, strict=True)], ANSWER)


def answered(block: pa.Table, answers: pa.Table) -> tuple:
    """(row, codes, pairs_of, words, pairs, words_fit, pairs_fit): one block with its words' and pairs' counts."""
    row = block.to_pylist()[0]
    words, codes = unpacked_words(row["words"]), expanded(row["codes"], np.uint32)
    rows = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
    joined = lambda c: np.concatenate([expanded(r[c], np.int64) for r in rows]) if rows[0][c] is not None else None
    order = word_order(words)[1]

    def by_word(c):
        found = joined(c)
        if found is None:
            return None
        out = np.empty(len(words), np.int64)
        out[order] = found
        return out

    return row, codes, pairs_of(words, codes), by_word("words"), joined("pairs"), by_word("words_fit"), joined("pairs_fit")


def bucket(context: np.ndarray) -> np.ndarray:
    """The bucket of a context's frequency: the length of its binary form."""
    return np.ceil(np.log2(context + 1)).astype(np.int64)


def em(b: np.ndarray, p: np.ndarray, count: np.ndarray, rounds: int) -> np.ndarray:
    """(buckets, 3): the weights that make `count` events with three estimates p in buckets b likeliest."""
    weights = np.full((65, 3), 1 / 3)
    weights[0] = 0, 0.5, 0.5
    for _ in range(rounds):
        share = weights[b] * p
        share *= (count / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        gained = np.stack([np.bincount(b, share[:, j], 65) for j in range(3)], axis=1)
        total = gained.sum(axis=1, keepdims=True)
        prior = (gained.sum(axis=0) + 1e-3) / (gained.sum() + 3e-3)  # for buckets that the held-out part lacks
        weights = np.where(total > 0, (gained + 1e-2 * prior) / (total + 1e-2), prior)
        weights[0] = [0, *(weights[0, 1:] / weights[0, 1:].sum())]
    return weights


def held_out_weights(blocks: DataFrame, answers: DataFrame, n_fit: int, n_words: int, rounds: int = 30) -> np.ndarray:
    """The weights that EM finds on all held-out pairs. Pairs of one bucket whose bigram and unigram estimates agree
    within an eighth of an octave count together, with their mean estimates: a bounded number of cells."""

    def cells(block: pa.Table, found: pa.Table) -> pa.Table:
        _, _, (_, h, w, n, _), _, _, words_fit, pairs_fit = answered(block, found)
        p = pairs_fit / np.maximum(words_fit[h], 1), words_fit[w] / max(n_fit, 1)
        cell = bucket(words_fit[h])
        for x in p:
            cell = cell * 1024 + np.where(x > 0, 1000 + np.floor(8 * np.log2(np.maximum(x, 1e-30))), 0).astype(np.int64)
        cell, i = np.unique(cell, return_inverse=True)
        return pa.table([pa.array(cell), *(pa.array(np.bincount(i, x, len(cell)).astype(float)) for x in (n.astype(float), n * p[0], n * p[1]))], ["cell", "n", "p1", "p2"])

    got = blocks.filter(F.col("part") == HELD).groupBy("block").cogroup(answers.filter(F.col("part") == HELD).groupBy("block")).applyInArrow(cells, "cell long, n double, p1 double, p2 double")
    got = got.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "p1", "p2"))).sort("cell").toArrow()
    cell, n, p1, p2 = (got[c].to_numpy() for c in ("cell", "n", "p1", "p2"))
    return em(cell >> 20, np.stack([p1 / n, p2 / n, np.full(len(n), 1 / n_words)], axis=1), n, rounds)


def learn_weights(pair: np.ndarray, fit: np.ndarray, held: np.ndarray, k: int, rounds: int = 30) -> np.ndarray:
    """(buckets, 3): weights of bigram, unigram and uniform estimates from `fit` that EM finds on `held`, for k words in
    memory and pair = k * context + word."""
    context = np.bincount(pair // k, fit, k)
    word = np.bincount(pair % k, fit, k)
    seen = held > 0
    pair, count = pair[seen], held[seen].astype(float)
    h, w = pair // k, pair % k
    p = np.stack([fit[seen] / np.maximum(context[h], 1), word[w] / max(word.sum(), 1), np.full(len(pair), 1 / k)], axis=1)
    return em(bucket(context)[h], p, count, rounds)


def log_matrix(pair: np.ndarray, n: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """log10 of the mixed probability of each of k words in memory after each."""
    context, word = np.bincount(pair // k, n, k), np.bincount(pair % k, n, k)
    mixture = weights[bucket(context)]
    out = mixture[:, 1:2] * (word / max(word.sum(), 1))[None, :] + mixture[:, 2:3] / k
    out[pair // k, pair % k] += mixture[pair // k, 0] * n / np.maximum(context[pair // k], 1)
    return np.log10(out).astype(np.float32)


def lm_scores(docs: DataFrame, train: str = "train", held: str = "held", block: int = BLOCK, keys: int = KEYS) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) for docs with boolean columns that say which
    rows train the model and which of these are held out of the estimates while the weights are learned."""
    spark = docs.sparkSession
    bounded_batches(spark)
    part = F.when(F.col(train), F.when(F.col(held), HELD).otherwise(FIT)).otherwise(OTHER)
    blocks = durable(coded_blocks(docs.select("doc_id", "text", part.alias("part")), block), "blocks")
    buckets = max(1, -(-(blocks.agg(F.sum("n").alias("n")).first()["n"] or 0) // keys))
    kinds = "block long, bucket int, part int, words binary, words_fit binary, pairs binary, pairs_fit binary, v long, n long, n_fit long"
    answers = durable(requests(blocks, buckets).groupBy("bucket").applyInArrow(totals, kinds), "answers")
    total = answers.filter("block IS NULL").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("v", "n", "n_fit"))).first()
    n_all, v_all = total["n"], total["v"]
    answers = answers.filter("block IS NOT NULL")
    weights = held_out_weights(blocks, answers, total["n_fit"], v_all + 1)
    id_type = docs.schema["doc_id"].dataType
    names = ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(of: pa.Table, found: pa.Table) -> pa.Table:
        row, codes, (_, h, w, _, pair_of), word_n, pair_n, _, _ = answered(of, found)
        mixture = weights[bucket(word_n[h])]
        p = mixture[:, 0] * pair_n / np.maximum(word_n[h], 1) + mixture[:, 1] * word_n[w] / max(n_all, 1) + mixture[:, 2] / (v_all + 1)
        starts = np.cumsum([0, *row["sizes"][:-1]])
        known, base, model = (np.add.reduceat(x, starts) for x in ((word_n > 0).astype(np.int64)[codes], np.log10((word_n + 1) / (n_all + v_all + 1))[codes], np.log10(p)[pair_of]))
        same = lambda x, k: pa.array([x] * len(starts), k)
        columns = [of["ids"].combine_chunks().flatten(), same(row["part"] != OTHER, pa.bool_()), pa.array(row["sizes"], pa.int64()), pa.array(known), same(n_all, pa.int64()), pa.array(base), pa.array(model)]
        return pa.table(columns, names)

    schema = f"doc_id {id_type.simpleString()}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training: remainder of 7 not 2; of these, remainder 3 is held out for the weights."""
    part = remainder("doc_id", 7)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (part != 2).alias("train"), (part == 3).alias("held"))
    out = lm_scores(docs)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
