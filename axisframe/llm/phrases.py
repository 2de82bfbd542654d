"""Phrase collocations by the stripes pattern.

A stripe belongs to a prefix, a phrase of k words, and counts the words that follow it. Every task counts its own stripes,
and stripes of one prefix are merged element by element in a tree of FAN tasks a node, so that no task takes the stripes of
all others for a frequent prefix. Merged stripes give all that is asked for: their counts are the frequencies of the phrases
of k + 1 words, the sum of a word's stripe (with the end of a piece as a follower) is the word's own frequency, and the
largest count says whether a longer phrase always takes the prefix's place.

Stripes of k words are counted level by level, k = 1 … longest - 1. A phrase can be frequent only if both phrases of one
word less in it are, so levels above the first count a phrase only where a bit table of fixed size has both. The table may
let others through, where it fills up all of them; the counts stay exact.

Words and phrases stand as 64-bit digests of good dispersion until they are frequent: among n different ones two
coincide with probability below n**2 / 2**65. Scores are exact for up to 10**14 words a language.

A null text is empty, a null language is `und`. Pieces end at `[.,;:!?]` and at line ends, words lie between spaces and
tabs; only A-Z are lower-cased. Repeated rows count again. Ties of score go to the greater frequency, then to the phrase
in the order of its UTF-8 bytes. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import B, bounded_batches, durable, forget, mix, table, trimmed

BITS = 1 << 24
FAN = 64  # tasks whose stripes of one prefix meet in one task
BLOCK = 2 << 20  # bytes of text split at once
HELD = 1 << 20  # entries a task gathers before it sums them, and holds before it passes them on
SALTS = 32  # parts of a language that are ranked side by side
BREAK = xxhash.xxh64_intdigest(b"\xff")  # the byte is in no UTF-8 text
TO_BREAK = bytes(0xFF if chr(c) in ".,;:!?\n\x0b\x0c\r" else c for c in range(256))
STRIPES = "prefix long, task int, follower array<long>, n array<long>, lang string, word string"


def blocks(texts: list[bytes]):
    """The words of the texts in lists of about BLOCK bytes of text; the byte 255 is a word that ends a piece."""
    at = 0
    while at < len(texts):
        size, start = 0, at
        while at < len(texts) and size < BLOCK:
            size += len(texts[at])
            at += 1
        yield b"\xff".join(texts[start:at]).lower().translate(TO_BREAK).replace(b"\xff", b" \xff ").split()


def summed(prefix, task, follower, n):
    """Entries of the same stripe and follower as one."""
    key = mix(mix(prefix + task * B) + follower)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    at = order[first]
    return prefix[at], task[at], follower[at], np.add.reduceat(n[order], first) if len(first) else n[:0]


def as_stripes(prefix, task, follower, n, names: dict) -> pa.RecordBatch:
    key = mix(prefix + task * B)
    order = np.argsort(key)
    first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]][: len(key)])
    ends = pa.array(np.r_[first, len(key)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x[order].view(np.int64))) for x in (follower, n)]
    at = order[first]
    of = [names.get(p, (None, None)) for p in prefix[at].tolist()] if names else [(None, None)] * len(at)
    words = [pa.array([x[i] for x in of], pa.string()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(prefix[at].view(np.int64)), pa.array(task[at].astype(np.int32)), *lists, *words], ["prefix", "task", "follower", "n", "lang", "word"])


def followers(words: np.ndarray, seed: np.uint64, k: int, known: np.ndarray | None):
    """(prefix, follower) of each place of a block where a phrase of k words stands; follower 0 is the end of the piece.

    With a table of known phrases only places whose first k words and last k words (of k + 1) are known.
    """
    ends = np.flatnonzero(words == np.uint64(BREAK))
    room = ends[np.searchsorted(ends, np.arange(len(words)))] - np.arange(len(words))  # words up to the piece's end
    phrase = mix(words + seed)
    for j in range(1, k):
        phrase = mix(phrase[:-1] + words[j : len(words)])
    if known is None:
        at = np.flatnonzero(room[: len(phrase)] >= k)
        return phrase[at], np.where(room[at] > k, words[np.minimum(at + k, len(words) - 1)], np.uint64(0))
    is_known = known[(phrase & np.uint64(BITS - 1)).astype(np.int64)]
    at = np.flatnonzero((room[: len(phrase) - 1] > k) & is_known[:-1] & is_known[1:]) if len(phrase) else np.arange(0)
    return phrase[at], words[at + k]


def count_stripes(docs: DataFrame, k: int, known: DataFrame | None) -> DataFrame:
    """Each task's stripes of all phrases of k words, `task` telling tasks apart in groups of FAN; language and word come
    along for single words."""
    spark, bits = docs.sparkSession, None
    if known is not None:
        place = F.pmod("phrase", F.lit(BITS))
        maps = known.groupBy(F.floor(place / 32768).cast("int").alias("at")).agg(F.bitmap_construct_agg((place % 32768).cast("long")).alias("bits")).toArrow()  # 512 rows of 4 KB at most
        table_of = np.zeros((BITS // 32768, 4096), np.uint8)
        for at, raw in zip(maps["at"].to_pylist(), maps["bits"].to_pylist(), strict=True):
            table_of[at] = np.frombuffer(raw, np.uint8)
        bits = spark.sparkContext.broadcast(table_of.tobytes())

    def run(batches):
        has = None if bits is None else np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").view(bool)
        task = np.uint64(TaskContext.get().partitionId() // FAN)
        none = np.zeros(0, np.uint64)
        held, names, waiting, new = (none, none, none, none.view(np.int64)), {}, [], 0

        def together():
            more = [np.concatenate(x) for x in zip(*waiting, strict=True)] if waiting else [none, none]
            return summed(*(np.concatenate(x) for x in zip(held, (more[0], np.full(len(more[0]), task), more[1], np.ones(len(more[0]), np.int64)), strict=True)))

        for batch in batches:
            langs = np.array([x if x is not None else "und" for x in batch["lang"].to_pylist()], object)
            texts = np.array([x or b"" for x in batch["text"].cast(pa.binary()).to_pylist()], object)
            for lang in set(langs.tolist()):
                seed = np.uint64(xxhash.xxh64_intdigest(lang.encode(), seed=1))  # unlike any word's digest
                for split in blocks(texts[langs == lang].tolist()):
                    split.append(b"\xff")
                    words = np.fromiter(map(xxhash.xxh64_intdigest, split), np.uint64, len(split))
                    if k == 1:
                        kinds, at = np.unique(words, return_index=True)
                        for p, i in zip(mix(kinds + seed).tolist(), at.tolist(), strict=True):
                            if p not in names:
                                names[p] = lang, split[i].decode() if split[i] != b"\xff" else ""
                    waiting.append(followers(words, seed, k, has))
                    new += len(waiting[-1][0])
                    if new >= HELD:
                        held, waiting, new = together(), [], 0
                        if len(held[0]) >= HELD:
                            yield as_stripes(*held, names)
                            held, names = (none, none, none, none.view(np.int64)), {}
        yield as_stripes(*together(), names)

    return docs.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(trimmed(run), STRIPES)


def merged(stripes: DataFrame, last: bool, least: int) -> DataFrame:
    """Stripes of one prefix and group of tasks as one. The last merge gives rows (prefix, lang, word, digest, total, phrase,
    follower, n): the stripe's sum and its followers with `least` occurrences, phrase being the digest of the two together."""
    names = ["prefix", "lang", "word", "digest", "total", "phrase", "follower", "n"]

    def finished(prefix, task, follower, n, of):
        key = np.argsort(prefix)
        prefix, follower, n = prefix[key], follower[key], n[key]
        first = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]][: len(prefix)])
        total = np.add.reduceat(n, first) if len(first) else n[:0]
        often = (n >= least) & (follower != 0)
        ends = pa.array(np.r_[0, np.cumsum(np.add.reduceat(often.astype(np.int64), first))].astype(np.int32) if len(first) else np.zeros(1, np.int32))
        phrase = mix(prefix[often] + follower[often])
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.view(np.int64))) for x in (phrase, follower[often], n[often])]
        words = [of.get(p, (None, None)) for p in prefix[first].tolist()]
        digest = [None if w is None else xxhash.xxh64_intdigest(w.encode()) for _, w in words]
        digest = pa.array(np.array([d or 0 for d in digest], np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(prefix[first].view(np.int64)), pa.array([x[0] for x in words], pa.string()), pa.array([x[1] for x in words], pa.string()), digest, pa.array(total), *lists], names)

    def run(batches):
        held, of = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.diff(batch["n"].offsets.to_numpy())
            prefixes, tasks = batch["prefix"].to_numpy().view(np.uint64), batch["task"].to_numpy().astype(np.uint64)
            new = np.repeat(prefixes, sizes), np.repeat(tasks, sizes), batch["follower"].flatten().to_numpy().view(np.uint64), batch["n"].flatten().to_numpy()
            if batch["word"].null_count < batch.num_rows:
                of |= {p: (a, w) for p, a, w in zip(prefixes.tolist(), batch["lang"].to_pylist(), batch["word"].to_pylist(), strict=True) if w is not None}
            held = summed(*(new if held is None else (np.concatenate(x) for x in zip(held, new, strict=True))))
            open_ = (held[0] == prefixes[-1]) & (held[1] == tasks[-1])  # rows come in order; more of this stripe may follow
            if not open_.all():
                done = [x[~open_] for x in held]
                yield finished(*done, of) if last else as_stripes(*done, of)
                held, of = tuple(x[open_] for x in held), {p: of[p] for p in (int(prefixes[-1]),) if p in of}
        if held is not None:
            yield finished(*held, of) if last else as_stripes(*held, of)

    sorted_rows = stripes.repartition("prefix", "task").sortWithinPartitions("prefix", "task")
    kind = "prefix long, lang string, word string, digest long, total long, phrase array<long>, follower array<long>, n array<long>" if last else STRIPES
    out = sorted_rows.mapInArrow(trimmed(run), kind)
    return out if last else out.withColumn("task", F.floor(F.col("task") / FAN).cast("int"))


def whole_stripes(docs: DataFrame, k: int, known: DataFrame | None, least: int) -> DataFrame:
    """The merged stripes of phrases of k words, as a table."""
    stripes, groups = count_stripes(docs, k, known), -(-docs.rdd.getNumPartitions() // FAN)
    while groups > 1:
        stripes, groups = merged(stripes, False, least), -(-groups // FAN)
    return durable(merged(stripes, True, least), f"stripes{k}")


def frequent_phrases(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f, top) of every phrase of up to so many words with f >= least, top being the largest frequency
    of the phrases one word longer that begin with it (null where none is frequent), and (lang, n) of all words."""
    stripes = whole_stripes(docs, 1, None, least)
    n = stripes.groupBy("lang").agg(F.sum("total").alias("n"))
    single = stripes.filter(F.col("total") >= least)
    word = durable(single.select("lang", "digest", "word"), "words")
    level = durable(single.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), F.col("total").alias("f"), "prefix"), "phrases1")
    out = []
    for k in range(1, longest + 1):
        if k > 1:
            if level.isEmpty():
                break
            if k < longest:
                stripes = whole_stripes(docs, k, level.select(F.col("prefix").alias("phrase")), least)
        tops = stripes.select("prefix", F.array_max("n").alias("top")).filter("top IS NOT NULL") if k < longest else None
        out.append((level if tops is None else level.join(tops, "prefix", "left")).select("lang", "phrase", "size", "f", (F.lit(None).cast("long") if tops is None else F.col("top")).alias("top")))
        if k < longest:
            grown = stripes.select("prefix", F.explode(F.arrays_zip("phrase", "follower", "n")).alias("e")).select("prefix", F.col("e.phrase").alias("id"), F.col("e.follower").alias("digest"), F.col("e.n").alias("f"))
            named = grown.join(level.select("prefix", "lang", "phrase"), "prefix").join(word, ["lang", "digest"])
            level = durable(named.select("lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), F.lit(k + 1).alias("size"), "f", F.col("id").alias("prefix")), f"phrases{k + 1}")
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return durable(every, "frequent"), n


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): for each language the `most` phrases of 2 to `longest` words with a >= least
    occurrences whose weakest cut scores highest, score = floor(1000 a n / (l r)); without phrases that a longer frequent
    one replaces everywhere."""
    bounded_batches(docs.sparkSession)
    known, n = frequent_phrases(docs, longest, least)
    words = F.split("phrase", " ", -1)
    part = lambda start, size: F.array_join(F.slice(F.col("words"), start, size), " ")
    phrases = known.filter("size >= 2").withColumn("words", words)
    inner = phrases.filter("size >= 3").select("lang", part(F.lit(2), F.col("size") - 1).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("before"))
    alone = phrases.join(inner, ["lang", "phrase"], "left").filter("coalesce(top, 0) < f AND coalesce(before, 0) < f")
    cuts = alone.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select("lang", "phrase", F.col("f").alias("a"), "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    whole = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    told = cuts.join(whole("first", "l"), ["lang", "first"]).join(whole("rest", "r"), ["lang", "rest"]).join(n, "lang")
    exact = F.expr("(CAST(a AS DECIMAL(14,0)) * CAST(1000 AS DECIMAL(4,0)) * CAST(n AS DECIMAL(18,0))) div (CAST(l AS DECIMAL(14,0)) * CAST(r AS DECIMAL(14,0)))")
    weakest = told.withColumn("score", exact).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = weakest.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(SALTS)))
    best = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= most)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, 6)) AS k)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
f AS (SELECT lang, phrase, any_value(k) AS k, count(*) AS f FROM g GROUP BY lang, phrase HAVING count(*) >= 100),
q AS (SELECT * FROM f WHERE k >= 2),
kept AS (SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM q y WHERE y.lang = q.lang AND y.k > q.k AND 100 * y.f >= 100 * q.f AND contains(' ' || y.phrase || ' ', ' ' || q.phrase || ' '))),
c AS (SELECT lang, phrase, f AS a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w FROM kept),
s AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n.n, c.cut, ((1000::HUGEINT * c.a * n.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ') JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
