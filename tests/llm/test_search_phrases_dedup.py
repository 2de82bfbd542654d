"""Ranked search, phrases and MinHash against plain versions, with the edge cases that their docstrings state."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from axisframe.llm import jaccard, lexical, minhash, phrases

from .conftest import frame


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=10):
    told = [(i, words_of(t)) for i, t in docs]
    told = [(i, w) for i, w in told if w]
    n, total = len(told), sum(len(w) for _, w in told)
    df = Counter(t for _, w in told for t in set(w))
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(words_of(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, w in told:
            tf, m = Counter(w), 10 + 90 * len(w) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms if tf[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def searched(spark, docs, items, **options):
    found = lexical.lexical_top_k(docs, spark.createDataFrame(items, "item_id long, text string, rank int"), **options)
    return sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_search_on_edge_rows(spark, edge, empty, edge_rows):
    items = [(1, "alpha BETA 日本", 0), (1, "zeta", 0), (2, None, 0), (3, "", 0), (4, "nowhere to be found", 0), (None, "é x", 0), (5, "... 123 !", 0), (1, "alpha BETA 日本", 0)]
    assert searched(spark, edge, items) == plain_search(edge_rows, [(i, t) for i, t, _ in items])
    assert searched(spark, empty, items) == []
    assert lexical.lexical_top_k(edge, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_search_with_small_chunks_and_many_items(spark, monkeypatch):
    rng = random.Random(3)
    topics = [[f"t{k}w{i}" for i in range(12)] for k in range(8)]
    docs = []
    for i in range(600):
        own = rng.choice(topics)
        docs.append((i, " ".join(rng.choices(own, k=rng.randrange(3, 30)) + rng.choices(["the", "of", "and"], k=rng.randrange(1, 9)))))
    docs += [(700 + i, docs[5][1]) for i in range(40)]  # ties
    items = [(i, " ".join(rng.sample(rng.choice(topics), 4) + ["the", "of"])) for i in range(30)]
    want = plain_search(docs, items)
    table = frame(spark, docs).repartition(3)
    given = [(i, t, 0) for i, t in items]
    assert searched(spark, table, given) == want
    monkeypatch.setattr(lexical, "ITEMS", 7)
    assert searched(spark, table, given) == want


def test_bounds_hold_and_blocks_are_skipped():
    """Every score in a block is at most its bound; documents of other topics are left out unread."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    topics, width = 40, 200
    term = [np.sort(np.unique(np.concatenate([rng.choice(5, 3, replace=False) + 5 * (d % topics), [199]]))).astype(np.int32) for d in range(4000)]
    cuts = np.r_[0, np.cumsum([len(t) for t in term])].astype(np.int32)
    tfs = rng.integers(1, 4, cuts[-1]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (np.concatenate(term), tfs)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4000)), pa.array(np.full(4000, 9)), *lists], ["doc_id", "n", "terms", "tfs"])
    chunk = lexical.Chunk([batch], 4000, 36_000, width)
    weights = rng.integers(1000, 5000, width)
    queries = [np.array([5 * t, 5 * t + 1, 5 * t + 2, 199]) for t in range(10)]
    readers = {199: list(range(10))}
    best = [np.sort(chunk.scores(np.arange(4000), np.bincount(q, weights[q], width).astype(np.int64)))[::-1] for q in queries]
    floor = np.array([int(b[9]) for b in best])
    out, (blocks, skipped) = lexical.found_in(chunk, weights, queries, readers, floor, 10)
    assert [sorted(s.tolist(), reverse=True) for _, _, s in out] == [b[:10].tolist() for b in best]
    assert skipped > blocks / 2


def plain_phrases(rows, least, most=2000, longest=5):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    kept = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    rows = []
    for (lang, p), a in kept.items():
        if any(x == lang and len(q) > len(p) and b >= a and inside(p, q) for (x, q), b in kept.items()):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        rows.append((lang, -score, -a, " ".join(p).encode(), l, r))
    out, at = [], Counter()
    for lang, s, a, p, l, r in sorted(rows):
        at[lang] += 1
        if at[lang] <= most:
            out.append((lang, at[lang], p.decode(), -a, l, r, n[lang], -s))
    return out


def phrase_rows(spark, rows, **options):
    table = spark.createDataFrame([(i, t, x, 1, 2) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, n int, rank int").repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(table, **options).collect())


def phrase_corpus(seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        w = rng.choices(["A", "b", "c", "É", "new", "york", "city", "hall"], weights=[6, 5, 4, 1, 1, 1, 1, 1], k=40)
        w[rng.randrange(30)] = rng.choice(["New York", "new york city hall", "b; c", "x\ty", "a.b,c\r\nd"])
        rows.append((rng.choice(["en", "fr", None]), " ".join(w)))
    return [*rows, ("en", None), ("fr", ""), (None, " \t "), ("und", "new york city hall. " * 30), ("en", "en en fr fr en"), ("en", "a b " * 20_000)]


def test_phrases_equal_counting(spark):
    rows = phrase_corpus()
    assert phrase_rows(spark, rows, least=12) == sorted(plain_phrases(rows, 12))
    assert phrase_rows(spark, rows, least=12, most=5, longest=3) == sorted(plain_phrases(rows, 12, 5, 3))
    assert phrase_rows(spark, rows[:5], least=10**6) == []
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_phrases_do_not_depend_on_what_a_task_holds(spark, monkeypatch):
    rows = phrase_corpus(8)
    want = sorted(plain_phrases(rows, 12))
    monkeypatch.setattr(phrases, "FAN", 2)  # a tree of pairs of tasks
    assert phrase_rows(spark, rows, least=12) == want


def test_stripes_do_not_depend_on_blocks(monkeypatch):
    texts = [(t or "").encode() for _, t in phrase_corpus(8)]
    known = np.ones(phrases.BITS, bool)

    def counts():
        out = Counter()
        for split in phrases.blocks(texts):
            words = np.fromiter(map(xxhash.xxh64_intdigest, [*split, b"\xff"]), np.uint64, len(split) + 1)
            out.update(zip(*(x.tolist() for x in phrases.followers(words, np.uint64(3), 2, known)), strict=True))
        return out

    whole = counts()
    monkeypatch.setattr(phrases, "BLOCK", 100)
    assert counts() == whole


def test_scores_past_64_bits(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(*(F.lit(x).cast("long").alias(c) for c, x in {"a": 9 * 10**12, "n": 10**14, "l": 3 * 10**13, "r": 7 * 10**13}.items()))
    exact = F.expr("(CAST(a AS DECIMAL(14,0)) * CAST(1000 AS DECIMAL(4,0)) * CAST(n AS DECIMAL(18,0))) div (CAST(l AS DECIMAL(14,0)) * CAST(r AS DECIMAL(14,0)))")
    assert row.select(exact.alias("x")).first()["x"] == 1000 * 9 * 10**12 * 10**14 // (3 * 10**13 * 7 * 10**13)


def plain_components(rows, width, percent):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, (_, s) in enumerate(sets):
        for y in range(x):
            t = sets[y][1]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                up[top(x)] = top(y)
    least = defaultdict(list)
    for x, (i, _) in enumerate(sets):
        least[top(x)].append(i)
    named = {t: min((i for i in ids if i is not None), default=None) for t, ids in least.items()}
    return sorted(((i, len(s), named[top(x)], i == named[top(x)]) for x, (i, s) in enumerate(sets)), key=repr)


def dedup(spark, table, width, percent=80):
    return sorted((tuple(r) for r in minhash.minhash_components(table, width, percent).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_minhash_on_edge_rows(spark, edge, empty, edge_rows):
    for width in (1, 2, 5):
        assert dedup(spark, edge, width) == plain_components(edge_rows, width, 80)
    assert minhash.minhash_components(empty).count() == 0


def test_minhash_equals_all_pairs(spark, monkeypatch):
    """Groups of variants around the threshold, with chains of links between them; blocks of three members."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(12):
        base = rng.choices(vocabulary, k=rng.choice([6, 20, 60]))
        for _ in range(rng.choice([1, 3, 25])):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 8)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    want = plain_components(rows, 2, 80)
    assert any(c != i for i, _, c, _ in want)
    table = frame(spark, rows).repartition(3)
    assert dedup(spark, table, 2) == want
    monkeypatch.setattr(minhash, "BLOCK", 3)
    assert dedup(spark, table, 2) == want


def test_agreements_needed():
    """The bound is the posterior: with a uniform prior, Beta(m + 1, n - m + 1) above the threshold, by integration."""
    for n, fewest in minhash.fewest_agreements(80):
        x = (np.arange(200_000) + 0.5) / 200_000
        tail = lambda m: (x**m * (1 - x) ** (n - m))[x >= 0.8].sum() / (x**m * (1 - x) ** (n - m)).sum()  # noqa: B023, E731
        assert tail(fewest) >= minhash.MISS * 0.99 and tail(fewest - 1) < minhash.MISS * 1.01
    assert minhash.chance(32, 40, 0.8) == pytest.approx(0.4, abs=0.2)


def test_minima_estimate_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for k in range(60):
        a = rng.integers(0, 2**63, 400).astype(np.uint64)
        b = np.concatenate([a[: 300 + k], rng.integers(0, 2**63, 100 - k).astype(np.uint64)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append((minhash.minima(np.unique(a)) == minhash.minima(np.unique(b))).mean() - true)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.045
    assert jaccard.shingles("a b", 2).size == 1
