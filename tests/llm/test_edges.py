"""Every operator on nulls, empty and long texts, repeated rows, clashing names and empty tables."""

import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from axisframe.llm import bpe, jaccard, lm, media, packing, quality, sharding, tokencount, topk, toxicity
from axisframe.llm.common import kept_rows
from axisframe.llm.wordbpe import tokenizer_path


def by_row(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def library(name):
    return Tokenizer.from_file(tokenizer_path(name, None))


def test_sharding(spark, edge, empty, edge_rows):
    names = sharding.names(7)
    table = sharding.lookup_table(names, 101)
    got = sharding.assign_shards(edge, "doc_id", names, 101).select("doc_id", "slot", "shard").collect()
    assert len(got) == len(edge_rows)
    for r in got:
        slot = sharding.text_hash("" if r["doc_id"] is None else str(r["doc_id"])) % 101
        assert (r["slot"], r["shard"]) == (slot, names[table[slot]])
    assert sharding.assign_shards(empty, "doc_id", names, 101).count() == 0


def test_the_packing_plan_starts_no_python_workers_of_its_own(edge, empty):
    for docs in (edge, empty):
        assert "ExistingRDD" not in packing.best_fit_packing(docs)._jdf.queryExecution().toString()


def test_token_counts(edge, empty, edge_rows):
    tok = library("word_bpe_49k.json")
    want = sorted(((i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in edge_rows), key=repr)
    for lexicon in (600_000, 2, 0):  # with 0 every pre-token takes the shuffled join
        assert by_row(tokencount.token_counts(edge, lexicon=lexicon)) == want
    assert tokencount.token_counts(empty).count() == 0


def test_bpe(edge, empty, edge_rows):
    tok = library("byte_bpe_50k.json")
    want = []
    for i, t in edge_rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert by_row(bpe.bpe_digest(edge)) == sorted(want, key=repr)
    assert by_row(bpe.bpe_decode(bpe.bpe_encode(edge))) == sorted(((i, tok.decode(tok.encode(t or "").ids, skip_special_tokens=False)) for i, t in edge_rows), key=repr)
    assert bpe.bpe_digest(empty).count() == 0


def test_lm(spark, edge, empty, edge_rows):
    from pyspark.sql import functions as F

    cut = edge.withColumn("train", F.coalesce(F.col("doc_id"), F.lit(0)) != 6).withColumn("held", F.coalesce(F.col("doc_id"), F.lit(0)) == 8)
    counts = {}
    for i, t in edge_rows:
        if i != 6:
            for w in lm.tokens(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, len(lm.tokens(t)), sum(w in counts for w in lm.tokens(t)), n, round(sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in lm.tokens(t)), 6)) for i, t in edge_rows), key=repr)
    for block in (1_000_000, 50):
        got = lm.lm_scores(cut, block=block, keys=5 * block).collect()
        assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=repr) == want
        assert all(np.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert lm.lm_scores(empty.withColumn("train", F.lit(True)).withColumn("held", F.lit(False))).count() == 0
    nothing = lm.lm_scores(edge.withColumn("train", F.lit(False)).withColumn("held", F.lit(False))).collect()
    assert len(nothing) == len(edge_rows) and all(r["train_tokens"] == 0 for r in nothing)


def test_media(edge, empty, edge_rows):
    got = media.media_digest(media.texts_to_media(edge)).collect()
    assert len(got) == len(edge_rows)
    texts = {}
    for r in got:
        texts.setdefault(r["doc_id"], r)
    for i, t in edge_rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = texts[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert media.media_digest(media.texts_to_media(empty)).count() == 0


def test_packing(edge, empty, edge_rows):
    tok = library("word_bpe_49k.json")
    got = packing.best_fit_packing(edge, capacity=64).collect()
    want = sorted((i, k, at, zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes())) for i, t in edge_rows if i is not None for ids in [tok.encode(t or "", add_special_tokens=False).ids + [1]] for k, at in enumerate(range(0, len(ids), 64)))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["ids_crc32"]) for r in got if r["doc_id"] is not None) == want
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.best_fit_packing(empty).count() == 0


def test_jaccard(edge, empty, edge_rows):
    got = by_row(jaccard.jaccard_components(edge, 4, 85).drop("root"))
    sizes = {i: (n, c) for i, n, c in got}
    assert len(got) == len(edge_rows)
    assert sizes[2] == (0, 2) and sizes[3] == (0, 3) and sizes[4] == (0, 4)
    assert sizes[6] == (1, 6) and sizes[None] == (1, 6)
    assert [r for r in got if r[0] == 1] == [(1, 2, 1), (1, 2, 1)]
    assert jaccard.jaccard_components(empty).count() == 0


def test_classifiers(spark, edge, empty, edge_rows):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 1), (9, 1, 1), (5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for module, model in ((quality, quality.quality_model(edge, labels)), (toxicity, toxicity.toxicity_model(edge, labels))):
        scored = (quality.quality_scores if module is quality else toxicity.toxicity_scores)(edge, model)
        rows = scored.collect()
        assert len(rows) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
        assert (quality.quality_scores if module is quality else toxicity.toxicity_scores)(empty, model).count() == 0
    assert {r["score"] for r in quality.quality_scores(edge, quality.quality_model(edge, labels.limit(0))).collect()} == {1.0}
    assert {r["score"] for r in toxicity.toxicity_scores(edge, toxicity.toxicity_model(empty, labels)).collect()} == {0.0}
    kept = kept_rows(edge, lambda texts: ["alpha" in t.lower() for t in texts])
    assert kept.columns == edge.columns and kept.count() == 5


@pytest.mark.parametrize("block", [20_000, 7])
def test_topk(spark, block):
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (120, 5)).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[3].tolist()), (500, None), (501, [1.0, None]), (502, [float("nan")] * 5), (503, [float("inf")] * 5), (None, [2.0, 2.0]), (504, [])]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<double>, g int, distance int").repartition(3)
    got = {}
    for r in topk.voronoi_top_k(df, "vec_id", "embedding", lambda c: c % 10 == 0, k=4, pivots=6, block=block).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    valid = [(i, np.floor(1024 * np.array((v + [0] * 5)[:5]))) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    asked = [i for i, _ in valid if i is not None and i % 10 == 0]
    assert sorted(got) == sorted(set(asked))
    for q in asked:
        own = dict((i, v) for i, v in valid if i == q)[q]
        best = sorted(((-int(own @ v), i if i is not None else 10**9, i) for i, v in valid if i != q))[:4]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, _, i) in enumerate(best)]
    assert topk.voronoi_top_k(df.limit(0), "vec_id", "embedding", lambda c: c % 10 == 0).count() == 0


def test_topk_bounds_leave_out_no_true_neighbour():
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(400, 6)) * 300) + 900 * rng.integers(-1, 2, (400, 1))
    p = topk.centroids(x, 12)
    of, distance = topk.nearest(x, p)
    radius = np.array([distance[of == g].max(initial=0) for g in range(12)])
    low, high = (np.array([f(x[of == g]) if (of == g).any() else np.zeros(6) for g in range(12)]) for f in (lambda v: v.min(axis=0), lambda v: v.max(axis=0)))
    bound = topk.bounds(x, p, radius, low, high)
    assert (x @ x.T <= bound[:, of] + 1e-6).all()


def test_topk_leaves_out_groups_of_clustered_vectors(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(20, 8)) * 3
    x = centres[np.arange(600) % 20] + rng.normal(size=(600, 8)) * 0.05
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    query = lambda c: c % 10 == 0
    _, queries, _, wanted, sizes, (_, kind) = topk.needed(df, "vec_id", "embedding", query, 4, 24, 20_000)
    assert kind == "<i2"
    assert wanted.count() < 0.4 * queries.count() * sizes.count()
    whole = np.floor(1024 * x).astype(int)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.voronoi_top_k(df, "vec_id", "embedding", query, 4, 24).collect()}
    for q in range(0, 600, 10):
        best = sorted((-int(whole[q] @ whole[j]), j) for j in range(600) if j != q)[:4]
        assert [got[(q, k + 1)] for k in range(4)] == [(j, -s) for s, j in best]


def test_packing_of_one_repeated_id(spark):
    docs = spark.createDataFrame([(7, "alpha beta")] * 500 + [(None, "gamma")] * 300, "doc_id long, text string")
    got = packing.best_fit_packing(docs, capacity=64).collect()
    assert len(got) == 800
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 800
    assert packing.ranked(packing.durable(packing.pieces(docs, 64), "t"), 100).groupBy("length", "rank").count().filter("count > 1").isEmpty()


def test_damaged_media_are_reported(spark):
    import struct

    bmp = bytearray(media.encode_bmp(np.full((2, 3), 200, np.uint8)))
    two = bmp[:54] + bytes(8) + bmp[54 + 1024 :]
    struct.pack_into("<I", two, 10, 62)  # pixels of value 200 and a palette of two
    sized = lambda w, h: bytes(bmp[:18]) + struct.pack("<ii", w, h) + bytes(bmp[26:])
    fields = lambda *m: b"BM" + struct.pack("<IHHIIiiHHIIiiII", 0, 0, 0, 66, 40, 1, 1, 1, 32, 3, 0, 0, 0, 0, 0) + struct.pack("<III", *m) + bytes([1, 2, 3, 4])
    bad = [bytes(two), b"P5 0 5 255\n", b"P2 2 0 255", sized(0, 2), sized(-5, 2), sized(3, 0), sized(1 << 30, 1 << 30), b"P2 1 1 255 300", b"P2 1 1 255 -2", b"P5 1 1 9\n\xff", b"P2 2 2 255 1 2", b"P6 9 9 255\n12", bytes(bmp[:60]), b"BM", b"", b"P5", fields(0xFF, 0xFF, 0xFF), fields(0xFFF, 0xF, 1)]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "k int, media binary")
    got = media.media_tiles(df, "k").collect()
    assert len(got) == len(bad) and all(r["tile"] is None and r["error"] for r in got)
    assert media.decode_image(b"P2 # head 7\n2 1 255 # 9 9\n1 # 5\n2").tolist() == [[1, 2]]
    assert media.decode_image(b"P1 3 1\n1 # 0 0\n0 1").tolist() == [[0, 255, 0]]
    assert media.decode_image(fields(0xFF, 0xFF00, 0xFF0000)).tolist() == [[[1, 2, 3]]] and media.decode_image(fields(0xFF0000, 0xFF00, 0xFF)).tolist() == [[[3, 2, 1]]]


def test_media_features_equal_plain_ones(edge, edge_rows):
    texts = {i: t for i, t in edge_rows if i is not None}
    for r in media.media_digest(media.texts_to_media(edge)).collect():
        if r["doc_id"] is None:
            continue
        raw = (texts[r["doc_id"]] or "").encode()
        image = np.frombuffer(raw + b"\xff" * (-len(raw) % 576 if raw else 576), np.uint8).reshape(-1, 576).astype(float)

        def area(n, m, image=image):
            def cover(size, parts):  # how much of each sample lies in each part
                edge_ = np.arange(parts + 1) * size / parts
                return np.clip(np.minimum(edge_[1:, None], np.arange(size) + 1) - np.maximum(edge_[:-1, None], np.arange(size)), 0, None)

            return cover(image.shape[0], n) @ image @ cover(image.shape[1], m).T / (image.shape[0] / n * image.shape[1] / m)

        small = np.rint(area(8, 9) * 256)
        assert r["feature"].split("-")[0] == np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()
