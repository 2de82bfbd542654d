"""The registered queries on whole tables, against their SQL or a plain version in memory."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from axisframe.llm import media, quality, toxicity
from axisframe.llm.registry import QUERIES, SQL
from axisframe.llm.wordbpe import tokenizer_path

DATA = "/root/testdata/sf0.001"


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(t["doc_id"].to_pylist(), [x or "" for x in t["text"].to_pylist()], strict=True))


def found(spark, name):
    return QUERIES[name](spark, DATA).collect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    theirs = con.execute(SQL[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(tuple(r[c] for c in columns) for r in found(spark, name)) == sorted(theirs.fetchall())


def test_bpe_equals_the_library(spark, texts):
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json", None))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found(spark, "op4_bpe_chunks")}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {i: (len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))) for i, t in texts.items() for ids in [tok.encode(t, add_special_tokens=False).ids]}


def test_token_counts_and_packing_equal_the_library(spark, texts):
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json", None))
    ids = {i: tok.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found(spark, "op6_token_counts")}
    assert got == {i: (len(texts[i].encode()), len(x), len(x) > 2048) for i, x in ids.items()}
    rows = found(spark, "op10_best_fit_packing")
    whole = {i: [*x, 1] for i, x in ids.items()}
    want = sorted((i, k, at, zlib.crc32(np.array(x[at : at + 4096], "<u4").tobytes())) for i, x in whole.items() for k, at in enumerate(range(0, len(x), 4096)))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["ids_crc32"]) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        ends = [0, *np.cumsum([n for _, n in sorted(p)]).tolist()]
        assert [at for at, _ in sorted(p)] == ends[:-1] and ends[-1] <= 4096
    bins = []
    for n in sorted((r["length"] for r in rows), reverse=True):
        room = min((b for b in bins if b[0] >= n), default=None, key=lambda b: b[0])
        if room is None:
            bins.append([4096 - n])
        else:
            room[0] -= n
    assert len(places) == len(bins)


def test_media_are_read_back(spark, texts):
    for r in found(spark, "op7_media_columns"):
        raw = texts[r["doc_id"]].encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        stored = media.encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, 576))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())


def interpolated(texts):
    """Deleted interpolation in memory: counts in dictionaries, EM over single events."""
    words = {i: [*t.encode().lower().split(), b""] for i, t in texts.items()}
    part = lambda i: 2 if crc(i) % 7 == 2 else int(crc(i) % 7 == 3)
    one, two = [Counter(), Counter()], [Counter(), Counter()]  # of the fitting part, of all training documents
    for i, w in words.items():
        for k in ([0, 1] if part(i) == 0 else [1] if part(i) == 1 else []):
            one[k].update(w)
            two[k].update(zip([b"", *w], w, strict=False))
    n, v, n_fit = sum(one[1].values()), len(one[1]), sum(one[0].values())
    bucket = lambda c: math.ceil(math.log2(c + 1))
    events = [(bucket(one[0][h]), two[0][h, w] / max(one[0][h], 1), one[0][w] / n_fit, 1 / (v + 1)) for i, x in words.items() if part(i) == 1 for h, w in zip([b"", *x], x, strict=False)]
    b, p = np.array([e[0] for e in events]), np.array([e[1:] for e in events])
    weights = np.full((65, 3), 1 / 3)
    weights[0] = 0, 0.5, 0.5
    for _ in range(30):
        share = weights[b] * p
        share /= np.maximum(share.sum(axis=1), 1e-300)[:, None]
        gained = np.stack([np.bincount(b, share[:, j], 65) for j in range(3)], axis=1)
        total = gained.sum(axis=1, keepdims=True)
        prior = (gained.sum(axis=0) + 1e-3) / (gained.sum() + 3e-3)
        weights = np.where(total > 0, (gained + 1e-2 * prior) / (total + 1e-2), prior)
        weights[0] = [0, *(weights[0, 1:] / weights[0, 1:].sum())]
    out = {}
    for i, x in words.items():
        base = sum(math.log10((one[1][w] + 1) / (n + v + 1)) for w in x)
        score = 0.0
        for h, w in zip([b"", *x], x, strict=False):
            m = weights[bucket(one[1][h])]
            score += math.log10(m[0] * two[1][h, w] / max(one[1][h], 1) + m[1] * one[1][w] / n + m[2] / (v + 1))
        out[i] = (part(i) == 2, len(x), sum(w in one[1] for w in x), n, base, score)
    return out


def test_lm_scores_equal_deleted_interpolation_in_memory(spark, texts):
    want = interpolated(texts)
    rows = found(spark, "op3_lm_scoring")
    assert len(rows) == len(texts)
    for r in rows:
        *exact, base, score = want[r["doc_id"]]
        assert [r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]] == exact
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, rel=2e-3)  # estimates are binned by an eighth of an octave for EM
    assert sum(r["score"] for r in rows if not r["held_out"]) > sum(r["base_score"] for r in rows if not r["held_out"])


@pytest.mark.parametrize(("name", "label", "modulus", "rest", "cut"), [("op2_quality_classifier", "quality", 4, 2, 0.7), ("op8_toxicity", "toxic", 5, 0, 0.5)])
def test_classifiers_score_every_text_as_in_memory(spark, texts, name, label, modulus, rest, cut):
    labels = pq.read_table(f"{DATA}/labels.parquet").to_pylist()
    learn = sorted((r["doc_id"], r[label]) for r in labels if crc(r["doc_id"]) % modulus != rest and r[label] is not None and r["doc_id"] in texts)
    ids, y = [i for i, _ in learn], [v for _, v in learn]
    if label == "quality":
        model = quality.train([quality.sample_terms(texts[i]) for i in ids], y)
        score = lambda t: quality.scores(model, [t])[0]
    else:
        model = toxicity.train([texts[i] for i in ids], y)
        score = lambda t: toxicity.score(model, t)
    rows = found(spark, name)
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        assert r["held_out"] == (crc(r["doc_id"]) % modulus == rest) and r["predicted"] == int(r["score"] >= cut)
        assert r["score"] == pytest.approx(score(texts[r["doc_id"]]), abs=1e-6)
