"""The methods themselves against brute force, exact round trips and held-out accuracy."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from axisframe.llm import bpe, jaccard, lm, media, packing, quality, sharding, toxicity
from axisframe.llm.graph import components
from axisframe.llm import wordbpe
from axisframe.llm.wordbpe import WordBpe, tokenizer_path

from tests.llm.conftest import frame


def test_lookup_table_is_balanced_and_stable():
    names = sharding.names(20)
    full = sharding.lookup_table(names, 2003)
    counts = np.bincount(full)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 2003)
    moved = sum(a != b for a, b in zip(full, fewer, strict=True) if a != 19)
    assert moved < 0.1 * 2003
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 2000)


def test_chunk_joins_agree_with_the_library():
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json", None))
    rng = random.Random(1)
    bits = ["'", "'re", "'ll", "r", "e", "l", " ", "  ", "\n", "\t", "a", "é", "1", "23", "!", "...", "<|endoftext|>", "日本", "́", "\x85", "x" * 30, " the"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 700))) for _ in range(150)] + ["a" * 3000, " " * 3000, "'re" * 900]
    usual = bpe.MASK
    try:
        for mask in (255, 63):
            bpe.MASK = mask
            encoder = bpe.Encoder(None, {})
            for t in texts:
                ids = encoder.encode(t)
                assert ids == tok.encode(t, add_special_tokens=False).ids
                assert encoder.tok.decode(ids) == tok.decode(ids, skip_special_tokens=False)
    finally:
        bpe.MASK = usual


def test_chunks_of_a_shared_passage_are_shared():
    rng = random.Random(2)
    words = [str(rng.random()) for _ in range(4000)]
    passage = " ".join(words[1000:3000]).encode()
    a, b = bpe.chunks(b"start of one " + passage + b" end"), bpe.chunks(b"another text altogether " + passage)
    assert len(set(a) & set(b)) >= min(len(a), len(b)) - 4
    assert b"".join(a).startswith(b"start of one ")


def test_word_pretokens_agree_with_the_library():
    tok, own = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json", None)), WordBpe()
    for t in ["Don't STOP ünïcode ¼ x²", "Σίσυφος ΟΔΟΣ", "Å é <|startoftext|>x<|endoftext|>", "a\x1cb\x85c\x0bd", "K ﬁ ǅ Ⱥ İ", "", "'s'S 're", "日本語 テスト"]:
        assert [i for p in own.pretokens(t) for i in own.ids(p)] == tok.encode(t, add_special_tokens=False).ids


def test_word_pretokens_of_marks_and_contractions_agree_with_the_library():
    tok, own = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json", None)), WordBpe()
    rng = random.Random(4)
    bits = ["'", "'s", "'T", "'re", "'ve", "'ll", "'d", "'m", "a", "É", "1", "²", " ", "\t", "\n", ".", "...", "<", "|", "<|", "\x7f", "\x00", "ſ", "İ", "\xa0", "x" * 30]
    for t in ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(400)]:
        assert [i for p in own.pretokens(t) for i in own.ids(p)] == tok.encode(t, add_special_tokens=False).ids


def test_rare_pretokens_do_not_drive_out_frequent_ones(monkeypatch):
    monkeypatch.setattr(wordbpe, "_loaded", {})
    made = []
    monkeypatch.setattr(WordBpe, "ids", lambda self, p, ids=WordBpe.ids: made.append(p) or ids(self, p))
    tok, cache = wordbpe.loaded(WordBpe, None, most=20)
    for k in range(300):
        for p in ("the", f"rare{k}"):
            assert cache[p] == b"".join(i.to_bytes(4, "little") for i in tok.library.encode(p, add_special_tokens=False).ids) or not p.isalpha()
    assert made.count("the") == 1
    assert len(cache) + len(cache.older) <= 20


def test_mixture_is_a_distribution_and_em_helps():
    rng = np.random.default_rng(0)
    k = 6
    fit, held = rng.integers(0, 20, k * k), rng.integers(0, 9, k * k)
    pair = np.arange(k * k)
    weights = lm.learn_weights(pair, fit, held, k)
    assert np.allclose(weights.sum(axis=1), 1)
    matrix = 10 ** lm.log_matrix(pair, fit, weights, k).astype(float)
    assert np.allclose(matrix.sum(axis=1), 1, atol=1e-5)
    even = 10 ** lm.log_matrix(pair, fit, np.full((65, 3), 1 / 3), k).astype(float)
    assert (held * np.log(matrix.ravel())).sum() >= (held * np.log(even.ravel())).sum() - 1e-6


def test_lm_counts_every_pair_of_words(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    texts = [" ".join(f"w{min(int(rng.paretovariate(0.7)), 60)}" for _ in range(rng.randint(0, 30))) for _ in range(60)]
    docs = frame(spark, list(enumerate(texts))).withColumn("train", F.col("doc_id") % 7 != 2).withColumn("held", F.col("doc_id") % 7 == 3)
    learning = [t for i, t in enumerate(texts) if i % 7 != 2]
    names = sorted({w for t in learning for w in lm.tokens(t)})
    k = len(names) + 1  # all unknown words as one
    coded = lambda t: [names.index(w) if w in names else k - 1 for w in lm.tokens(t)]
    pairs = lambda t: [k * h + w for h, w in zip([c[-1], *c[:-1]], c, strict=True)] if (c := coded(t)) else []
    fit, held = (np.bincount([p for i, t in enumerate(texts) if i % 7 != 2 and (i % 7 == 3) == x for p in pairs(t)], minlength=k * k) for x in (False, True))
    pair = np.arange(k * k)
    matrix = lm.log_matrix(pair, fit + held, lm.learn_weights(pair, fit, held, k), k).ravel()
    want = {i: float(matrix[pairs(t)].astype(float).sum()) for i, t in enumerate(texts)}
    for block, keys in ((1_000_000, 1_500_000), (100, 1_500_000), (1, 60), (200, 7)):  # sizes of blocks and buckets change no score
        got = {r["doc_id"]: r["score"] for r in lm.lm_scores(docs, block=block, keys=keys).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[i] - want[i]) < 1e-2 + 2e-3 * abs(want[i]) for i in want)


def test_images_round_trip():
    rng = np.random.default_rng(1)
    grey, colour = rng.integers(0, 256, (11, 13), dtype=np.uint8), rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert (media.decode_image(media.encode_pgm(grey)) == grey).all()
    for image in (grey, colour):
        assert (media.decode_image(media.encode_bmp(image)) == image).all()
    assert media.decode_netpbm(b"P1\n# c\n2 2\n1 0\n0 1").tolist() == [[0, 255], [255, 0]]
    assert media.decode_netpbm(b"P4 3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode_netpbm(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode_netpbm(b"P5 1 1 1000\n\x01\x02").tolist() == [[258]]
    with pytest.raises(ValueError):
        media.decode_image(b"JUNK")


def test_area_resize_is_the_mean_of_areas():
    image = np.random.default_rng(2).integers(0, 256, (12, 18)).astype(np.uint8)
    assert np.allclose(media.area_resize(image, 4, 6), image.reshape(4, 3, 6, 3).mean(axis=(1, 3)))
    fine = np.repeat(np.repeat(image, 5, axis=0), 7, axis=1)
    assert np.allclose(media.area_resize(image, 5, 7), fine.reshape(5, 12, 7, 18).mean(axis=(1, 3)))


def test_tiles(spark):
    rows = [(1, media.encode_pgm(np.eye(40, dtype=np.uint8) * 255)), (2, None), (3, b"oops")]
    got = {r["k"]: r for r in media.media_tiles(spark.createDataFrame(rows, "k int, media binary"), "k").collect()}
    import io

    assert np.load(io.BytesIO(got[1]["tile"])).shape == (32, 32) and len(got[1]["dhash"]) == 16
    assert got[2]["tile"] is None and got[2]["error"] is None
    assert got[3]["tile"] is None and got[3]["error"]


def test_plan_equals_plain_best_fit():
    rng = random.Random(3)
    for capacity in (10, 64):
        lengths = [rng.randint(1, capacity) for _ in range(400)]
        bins = []
        for n in sorted(lengths, reverse=True):
            room = min((b for b in bins if b[0] >= n), default=None, key=lambda b: b[0])
            if room is None:
                bins.append([capacity - n])
            else:
                room[0] -= n
        runs = packing.plan_slots({n: lengths.count(n) for n in set(lengths)}, capacity)
        used = {}
        for length, low, high, first, each, at in runs:
            for r in range(low, high):
                used.setdefault(first + (r - low) // each, []).append((at + (r - low) % each * length, length))
        assert sum(map(len, used.values())) == len(lengths)
        assert len(used) == len(bins)
        for slots in used.values():
            end = 0
            for at, n in sorted(slots):
                assert at == end
                end += n
            assert end <= capacity


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_jaccard_equals_brute_force(spark, width, percent):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(300)]
    common = rng.choices(vocabulary, k=60)
    rows = []
    for c in range(12):
        base = rng.choices(vocabulary, k=rng.randint(3, 90))
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3, " ".join(w + (common if c % 3 == 0 else []))))
    rows += [(1, ""), (2, "w1"), (4, "W1 "), (5, "w1 w2")]
    want = brute_components(rows, width, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(frame(spark, rows).repartition(4), width, percent).collect()}
    assert got == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(31)} | {k: 100 for k in range(100, 140)}


def corpus(n, seed):
    rng = random.Random(seed)
    syllables = ["an", "er", "on", "the", "re", "ti", "es", "or", "en", "at"]
    bad = ["idiotic", "stupid", "trashy", "moronic"]
    rows = []
    for _ in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(20, 120))]
        toxic, junk = rng.random() < 0.4, rng.random() < 0.4
        if junk:
            words = [w + rng.choice(["***", "&&&", "%%%"]) for w in words]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((" ".join(words), int(toxic), int(not junk)))
    return rows


def test_classifiers_on_held_out_rows():
    train, test = corpus(300, 1), corpus(150, 2)
    tox = toxicity.train([t for t, _, _ in train], [y for _, y, _ in train])
    assert np.mean([(toxicity.score(tox, t) >= 0.5) == y for t, y, _ in test]) > 0.95
    assert toxicity.score(tox, "an er stupidd on the re") > 0.5  # a spelling that it never saw
    good = quality.train([quality.terms(t) for t, _, _ in train], [y for _, _, y in train])
    assert np.mean([(s >= 0.7) == y for s, (_, _, y) in zip(quality.scores(good, [t for t, _, _ in test]), test, strict=True)]) > 0.95
    assert quality.scores(good, [""]) == [good["share"]]


def test_quality_sample_keeps_the_balance_of_classes(spark):
    rows = [(i, "".join(random.Random(i).choices("abc XY.", k=40)), int(i % 20 > 2)) for i in range(200)]  # 85 % good
    docs = frame(spark, [*((i, t) for i, t, _ in rows), (900, None)])
    labels = spark.createDataFrame([*((i, y, 0) for i, _, y in rows), (900, 0, 0), (901, 0, 0)], "doc_id long, quality int, toxic int")
    for bound in (1000, 60, 20):
        model = quality.quality_model(docs, labels, bound)
        assert abs(quality.scores(model, [""])[0] - 0.85) < 1e-9
        sampled = model["y"].astype(bool)
        assert abs(model["weight"][sampled].sum() - 170) < 1e-6 and abs(model["weight"][~sampled].sum() - 30) < 1e-6
        same = model | {"sample": np.full((len(sampled), 1), quality.UNIT)}  # all are equally near: the vote is the share
        assert abs(quality.votes(same, np.full((1, 1), quality.UNIT), len(sampled))[0] - 0.85) < 1e-6


def test_votes_are_exact_cosines():
    rng = np.random.default_rng(4)
    unit = lambda x: np.round(quality.UNIT * x / np.linalg.norm(x, axis=1, keepdims=True))
    model = {"sample": unit(rng.normal(size=(50, 8))), "y": rng.integers(0, 2, 50).astype(float), "weight": np.ones(50), "share": 0.5}
    v = unit(rng.normal(size=(20, 8)))
    cos = v @ model["sample"].T / quality.UNIT**2
    for row, got in zip(cos, quality.votes(model, v, 5), strict=True):
        near = np.argsort(-row)[:5]
        w = np.maximum(row[near], 0)
        assert abs((w * model["y"][near]).sum() / w.sum() - got) < 1e-5


def test_votes_take_the_earlier_row_on_ties():
    model = {"sample": np.full((6, 1), quality.UNIT), "y": np.array([1.0, 1, 0, 0, 0, 0]), "weight": np.ones(6), "share": 0.5}
    assert quality.votes(model, np.full((1, 1), quality.UNIT), 3)[0] == pytest.approx(2 / 3)
    assert quality.votes(model, np.array([[0], [-quality.UNIT]]), 3).tolist() == [0.5, 0.5]


def test_scores_do_not_depend_on_the_block():
    rows = corpus(120, 5)
    model = quality.train([quality.terms(t) for t, _, _ in rows], [y for _, _, y in rows])
    texts = [t for t, _, _ in rows] + [rows[3][0], ""]
    whole = quality.scores(model, texts)
    assert whole == [quality.scores(model, [t])[0] for t in texts] and whole[3] == whole[120]


def test_terms_equal_plain_counts_and_parts_change_little(monkeypatch):
    text = "The the CAT, the cat\n" * 9 + "x  é 日本 " * 5
    found, n = quality.terms(text)
    words = text.lower().split()
    raw = np.frombuffer(text.encode(), np.uint8)
    assert n.sum() * len(raw) / 1000 == pytest.approx(len(words) + len(words) - 1 + len(raw) - 2)
    again = int(quality.bucket_of(np.zeros(1, np.uint32), quality.PAIR)[0])
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    assert n[found == again] * len(raw) / 1000 == pytest.approx(repeats)
    monkeypatch.setattr(quality, "PART", 16)
    cut, m = quality.terms(text)
    assert (cut == found).all() and np.allclose(m, n)


def test_latent_space_is_that_of_a_dense_decomposition():
    rng = np.random.default_rng(6)
    dense = rng.random((30, 12)) * (rng.random((30, 12)) < 0.6) + np.eye(30, 12)
    rows = [(np.flatnonzero(x), x[x != 0].astype(np.float32)) for x in dense]
    got = quality.term_basis(rows, 12, 4, 1)
    want = np.linalg.svd(dense)[2][:4].T
    assert np.allclose(got.T @ got, np.eye(4), atol=1e-4)
    assert np.allclose(np.abs(got.T @ want), np.eye(4), atol=1e-2)


def test_slopes_of_the_toxicity_loss():
    rng = np.random.default_rng(7)
    bags = toxicity.Bags([rng.integers(0, 9, n) for n in (3, 80, 70, 5)], np.array([0, 1, 1, 0]))
    embed, out = rng.normal(size=(9, toxicity.SIDE)), rng.normal(size=(toxicity.SIDE + 1, 2))
    _, g_embed, g_out = toxicity.loss_and_slopes(bags, embed, out)
    for x, slope in ((embed, g_embed), (out, g_out)):
        for at in np.ndindex(x.shape):
            keep, x[at] = x[at], x[at] + 1e-6
            up = toxicity.loss_and_slopes(bags, embed, out)[0]
            x[at] = keep - 1e-6
            down = toxicity.loss_and_slopes(bags, embed, out)[0]
            x[at] = keep
            assert abs((up - down) / 2e-6 - slope[at]) < 1e-6


def test_windows_equal_plain_means():
    rng = np.random.default_rng(8)
    values = rng.integers(-1000, 1000, 1 << 17)
    for text in ("one", "a b c d e f g", " ".join(f"w{i} " for i in range(60)), ""):
        bucket, word, n = toxicity.grams(text.encode())
        got = toxicity.windows(values[bucket], word, n)
        words = text.split()
        assert n == len(words) and len(got) == (max(1, n - toxicity.WINDOW + 1) if n else 0)
        for k, x in enumerate(got):
            inside = [b for w in words[k : k + toxicity.WINDOW] for b in toxicity.grams(w.encode())[0]]
            assert x == pytest.approx(values[inside].sum() / max(len(inside), toxicity.LEAST))


def test_toxic_words_across_the_seams_of_long_texts(monkeypatch):
    rows = corpus(200, 9)
    model = toxicity.train([t for t, _, _ in rows], [y for _, y, _ in rows])
    rng = random.Random(1)
    texts = []
    for shift in range(40):
        words = rng.choices(["an", "er", "theor", "tire", "es"], k=200)
        words[100 + shift // 8 : 100 + shift // 8] = ["stupid", "idiotic", "trashy"]
        texts.append("x" * shift + " " + rng.choice([" ", "\n", "  "]).join(words) + rng.choice(["", " "]))
    whole = [toxicity.score(model, t) for t in texts]
    for part in (64, 300, 501):
        monkeypatch.setattr(toxicity, "PART", part)
        assert all(len(toxicity.parts_of(t)) > 1 for t in texts)
        assert [toxicity.score(model, t) for t in texts] == whole


def test_toxicity_does_not_depend_on_where_parts_end(monkeypatch):
    """Random cuts, texts whose last white space alone lies behind a cut, and words longer than a part."""
    rows = corpus(200, 9)
    model = toxicity.train([t for t, _, _ in rows], [y for _, y, _ in rows])
    rng = random.Random(4)
    texts = []
    for k in range(60):
        words = rng.choices(["an", "er", "theor", "stupid", "es", "trashy"], weights=[9, 9, 9, 1, 9, 1], k=rng.choice([1, 5, 7, 8, 9, 60]))
        if k % 3 == 0:
            words[rng.randrange(len(words))] = "stupid" * rng.randrange(5, 60)
        texts.append(rng.choice(["", "\n"]) + " ".join(words) + rng.choice(["", "\n", " \n "]))
    whole = [toxicity.score(model, t) for t in texts]
    for part in [1, 2, *(rng.randrange(3, 400) for _ in range(12)), *(len(t.rstrip()) for t in texts[:6])]:
        monkeypatch.setattr(toxicity, "PART", part)
        assert [toxicity.score(model, t) for t in texts] == whole


def test_samples_keep_within_their_bytes(spark):
    from axisframe.llm.labelled import labelled_sample

    docs = frame(spark, [(i, "é" * (10 + i)) for i in range(60)] + [(90, "x" * 5000), (91, None)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(92)], "doc_id long, quality int, toxic int")
    got = labelled_sample(docs, labels, "quality", 1000, 1600).collect()
    for y in (0, 1):
        sizes = [len(r["text"].encode()) for r in got if r["y"] == y]
        assert 1300 < sum(sizes) <= 1600 and max(sizes) <= 200


def test_words_that_defeat_polynomial_hashes_stay_apart(spark):
    bits = "a"
    while len(bits) < 2048:
        bits += bits.translate({97: 98, 98: 97})
    one, two = bits, bits.translate({97: 98, 98: 97})  # alike under every polynomial modulo 2 ** 64
    rows = [(1, one), (2, two), (3, f"x y z {one} q"), (4, f"x y z {two} q")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(frame(spark, rows), 4, 85).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}
