"""The pipeline on the smallest tables: every stage against what it should do to its own input."""

import corpus_pipeline as pipeline
from axisframe.llm import quality, toxicity
from axisframe.llm.common import durable, remainder, table

from tests.llm.test_methods import brute_components

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    labels = table(spark, DATA, "labels")
    seen = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    frames = [docs]
    for name, stage in pipeline.STAGES[:-1]:
        frames.append(durable(stage(spark, frames[-1], DATA), name.replace(" ", "-")))
        assert frames[-1].columns == docs.columns
        seen.append({r["doc_id"]: r["text"] for r in frames[-1].collect()})
    model = toxicity.toxicity_model(frames[0], labels.filter(remainder("doc_id", 5) != 0))
    assert set(seen[1]) == {i for i, t in seen[0].items() if toxicity.score(model, t) < 0.5}
    model = quality.quality_model(frames[1], labels.filter(remainder("doc_id", 4) != 2))
    rows = list(seen[1].items())
    assert set(seen[2]) == {i for (i, _), s in zip(rows, quality.scores(model, [t for _, t in rows]), strict=True) if s >= 0.7}
    groups = brute_components(list(seen[2].items()), 5, 80)
    assert set(seen[3]) == {i for i, (_, c) in groups.items() if i == c}
    packed = pipeline.STAGES[-1][1](spark, frames[-1], DATA).collect()
    assert {r["doc_id"] for r in packed} == set(seen[3])
    assert len(pipeline.run(spark, DATA).collect()) == len(packed)
    assert len(seen[0]) > len(seen[1]) > len(seen[2]) >= len(seen[3]) > 0


def test_near_duplicates_keep_every_text_of_a_repeated_id(spark):
    from tests.llm.conftest import frame

    words = [f"w{i}" for i in range(40)]
    one, other, near = " ".join(words), " ".join(reversed(words)), " ".join([*words, "end"])
    rows = [(7, one), (7, other), (7, one), (3, near), (None, one), (None, "alone in the world"), (None, None), (4, None), (4, None), (5, " \n"), (6, "\x85"), (8, "\x85")]
    docs = frame(spark, rows).withColumnRenamed("lang", "digest")
    got = pipeline.near_duplicate_stage(spark, docs, None)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(3, near), (7, other), (None, "alone in the world"), (None, None), (4, None), (4, None), (5, " \n"), (6, "\x85")], key=repr)
