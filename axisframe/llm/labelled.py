"""Fitting classifiers on bounded samples of labelled documents."""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, trimmed

CLASS_BYTES = 8 << 20  # of a class's sampled texts together


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y): one 0/1 label of every labelled id, 1 where it has both."""
    return labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))


def class_totals(docs: DataFrame, labels: DataFrame, label: str) -> list[int]:
    """How many ids of class 0 and of class 1 have a text, sampled or not."""
    usable = known_labels(labels, label).join(docs.filter("text IS NOT NULL").select("doc_id"), "doc_id", "left_semi")
    found = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    return [found.get(0, 0), found.get(1, 0)]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, per_bytes: int = CLASS_BYTES) -> DataFrame:
    """(doc_id, text, y) of at most per_class documents of each class, chosen by the hash of their id as long as their
    texts together stay within per_bytes; a text that does not fit is passed over.

    labels has doc_id and a 0/1 column; rows with a null in either, or whose document has no text, teach nothing. An
    id with both labels counts as 1, and of several texts under one id the smallest counts. The sample, and so the
    broadcast of its ids, is bounded whatever the tables hold.
    """
    sized = docs.select("doc_id", F.octet_length("text").alias("size")).filter("size IS NOT NULL").groupBy("doc_id").agg(F.max("size").alias("size"))
    known = known_labels(labels, label).join(sized, "doc_id").filter(F.col("size") <= per_bytes // 8)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(*order).limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    filled = F.sum("size").over(Window.partitionBy("y").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    picked = picked.withColumn("filled", filled).filter(F.col("filled") <= per_bytes).select("doc_id", "y")
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(picked), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def fitted(docs: DataFrame, labels: DataFrame, label: str, per_class: int, prepare, train) -> dict | None:
    """train(prepared texts, labels) of the sample in order of ids. Each text is prepared where it lies; the bounded
    results go to one task, and only the model, whose size its parameters fix, reaches the driver."""
    bounded_batches(docs.sparkSession)

    def ready(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"], pa.array([pickle.dumps(prepare(t)) for t in batch["text"].to_pylist()], pa.binary())], ["doc_id", "y", "x"])

    def run(batches):
        x, y = [], []
        for batch in batches:
            x += map(pickle.loads, batch["x"].to_pylist())
            y += batch["y"].to_pylist()
        model = pickle.dumps(train(x, y))
        x.clear()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    sample = labelled_sample(docs, labels, label, per_class)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = sample.mapInArrow(trimmed(ready), f"doc_id {kind}, y int, x binary").repartition(1).sortWithinPartitions("doc_id")
    found = ordered.select("x", "y").mapInArrow(trimmed(run), "model binary").toArrow()["model"]  # one row, or none without a sample
    return pickle.loads(found[0].as_buffer()) if len(found) else None
