"""A corpus from raw documents to packed training sequences: toxicity, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Null texts are never toxic, are judged by quality like
an empty text, and have no duplicates. Different texts under one id are different documents; rows with both alike are
copies of each other. A null id is the largest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisframe.llm import quality, toxicity
from axisframe.llm.common import durable, fresh, kept_rows, remainder, table
from axisframe.llm.jaccard import jaccard_components
from axisframe.llm.packing import best_fit_packing

TOXIC, GOOD = 0.5, 0.7


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below TOXIC."""
    model = toxicity.toxicity_model(docs, table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0))
    shared = spark.sparkContext.broadcast(model)
    return kept_rows(docs, lambda texts: [toxicity.score(shared.value, t) < TOXIC for t in texts])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is at least GOOD."""
    model = quality.quality_model(docs, table(spark, sf_dir, "labels").filter(remainder("doc_id", 4) != 2))
    shared = spark.sparkContext.broadcast(model)
    return kept_rows(docs, lambda texts: [s >= GOOD for s in quality.scores(shared.value, texts)])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 of five-word shingles, the document with the smallest id and,
    among those, the smallest digest of its text; every document without words."""
    digest = fresh("digest", docs.columns)
    told = docs.withColumn(digest, F.md5("text"))
    classes = jaccard_components(told, width=5, percent=80, carry=(digest,)).filter("root IS NOT NULL")
    chosen = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", digest)).alias("c")).select(F.col("c.doc_id").alias("id_"), F.col(f"c.{digest}").alias("d_"))
    one = told.join(chosen, told["doc_id"].eqNullSafe(F.col("id_")) & (told[digest] == F.col("d_")), "left_semi")
    wordless = F.col("text").isNull() | F.col("text").rlike(r"\A[\x20\x09-\x0D]*\z")
    return one.dropDuplicates(["doc_id", digest]).select(*docs.columns).unionByName(docs.filter(wordless))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every kept document with its place in a training sequence."""
    return best_fit_packing(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("best-fit packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
