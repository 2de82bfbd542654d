"""Token counts without ids: pieces are counted once per distinct pre-token, joined to per-document pre-token frequencies, and summed.

The most frequent pre-tokens, at most `lexicon` of them, are joined inside the scan through a broadcast of that
bounded size; every other pre-token takes the shuffled join. A null text counts as the empty text, with no tokens;
repeated rows are counted each; empty tables give no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, durable, frequent, table, texts_of
from .wordbpe import WordBpe, loaded

LEXICON = 600_000
LIMIT = 2048
FLUSH = 300_000


def distinct_pretokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(pretoken, n): every pre-token of the corpus with its number of occurrences."""

    def rows(seen: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pretoken", "n"])

    def run(batches):
        tok, _ = loaded(WordBpe, path)
        seen: Counter = Counter()
        for batch in batches:
            for text in texts_of(batch):
                seen.update(tok.pretokens(text))
                if len(seen) > FLUSH:
                    yield rows(seen)
                    seen.clear()
        yield rows(seen)

    return docs.select("text").mapInArrow(run, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))


def piece_counts(pretokens: DataFrame, path: str | None = None) -> DataFrame:
    """pretokens with `pieces`: the number of tokens of each, one call of the model for each distinct pre-token."""

    def run(batches):
        tok, _ = loaded(WordBpe, path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(tok.ids(p)) for p in batch["pretoken"].to_pylist()], pa.int32())], ["pretoken", "n", "pieces"])

    return pretokens.mapInArrow(run, "pretoken string, n long, pieces int")


def token_counts(docs: DataFrame, limit: int = LIMIT, path: str | None = None, lexicon: int = LEXICON) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    pieces = durable(piece_counts(distinct_pretokens(docs, path), path), "pieces")
    top = frequent(pieces, "pretoken", "n", lexicon)
    least = top[-1][1] if top else None
    known = spark.sparkContext.broadcast({})
    if top:
        got = pieces.filter(F.col("n") >= least).select("pretoken", "pieces").toArrow()
        known = spark.sparkContext.broadcast(dict(zip(got["pretoken"].to_pylist(), got["pieces"].to_pylist(), strict=True)))
    rest_type = pa.list_(pa.struct([("pretoken", pa.string()), ("n", pa.int64())]))

    def run(batches):
        tok, _ = loaded(WordBpe, path)
        look = known.value
        for batch in batches:
            sizes, sums, rests = [], [], []
            for text in texts_of(batch):
                frequencies = Counter(tok.pretokens(text))
                rest = [(p, n) for p, n in frequencies.items() if p not in look]
                for p, _ in rest:
                    del frequencies[p]
                sums.append(sum(n * look[p] for p, n in frequencies.items()))
                sizes.append(len(text.encode()))
                rests.append([{"pretoken": p, "n": n} for p, n in rest])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(rests, rest_type)], ["doc_id", "n_bytes", "known", "rest"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, known long, rest array<struct<pretoken:string,n:long>>"
    rows = durable(docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "frequencies")
    rest = (
        rows.select("row", F.explode("rest").alias("r")).select("row", "r.*")
        .join(pieces.select("pretoken", "pieces"), "pretoken")
        .groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    )
    total = F.col("known") + F.coalesce(F.col("more"), F.lit(0))
    return rows.drop("rest").join(rest, "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
