"""Exact top-k search as a Voronoi kNN join on integer inner products.

Vectors are grouped by their nearest pivot (centroids of a bounded sample; any pivots give exact results), about as many
groups as the square root of the rows, PIVOTS at most. A group's summary is its size, the radius r around its pivot p, and
the least and largest value of each component, so both q.p + |q| r and the sum of each component's larger product bound
every score in it. A query first meets one block of its own group, whose k-th score is a floor; only groups whose lower
bound of the two reaches the floor are needed, and each block of queries receives only the groups that one of its queries
needs. How much that saves depends on the vectors: clustered ones leave most groups out, isotropic ones none. Blocks have a bounded number of
rows on both sides, whatever a group's size; their scores are exact, and the k best of each block are merged.

Vectors that are null, or hold a null or non-finite component, take no part. Shorter vectors count as filled with
zeros. A row is never its own candidate; repeated rows are candidates of each other and each asks for itself. Ties go
to the smaller id, null ids last; a null id asks nothing. Empty tables give no rows; other columns are not read.
Scores are exact while they fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, durable, table

SCALE = 1024
PIVOTS = 512
SAMPLE = 4096
BLOCK = 20_000


def integer_vectors(df: DataFrame, key: str, column: str) -> DataFrame:
    """(id, v): floor(SCALE * x) of every valid vector as longs."""
    valid = F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return df.filter(F.coalesce(valid, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.transform(column, lambda x: F.floor(SCALE * x.cast("double"))).alias("v"))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of longs from a list array; shorter ones are filled with zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def centroids(sample: np.ndarray, pivots: int, rounds: int = 5) -> np.ndarray:
    """A few rounds of k-means from the sample's first rows."""
    x = sample.astype(float)
    p = x[:pivots].copy()
    for _ in range(rounds):
        of = nearest(x, p)[0]
        for g in range(len(p)):
            if (of == g).any():
                p[g] = x[of == g].mean(axis=0)
    return p


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest pivot and the distance to it."""
    x = x.astype(float)
    d = (pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T
    of = d.argmin(axis=1)
    return of, np.sqrt(((x - pivots[of]) ** 2).sum(axis=1))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products; in floating point where every sum stays below 2**53."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return (q.astype(float) @ x.T.astype(float)).astype(np.int64) if top < 2**53 else q @ x.T


def best(q: np.ndarray, q_rows: np.ndarray, x: np.ndarray, x_rows: np.ndarray, k: int):
    """(query number, data number, score) of each query's k best rows but itself; x is in the order that breaks ties."""
    out_q, out_x, out_s = [], [], []
    for at in range(0, len(q), 256):
        s = products(q[at : at + 256], x)
        for i, row in enumerate(s):
            own = np.flatnonzero(x_rows == q_rows[at + i])
            need = min(len(row), k + len(own))
            floor = np.partition(row, len(row) - need)[len(row) - need] if need else 0
            found = np.flatnonzero(row >= floor)
            found = found[~np.isin(found, own)]
            found = found[np.argsort(-row[found], kind="stable")][:k]
            out_q += [at + i] * len(found)
            out_x += found.tolist()
            out_s += row[found].tolist()
    return np.array(out_q, np.int64), np.array(out_x, np.int64), np.array(out_s, np.int64)


def bounds(q: np.ndarray, pivots: np.ndarray, radius: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """What no score of a query (row) with a vector of a group (column) exceeds, with room for rounding."""
    size = np.sqrt((q**2).sum(axis=1))[:, None]
    round_ = q @ pivots.T + size * radius[None, :]
    box = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    bound = np.minimum(round_, box)
    return bound + 1e-9 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T + size) + 1


def solver(k: int, width: int, kind: str, floors: bool):
    """Joins one block of queries with one block of data."""

    def solve(queries: pa.Table, data: pa.Table) -> pa.Table:
        ids = data["id"].to_numpy(zero_copy_only=False)
        order = np.argsort(np.where(np.isnan(ids), np.inf, ids), kind="stable") if ids.dtype.kind == "f" else np.argsort(ids, kind="stable")
        data = data.take(pa.array(order))
        q, x = (np.frombuffer(b"".join(t["v"].to_pylist()), kind).reshape(-1, width).astype(np.int64) for t in (queries, data))
        of_q, of_x, score = best(q, queries["row"].to_numpy(), x, data["row"].to_numpy(), k)
        if floors:  # the k-th score where there are k
            n = np.bincount(of_q, minlength=len(q))
            low = np.full(len(q), np.iinfo(np.int64).max)
            np.minimum.at(low, of_q, score)
            full = np.flatnonzero(n >= k)
            return pa.table({"row": queries["row"].take(pa.array(full)), "floor": pa.array(low[full], pa.int64())})
        return pa.table({"row": queries["row"].take(pa.array(of_q)), "query_id": queries["id"].take(pa.array(of_q)), "vec_id": data["id"].take(pa.array(of_x)), "score": pa.array(score, pa.int64())})

    return solve


def voronoi_top_k(df: DataFrame, key: str, column: str, is_query, k: int = 10, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every row for which is_query(id column) holds."""
    rows, queries, data, wanted, sizes, (width, kind) = needed(df, key, column, is_query, k, pivots, block)
    if rows is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pairs = wanted.select("qb", "g").distinct()
    asked = wanted.join(sizes.select("g", "parts"), "g").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("qb", "g", "part", "row", "id", "v")
    given = data.select("g", "part", "row", "id", "v").join(pairs, "g").select("qb", "g", "part", "row", "id", "v")
    asked = asked.toDF("to", "of", "at", "row", "id", "v")
    found = asked.groupBy("to", "of", "at").cogroup(given.groupBy("qb", "g", "part")).applyInArrow(solver(k, width, kind, False), "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def needed(df: DataFrame, key: str, column: str, is_query, k: int, pivots: int, block: int) -> tuple:
    """(rows, queries, data, wanted, sizes, layout): the grouped vectors, and in `wanted` a row for every query and each
    group that may hold one of its k best."""
    spark = df.sparkSession
    bounded_batches(spark)
    vectors = integer_vectors(df, key, column)
    seen = vectors.agg(F.max(F.size("v")).alias("w"), F.count("*").alias("n"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("top")).first()
    width, top = max(1, seen["w"] or 1), seen["top"] or 0
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    pivots = min(pivots, max(1, int(seen["n"] ** 0.5)))
    sample = vectors.select("v", F.xxhash64("v").alias("h"), "id").orderBy("h", "id").limit(SAMPLE).toArrow()["v"].combine_chunks()
    if not len(sample):
        return (None,) * 5 + ((width, kind),)
    p = centroids(matrix(sample, width), pivots)
    shared = spark.sparkContext.broadcast(p)

    def group(batches):
        for batch in batches:
            x = matrix(batch["v"], width)
            of, distance = nearest(x, shared.value)
            raw = [row.tobytes() for row in x.astype(kind)]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["id"], pa.array(of, pa.int32()), pa.array(distance), pa.array(raw, pa.binary())], ["row", "id", "g", "distance", "v"])

    def boxes(batches):
        low, high = np.full((len(p), width), np.iinfo(np.int64).max), np.full((len(p), width), np.iinfo(np.int64).min)
        for batch in batches:
            x = np.frombuffer(b"".join(batch["v"].to_pylist()), kind).reshape(-1, width).astype(np.int64)
            g = batch["g"].to_numpy()
            np.minimum.at(low, g, x)
            np.maximum.at(high, g, x)
        there = np.flatnonzero(low[:, 0] <= high[:, 0])
        at = np.arange(width)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(there, width), pa.int32()), pa.array(np.tile(at, len(there)), pa.int32()), pa.array(low[there].ravel()), pa.array(high[there].ravel())], ["g", "at", "low", "high"])

    rows = durable(vectors.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "v").mapInArrow(group, "row long, id long, g int, distance double, v binary"), "vectors")
    asking = F.coalesce(is_query(F.col("id")), F.lit(False))
    summary = {r["g"]: r for r in rows.groupBy("g").agg(F.count("*").alias("n"), F.max("distance").alias("radius"), F.count_if(asking).alias("q")).collect()}  # a row per pivot
    radius = np.array([summary[g]["radius"] if g in summary else 0.0 for g in range(len(p))])
    low, high = np.zeros((len(p), width)), np.zeros((len(p), width))
    box = rows.select("g", "v").mapInArrow(boxes, "g int, at int, low long, high long").groupBy("g", "at").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    for side, name in ((low, "low"), (high, "high")):
        side[box["g"].to_numpy(), box["at"].to_numpy()] = box[name].to_numpy()
    there = np.isin(np.arange(len(p)), list(summary))
    parts = {g: -(-r["n"] // block) for g, r in summary.items()}
    q_parts = {g: -(-r["q"] // block) for g, r in summary.items()}
    q_block, filled, number = {}, 0, 0  # small groups of queries share a block
    for g in sorted(summary):
        if filled and filled + summary[g]["q"] > block:
            number, filled = number + 1, 0
        q_block[g] = number
        filled += summary[g]["q"]
        if q_parts[g] > 1:
            number, filled = number + q_parts[g], 0
    sizes = F.broadcast(spark.createDataFrame([(g, parts[g], max(1, q_parts[g]), q_block[g]) for g in summary], "g int, parts int, q_parts int, q_block int"))
    salt = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    data = rows.join(sizes, "g").withColumn("part", salt)
    queries = rows.filter(asking).join(sizes, "g").withColumn("q_part", F.pmod(F.xxhash64("row"), F.col("q_parts")).cast("int")).withColumn("qb", F.col("q_block") + F.col("q_part"))

    home = data.filter("part = 0").withColumn("q_part", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1))).select("g", "q_part", "row", "id", "v")
    mine = queries.select("g", "q_part", "row", "id", "v").toDF("of", "at", "row", "id", "v")  # new columns, apart from the data's
    floors = mine.groupBy("of", "at").cogroup(home.groupBy("g", "q_part")).applyInArrow(solver(k, width, kind, True), "row long, floor long")

    def needs(batches):
        for batch in batches:
            q = np.frombuffer(b"".join(batch["v"].to_pylist()), kind).reshape(-1, width).astype(float)
            floor = np.array([-np.inf if f is None else f for f in batch["floor"].to_pylist()])
            i, g = np.nonzero((bounds(q, shared.value, radius, low, high) >= floor[:, None]) & there[None, :])
            yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(i)) for c in ("qb", "row", "id", "v")), pa.array(g, pa.int32())], ["qb", "row", "id", "v", "g"])

    wanted = durable(queries.select("qb", "row", "id", "v").join(floors, "row", "left").mapInArrow(needs, "qb int, row long, id long, v binary, g int"), "needs")
    return rows, queries, data, wanted, sizes, (width, kind)


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda i: i % 100 == 0)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e)::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
