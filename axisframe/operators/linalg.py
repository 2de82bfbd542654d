"""Linear algebra of tall matrices: rows spread over the cluster, few columns, held as an array column.

Factors come from a tree of QR steps. Blocks of rows are factorised by Householder reflections, their R factors are stacked
FAN at a time and factorised again until one is left, and the pieces of the stacked Q factors are multiplied down the tree,
so that Q is as orthogonal as a local one whatever the condition number. The Gram matrix, which squares it, serves only
where it is asked for itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import durable
from ..tensor import ShapeError, fail_unless

BLOCK = 4096  # rows that are factorised at once, on average
FAN = 16  # R factors that are stacked


def columns_of(df: DataFrame, column: str) -> int:
    r = df.agg(F.min(F.size(column)).alias("a"), F.max(F.size(column)).alias("b")).first()
    if r["a"] is None or r["a"] != r["b"]:
        raise ShapeError(f"rows of {r['a']} to {r['b']} values")
    return r["a"]


def gram(df: DataFrame, column: str, extra: str | None = None) -> np.ndarray:
    """X'X (and the products with one more column, and its square), one grouped sum over cell pairs of each row's array.

    The result has columns ** 2 numbers, whatever the rows.
    """
    n = columns_of(df, column)
    row = F.col(column) if extra is None else F.concat(F.transform(column, lambda x: x.cast("double")), F.array(F.col(extra).cast("double")))
    n += extra is not None
    wide = df.select(F.transform(row, lambda x: x.cast("double")).alias("x"))
    sums = wide.agg(*(F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"s{i}_{j}") for i in range(n) for j in range(i + 1))) if n <= 16 else None
    out = np.zeros((n, n))
    if sums is not None:
        r = sums.first()
        for i in range(n):
            for j in range(i + 1):
                out[i, j] = out[j, i] = r[f"s{i}_{j}"]
        return out

    def partial(batches):
        import pyarrow as pa

        total = np.zeros((n, n))
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n), n)), pa.array(np.tile(np.arange(n), n)), pa.array(total.ravel())], ["i", "j", "v"])

    for r in wide.mapInArrow(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r["i"], r["j"]] = r["v"]
    return out


def covariance(df: DataFrame, column: str) -> np.ndarray:
    n = columns_of(df, column)
    g, rows = gram(df, column), df.count()
    means = df.select(F.posexplode(column).alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m")).collect()
    m = np.zeros(n)
    for r in means:
        m[r["k"]] = r["m"]
    fail_unless(rows > 1, "two rows at least")
    return (g - rows * np.outer(m, m)) / (rows - 1)


def eigh(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and vectors with a positive largest component."""
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return values, vectors * np.where(sign == 0, 1, sign)


def matrix_of(column, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, "<f8").tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8").reshape(-1, n)


def stacked(group, n: int):
    """(parent, child, piece, r): the QR step of a node, a row with its piece of Q for each child and one with R."""
    import pyarrow as pa

    group = group.sort_by("id")
    factors = [unpacked(r, n) for r in group["r"].to_pylist()]
    q, r = np.linalg.qr(np.vstack(factors))
    ends = np.cumsum([len(f) for f in factors])
    pieces = [packed(q[end - len(f) : end]) for f, end in zip(factors, ends.tolist(), strict=True)]
    parent = [group["parent"][0].as_py()] * (len(pieces) + 1)
    return pa.table({"parent": parent, "child": pa.array([*group["id"].to_pylist(), None], pa.int64()), "piece": pa.array([*pieces, None], pa.binary()), "r": pa.array([*[None] * len(pieces), packed(r)], pa.binary())})


def climbed(factors: DataFrame, count: int, n: int) -> tuple[list[DataFrame], np.ndarray]:
    """(the levels' pieces from the leaves up, R) of (id, r) with ids below count."""
    levels = []

    def step(group):
        return stacked(group, n)

    while True:
        level = durable(factors.withColumn("parent", F.floor(F.col("id") / FAN).cast("long")).groupBy("parent").applyInArrow(step, "parent long, child long, piece binary, r binary"), "level")
        levels.append(level.filter("child IS NOT NULL"))
        factors, count = level.filter("child IS NULL").select(F.col("parent").alias("id"), "r"), -(-count // FAN)
        if count <= 1:
            return levels, unpacked(factors.first()["r"], n)


def signs(r: np.ndarray) -> np.ndarray:
    """Flips that make the diagonal of R positive."""
    return np.where(np.diagonal(r) < 0, -1.0, 1.0)


def r_factor(df: DataFrame, column: str, extra: str | None = None) -> np.ndarray:
    """The upper triangle R of the rows, with a further column if asked, its diagonal not negative: one pass, then the tree."""
    n = columns_of(df, column) + (extra is not None)
    row = F.transform(column, lambda x: x.cast("double"))
    wide = df.select((row if extra is None else F.concat(row, F.array(F.col(extra).cast("double")))).alias("x"))
    tasks = wide.rdd.getNumPartitions()

    def local(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        r = np.zeros((0, n))
        for batch in batches:
            r = np.linalg.qr(np.vstack([r, matrix_of(batch["x"], n)]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([packed(r)], pa.binary())], ["id", "r"])

    _, r = climbed(wide.mapInArrow(local, "id long, r binary"), tasks, n)
    return signs(r)[:, None] * r


def turned(df: DataFrame, column: str, out: str, root) -> tuple[DataFrame, np.ndarray]:
    """(df with each row of Q times a matrix, R): root(R) is that matrix. Q comes down the tree; each block's own factor is formed
    again beside its rows."""
    import pyarrow as pa

    n = columns_of(df, column)
    rows = durable(df.withColumn("row_", F.monotonically_increasing_id()), "rows")
    count = max(1, -(-rows.count() // BLOCK))
    rows = rows.withColumn("block_", F.pmod(F.xxhash64("row_"), F.lit(count)))
    own = lambda group: matrix_of(group.sort_by("row_")[column].combine_chunks(), n)

    def leaf(group):
        return pa.table({"id": [group["block_"][0].as_py()], "r": pa.array([packed(np.linalg.qr(own(group), mode="r"))], pa.binary())})

    levels, r = climbed(rows.select(F.col(column), "row_", "block_").groupBy("block_").applyInArrow(leaf, "id long, r binary"), count, n)
    last = root(r)
    wide = last.shape[1]

    def down(batches):
        for batch in batches:
            made = [packed(unpacked(p, len(unpacked(m, wide))) @ unpacked(m, wide)) for p, m in zip(batch["piece"].to_pylist(), batch["m"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["child"], pa.array(made, pa.binary())], ["id", "m"])

    factors = df.sparkSession.createDataFrame([(0, packed(last))], "id long, m binary")
    for level in reversed(levels):
        factors = level.select("child", "piece", "parent").join(factors.withColumnRenamed("id", "parent"), "parent").select("child", "piece", "m").mapInArrow(down, "id long, m binary")

    kept = [c for c in df.columns if c != out]

    def leaves(group, factor):
        group = group.sort_by("row_")
        q = np.linalg.qr(own(group))[0]
        q = q @ unpacked(factor["m"][0].as_py(), wide)
        return group.select(kept).append_column(out, pa.FixedSizeListArray.from_arrays(pa.array(q.ravel()), wide).cast(pa.list_(pa.float64())))

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    made = rows.groupBy("block_").cogroup(factors.groupBy("id")).applyInArrow(leaves, f"{kinds}, `{out}` array<double>")
    return made, r


def project(df: DataFrame, column: str, matrix: np.ndarray, out: str) -> DataFrame:
    """Each row's array times a small matrix, as expressions: no join, no shuffle."""
    dot = lambda w: F.aggregate(F.zip_with(column, F.array(*(F.lit(float(x)) for x in w)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return df.withColumn(out, F.array(*(dot(matrix[:, j]) for j in range(matrix.shape[1]))))


def oriented(u: np.ndarray, vt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both factors with each right vector's largest component positive."""
    sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])
    sign = np.where(sign == 0, 1, sign)
    return u * sign, vt * sign[:, None]


def rank_of(s: np.ndarray, tolerance: float) -> int:
    return int((s > tolerance * s.max(initial=0)).sum())


def svd(df: DataFrame, column: str, k: int | None = None, out: str = "u", tolerance: float = 1e-13) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(df with each row's thin left factor, singular values, right factor). Values up to `tolerance` times the largest count as 0
    and are left out, so a matrix of rank r has at most r of them."""
    found = {}

    def root(r):
        u, s, vt = np.linalg.svd(r, full_matrices=False)
        u, vt = oriented(u, vt)
        kept = min(k or len(s), rank_of(s, tolerance))
        found["s"], found["v"] = s[:kept], vt[:kept].T
        return u[:, :kept]

    made, _ = turned(df, column, out, root)
    return made, found["s"], found["v"]


def pca(df: DataFrame, column: str, k: int, out: str = "scores") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(df with scores, components, explained shares) of the k largest directions, by the R factor of the centred rows."""
    n = columns_of(df, column)
    means = np.zeros(n)
    for r in df.select(F.posexplode(column).alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m")).toLocalIterator():
        means[r["k"]] = r["m"]
    centre = F.array(*map(F.lit, means.tolist()))
    centred = df.select(F.zip_with(F.transform(column, lambda x: x.cast("double")), centre, lambda x, m: x - m).alias("x"))
    _, s, vt = np.linalg.svd(r_factor(centred, "x"), full_matrices=False)
    _, vt = oriented(vt.T, vt)
    return project(df, column, vt[:k].T, out), vt[:k].T, s[:k] ** 2 / (s**2).sum()


def qr(df: DataFrame, column: str, out: str = "q") -> tuple[DataFrame, np.ndarray]:
    """(df with each row of Q, R), the diagonal of R not negative; at least as many rows as columns. Columns that depend on
    others give zeros, up to rounding, on the diagonal of R, and Q is orthogonal all the same."""
    made, r = turned(df, column, out, lambda r: np.diag(signs(r)))
    fail_unless(r.shape[0] == r.shape[1], f"{r.shape[0]} rows, {r.shape[1]} columns")
    return made, signs(r)[:, None] * r


def lstsq(df: DataFrame, column: str, target: str) -> np.ndarray:
    """The shortest coefficients that minimise squared errors, from the R factor of the columns and the target."""
    r = r_factor(df, column, target)
    return np.linalg.lstsq(r[:, :-1], r[:, -1], rcond=None)[0]


def matrix_rank(df: DataFrame, column: str, tolerance: float = 1e-12) -> int:
    return rank_of(np.linalg.svd(r_factor(df, column), compute_uv=False), tolerance)
