"""Tensors from tables, literals, ranges, closed forms and random numbers; corpus scans and diagnostics sinks."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tensor import ShapeError, Tensor, fail_unless, fresh, grid

REDUCERS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "first": F.min}


def tensor_from_table(df: DataFrame, dims: dict[str, Column | str] | list[str], value: Column | str, how: str = "sum", sizes: dict[str, int] | None = None, fill: float | None = 0.0) -> Tensor:
    """Names the dims and the value of a table; equal coordinates are reduced by the stated aggregate, rows with a null coordinate are not cells."""
    fail_unless(how in REDUCERS, f"unknown reducer {how}")
    named = {d: d for d in dims} if isinstance(dims, list) else dims
    col = lambda c: F.col(c) if isinstance(c, str) else c
    picked = df.select(*(col(c).alias(d) for d, c in named.items()), col(value).alias("value")).dropna(subset=list(named)) if named else df.select(col(value).alias("value"))
    out = picked.groupBy(*named).agg(REDUCERS[how]("value").alias("value"))
    return Tensor(out, tuple(named), tuple((sizes or {}).get(d) for d in named), fill)


#: Folders that hold no sources of their own; those whose name starts with a dot are left out, too.
SKIPPED = ("build", "dist", "node_modules", "site-packages", "target", "venv", "__pycache__")


def scan_corpus(spark: SparkSession, path: str, pattern: str = "*", skip: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, text): one row for each file below path whose name fits, each file once; folders below path that are hidden
    or in `skip` are left out, whatever the folders above path are called.

    Spark's readers never list names that start with a dot or an underscore.
    """
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath()
    depth = len([x for x in root.split("/") if x])
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    named = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    steps = F.filter(F.split(F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/"), lambda x: x != "")
    below = F.slice(steps, F.lit(depth + 1), F.greatest(F.size(steps) - depth - 1, F.lit(0)))
    return named.filter(~F.exists(below, lambda x: x.isin(*skip) | x.startswith("."))).dropDuplicates(["path"])


def write_diagnostics(findings: DataFrame, path: str, form: str = "parquet", mode: str = "append") -> None:
    """Findings as files, one folder for each kind."""
    findings.write.mode(mode).partitionBy("kind").format(form).save(path)


def diagnostic_lines(findings: DataFrame) -> DataFrame:
    """Findings as text lines: source:row: severity: message."""
    severity = F.when(F.col("kind") == "mismatch", "error").otherwise("warning")
    return findings.select(F.concat_ws(": ", F.concat_ws(":", "source", "row_key"), severity, "message").alias("line"))


def shape_of(nested) -> tuple[int, ...]:
    if not isinstance(nested, (list, tuple)):
        return ()
    inner = {shape_of(x) for x in nested}
    fail_unless(len(inner) <= 1, "ragged nested list")
    return (len(nested), *(inner.pop() if inner else ()))


def array_literal(spark: SparkSession, nested, dims: list[str] | None = None) -> Tensor:
    """A rectangular nested list; a ragged one is refused."""
    sizes = shape_of(nested)
    dims = dims or [f"d{i}" for i in range(len(sizes))]
    fail_unless(len(dims) == len(sizes), f"{len(dims)} names for rank {len(sizes)}")
    rows = []

    def walk(x, at):
        if len(at) == len(sizes):
            rows.append((*at, float(x)))
        else:
            for i, y in enumerate(x):
                walk(y, (*at, i))

    walk(nested, ())
    return Tensor(spark.createDataFrame(rows, ", ".join([*(f"`{d}` long" for d in dims), "value double"])), dims, sizes, None)


def full(spark: SparkSession, sizes: dict[str, int], value) -> Tensor:
    fail_unless(all(s >= 0 for s in sizes.values()), f"negative size in {sizes}")
    return Tensor(grid(spark, sizes).withColumn("value", F.lit(value)), tuple(sizes), tuple(sizes.values()), None)


def zeros(spark, sizes):
    return full(spark, sizes, 0.0)


def ones(spark, sizes):
    return full(spark, sizes, 1.0)


def full_like(t: Tensor, value) -> Tensor:
    return t.dense().map(lambda _: F.lit(value), fill=None)


def pack(t: Tensor, dim: str | int, column: str = "vec") -> DataFrame:
    """One row for each cell of the other dims, with the values along dim, in order, as an array."""
    d = t.name(dim)
    return t.dense().df.groupBy(*t.others(d)).agg(F.transform(F.array_sort(F.collect_list(F.struct(d, "value"))), lambda x: x["value"]).alias(column))


def unpack_axis(df: DataFrame, dims: list[str], column: str, dim: str, sizes: dict[str, int] | None = None) -> Tensor:
    """The array column becomes a dim."""
    out = df.select(*dims, F.posexplode(column).alias(dim, "value")).withColumn(dim, F.col(dim).cast("long")).filter("value IS NOT NULL")
    sizes = sizes or {}
    return Tensor(out, (*dims, dim), tuple(sizes.get(d) for d in (*dims, dim)), None)


def arange(spark: SparkSession, start: float, stop: float | None = None, step: float = 1, dim: str = "i") -> Tensor:
    start, stop = (0, start) if stop is None else (start, stop)
    fail_unless(step != 0, "step is 0")
    n = max(0, ceil((stop - start) / step))
    return Tensor(spark.range(n).select(F.col("id").alias(dim), (F.lit(start) + F.col("id") * step).alias("value")), (dim,), (n,), None)


def linspace(spark: SparkSession, start, stop, num: int = 50, endpoint: bool = True, dim: str = "i") -> Tensor:
    """num evenly spaced values; start and stop may be tensors of equal dims, which follow the new dim."""
    fail_unless(num >= 0, "negative number of values")
    share = F.col(dim) / F.lit(float(max(1, num - 1 if endpoint else num)))
    if isinstance(start, Tensor) or isinstance(stop, Tensor):
        from ..operators.broadcast import align, as_tensor

        pair = align(as_tensor(spark, start), as_tensor(spark, stop))
        out = pair.df.withColumn(dim, F.explode(F.sequence(F.lit(0), F.lit(num - 1))) if num else F.explode(F.array().cast("array<int>"))).withColumn(dim, F.col(dim).cast("long"))
        return Tensor(out.select(dim, *pair.dims, (F.col("left") + (F.col("right") - F.col("left")) * share).alias("value")), (dim, *pair.dims), (num, *pair.sizes), None)
    return Tensor(spark.range(num).withColumnRenamed("id", dim).withColumn("value", F.lit(float(start)) + (float(stop) - float(start)) * share), (dim,), (num,), None)


def logspace(spark, start, stop, num=50, base=10.0, dim="i"):
    return linspace(spark, start, stop, num, dim=dim).map(lambda v: F.pow(F.lit(base), v))


def geomspace(spark, start: float, stop: float, num=50, dim="i"):
    fail_unless(start * stop > 0, "geomspace needs ends of one sign, not 0")
    sign = 1 if start > 0 else -1
    return linspace(spark, 0.0, 1.0, num, dim=dim).map(lambda v: F.lit(float(start)) * F.pow(F.lit(stop / start), v) if sign else v)


def eye(spark: SparkSession, n: int, m: int | None = None, k: int = 0, dims=("i", "j"), sparse: bool = True) -> Tensor:
    m = n if m is None else m
    t = Tensor(spark.range(n).select(F.col("id").alias(dims[0]), (F.col("id") + k).alias(dims[1]), F.lit(1.0).alias("value")).filter(f"`{dims[1]}` >= 0 AND `{dims[1]}` < {m}"), dims, (n, m), 0.0)
    return t if sparse else t.dense()


def tri(spark: SparkSession, n: int, m: int | None = None, k: int = 0, dims=("i", "j")) -> Tensor:
    """Ones where j <= i + k."""
    return tril(ones(spark, {dims[0]: n, dims[1]: n if m is None else m}), k)


def triangle(t: Tensor, keep) -> Tensor:
    fail_unless(t.rank >= 2, "a triangle needs rank 2")
    i, j = t.dims[-2:]
    return t.with_df(t.df.filter(keep(F.col(i), F.col(j))), fill=0.0)


def triu(t: Tensor, k: int = 0) -> Tensor:
    return triangle(t, lambda i, j: j >= i + k)


def tril(t: Tensor, k: int = 0) -> Tensor:
    return triangle(t, lambda i, j: j <= i + k)


def diag(t: Tensor, k: int = 0, dim: str = "j") -> Tensor:
    """A vector on the k-th diagonal of a square matrix, or that diagonal of a matrix."""
    if t.rank == 2:
        return diagonal(t, k)
    fail_unless(t.rank == 1, f"diag takes rank 1 or 2, not {t.rank}")
    (i,), n = t.dims, t.length(0) + abs(k)
    j = fresh(dim, t.dims)
    out = t.df.withColumn(j, F.col(i) + max(k, 0)).withColumn(i, F.col(i) + max(-k, 0))
    return Tensor(out.select(i, j, "value"), (i, j), (n, n), 0.0)


def diagonal(t: Tensor, k: int = 0, a: str | int = 0, b: str | int = 1) -> Tensor:
    """Cells with j = i + k; the two dims give way to one at the end, named after the first."""
    fail_unless(t.rank >= 2, "diagonal needs rank 2")
    i, j = t.name(a), t.name(b)
    fail_unless(i != j, "diagonal needs two dims")
    n, m = t.size(i), t.size(j)
    rest = t.others(i, j)
    size = None if n is None or m is None else max(0, min(n, m - k) if k >= 0 else min(n + k, m))
    out = t.df.filter(F.col(j) == F.col(i) + k).withColumn(i, F.col(i) + min(k, 0))
    return t.with_df(out, (*rest, i), (*(t.size(d) for d in rest), size))


def trace(t: Tensor, k: int = 0, a: str | int = 0, b: str | int = 1) -> Tensor:
    from ..operators.reduce import reduce

    d = diagonal(t, k, a, b)
    return reduce(d, "sum", d.dims[-1])


def diagflat(t: Tensor, k: int = 0) -> Tensor:
    from ..operators.reshape import flatten

    return diag(flatten(t), k)


def meshgrid(*axes: Tensor) -> list[Tensor]:
    """The 'xy' form of two vectors: both outputs have shape (ny, nx)."""
    fail_unless(len(axes) == 2 and all(a.rank == 1 for a in axes), "meshgrid takes two vectors")
    x, y = axes
    fail_unless(x.dims != y.dims, "meshgrid needs two names")
    from ..operators.broadcast import spread

    sizes = (y.length(0), x.length(0))
    return [spread(x, {y.dims[0]: sizes[0]}, first=True), spread(y, {x.dims[0]: sizes[1]})]


def indices(spark: SparkSession, sizes: dict[str, int], dim: str = "axis") -> Tensor:
    """The coordinates of a grid along a leading dim."""
    out = grid(spark, sizes).withColumn("c", F.array(*(F.col(d) for d in sizes)))
    return Tensor(out.select(F.posexplode("c").alias(dim, "value"), *sizes).withColumn(dim, F.col(dim).cast("long")), (dim, *sizes), (len(sizes), *sizes.values()), None)


def sample(spark: SparkSession, sizes: dict[str, int], kind: str = "uniform", seed: int = 0, low=0.0, high=1.0, p=0.5) -> Tensor:
    """Random numbers of a named distribution, from Spark's seeded generators and inverse distribution functions."""
    u = F.rand(seed)
    centred = u - 0.5
    forms = {
        "uniform": lambda: F.lit(low) + u * (high - low),
        "normal": lambda: F.randn(seed),
        "lognormal": lambda: F.exp(F.randn(seed)),
        "randint": lambda: F.floor(F.lit(low) + u * (high - low)).cast("double"),
        "exponential": lambda: -F.log1p(-u),
        "gumbel": lambda: -F.log(-F.log1p(-u)),
        "laplace": lambda: -F.signum(centred) * F.log1p(-2 * F.abs(centred)),
        "logistic": lambda: F.log(u) - F.log1p(-u),
        "cauchy": lambda: F.tan(F.lit(3.141592653589793) * centred),
        "bernoulli": lambda: (u < p).cast("double"),
        "rademacher": lambda: F.when(u < 0.5, -1.0).otherwise(1.0),
        "bits": lambda: F.floor(u * float(2**32)).cast("double"),
    }
    cells = grid(spark, sizes)
    if kind == "truncated_normal":  # drawn again while outside, up to eight times, then brought to the nearer bound
        draws = F.array(*(F.randn(seed + i) for i in range(8)))
        inside = F.filter("draws", lambda x: (x >= low) & (x <= high))
        out = cells.withColumn("draws", draws).withColumn("value", F.coalesce(F.try_element_at(inside, F.lit(1)), F.least(F.greatest(F.col("draws")[7], F.lit(low)), F.lit(high)))).drop("draws")
    else:
        fail_unless(kind in forms, f"unknown distribution {kind}")
        out = cells.withColumn("value", forms[kind]())
    return Tensor(out, tuple(sizes), tuple(sizes.values()), None)


BLOCK = 4096  # categories whose counts are drawn at once


def drawn(rows: DataFrame, keys: list[str], n: str, seed: int) -> DataFrame:
    """(keys, n_): rows with a column p of weights, replaced by the counts of n draws among them.

    Each count is a binomial of what is left, given the counts before it, so a draw costs its categories whatever n. The
    generator of a row depends on its keys only. Without a positive weight all counts are 0.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = []
            for key, count, p in zip(batch["key_"].to_pylist(), batch["draws_"].to_pylist(), batch["p"].to_pylist(), strict=True):
                p = np.array([x or 0.0 for x in p])
                random = np.random.Generator(np.random.PCG64([seed, key % 2**64]))
                out.append(random.multinomial(count, p / p.sum()).tolist() if p.sum() > 0 else [0] * len(p))
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), pa.array(out, pa.list_(pa.int64()))], [*keys, "n_"])

    given = rows.select(*keys, F.xxhash64(F.lit(seed), *keys).alias("key_"), F.col(n).cast("long").alias("draws_"), "p")
    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    return given.mapInArrow(run, f"{kinds}n_ array<long>")


def sample_multinomial(p: Tensor, n: int, seed: int = 0) -> Tensor:
    """Counts of n draws for each cell of the leading dims over the categories of the last dim, whose values are weights.

    The draws go to blocks of categories first and then to the categories of each block, so neither n nor the number of
    categories makes rows: the result has one for each category that was drawn.
    """
    fail_unless(p.rank >= 1 and 0 <= n < 2**63, "multinomial needs categories and a count that is not negative")
    c, rest = p.dims[-1], list(p.dims[:-1])
    cells = p.dense().df.withColumn("block_", F.floor(F.col(c) / BLOCK).cast("long")).withColumn("at_", (F.col(c) % BLOCK).cast("int"))
    listed = lambda at, x: F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), x.alias("p"))))
    blocks = cells.groupBy(*rest, "block_").agg(listed("at_", F.col("value").cast("double")).alias("list_"))
    blocks = blocks.withColumn("p", F.transform("list_", lambda x: x["p"])).withColumn("whole_", F.aggregate("p", F.lit(0.0), lambda s, x: s + x))
    slices = blocks.groupBy(*rest).agg(listed("block_", F.col("whole_")).alias("list_")).withColumn("p", F.transform("list_", lambda x: x["p"])).withColumn("asked_", F.lit(n))
    shared = drawn(slices.withColumn("none_", F.lit(0)), [*rest, "none_", "list_"], "asked_", seed)
    share = shared.select(*rest, F.explode(F.arrays_zip("list_", "n_")).alias("e_")).select(*rest, F.col("e_.list_.at").alias("block_"), F.col("e_.n_").alias("asked_")).filter("asked_ > 0")
    inside = drawn(blocks.join(share, [*rest, "block_"]), [*rest, "block_", "list_"], "asked_", seed + 1)
    hit = inside.select(*rest, "block_", F.explode(F.arrays_zip("list_", "n_")).alias("e_")).filter("e_.n_ > 0")
    out = hit.select(*rest, (F.col("block_") * BLOCK + F.col("e_.list_.at")).alias(c), F.col("e_.n_").cast("double").alias("value"))
    return Tensor(out, p.dims, p.sizes, 0.0)


def circulant(c: Tensor, dim: str = "j") -> Tensor:
    """(…, n) to (…, n, n): the cell (i, j) holds c[(i - j) mod n]."""
    i, n = c.dims[-1], c.length(-1)
    j = fresh(dim, c.dims)
    out = c.df.withColumn(j, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).withColumn(i, F.pmod(F.col(i) + F.col(j), F.lit(n)))
    return Tensor(out.select(*c.dims, j, "value"), (*c.dims, j), (*c.sizes[:-1], n, n), c.fill)


def convolution_matrix(a: Tensor, n: int, mode: str = "full", dim: str = "j") -> Tensor:
    """The matrix that convolves a vector of n with a: rows full m + n - 1, same max(m, n), valid max - min + 1."""
    i, m = a.dims[-1], a.length(-1)
    fail_unless(n > 0 and m > 0, "empty convolution")
    rows = {"full": m + n - 1, "same": max(m, n), "valid": max(m, n) - min(m, n) + 1}
    if mode not in rows:
        raise ShapeError(f"unknown mode {mode}")
    skip = {"full": 0, "same": (min(m, n) - 1) // 2, "valid": min(m, n) - 1}[mode]
    j = fresh(dim, a.dims)
    out = a.df.withColumn(j, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).withColumn(i, F.col(i) + F.col(j) - skip).filter(f"`{i}` >= 0 AND `{i}` < {rows[mode]}")
    return Tensor(out.select(*a.dims, j, "value"), (*a.dims, j), (*a.sizes[:-1], rows[mode], n), 0.0)

