"""Audits of array datasets: declared contracts, bound sizes, operation logs, graded findings and coverage.

A finding is a row (source, row_key, rule, kind, message, axis); kind is `mismatch` where measured sizes prove a
conflict and `approximation` where it rests on a name alone.
"""

from __future__ import annotations

import ast
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tensor import ShapeError, fail_unless
from .segments import placed

FINDING = ["source", "row_key", "rule", "kind", "message", "axis"]


def array_sizes(column: str, rank: int) -> Column:
    """The sizes of a nested array column as an array of integers; null where an inner level is ragged."""
    fail_unless(rank >= 1, f"rank {rank}")
    sizes, level = [F.size(column)], F.col(column)
    for _ in range(rank - 1):
        inner = F.transform(level, F.size)
        sizes.append(F.when(F.array_min(inner) == F.array_max(inner), F.array_min(inner)))
        level = F.flatten(level)
    return F.array(*sizes)


def product_of(sizes: Column) -> Column:
    """The number of elements of a shape."""
    return F.aggregate(sizes, F.lit(1).cast("long"), lambda a, x: a * x)


def size_at(sizes: Column, axis: int) -> Column:
    """The size of an axis, which may be negative; null where there is none."""
    return F.try_element_at(sizes, F.lit(axis + 1 if axis >= 0 else axis))


def parse_dims(text: Column) -> Column:
    """Dims of a shape text, parted by spaces or commas."""
    return F.filter(F.split(F.trim(text), r"[\s,]+"), lambda x: x != "")


def setting(column: str, *paths: str, default: str | None = None) -> Column:
    """The first of several JSON paths that a settings text has."""
    return F.coalesce(*(F.get_json_object(column, p) for p in paths), F.lit(default))


def spec_parts(spec: str) -> list[str]:
    return spec.replace(",", " ").split()


def dim_value(text: str, bound: dict[str, Column]) -> Column | None:
    """The size that an expression such as `n+1` or `2*n` of whole numbers and bound names stands for; None with a name
    that no array binds."""

    def value(x: ast.expr) -> Column | None:
        if isinstance(x, ast.Constant) and isinstance(x.value, int):
            return F.lit(x.value)
        if isinstance(x, ast.Name):
            return bound.get(x.id)
        if isinstance(x, ast.BinOp) and type(x.op) in (ast.Add, ast.Sub, ast.Mult, ast.FloorDiv):
            a, b = value(x.left), value(x.right)
            if a is None or b is None:
                return None
            return {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.FloorDiv: lambda: F.floor(a / F.nullif(b, F.lit(0)))}[type(x.op)]()
        raise ShapeError(f"'{text}' is no size")

    try:
        return value(ast.parse(text, mode="eval").body)
    except SyntaxError:
        raise ShapeError(f"'{text}' is no size") from None


def nesting(df: DataFrame, column: str) -> int:
    depth, kind = 0, df.schema[column].dataType
    while isinstance(kind, T.ArrayType):
        depth, kind = depth + 1, kind.elementType
    return depth


def check_contracts(df: DataFrame, key: str, specs: dict[str, str], sizes: dict[str, Column] | None = None) -> DataFrame:
    """Findings for rows whose array columns break their specs, such as {'x': '*b n', 'w': '*b n+1'}.

    A part of a spec is a whole number or `n=4` (that size), `_` (any), a name (one size wherever the row's arrays use
    it), a sum, difference, product or whole quotient of names and numbers, `...` (any number of axes) or `*b` (any
    number of axes, the same sizes wherever the row's arrays use it). After `#` the size 1 fits, too, and `#*b` stands
    for sizes that broadcast with one another. A row whose rank does not fit its spec gives that finding alone for the
    column and binds no name; null sizes break nothing.
    """
    sizes = sizes or {}
    columns, base = {}, {}
    for c, spec in specs.items():
        parts = spec_parts(spec)
        open_ = [i for i, p in enumerate(parts) if p == "..." or p.lstrip("#").startswith("*")]
        fail_unless(len(open_) <= 1, f"'{spec}' leaves the rank open twice")
        depth = nesting(df, c)
        fail_unless(c in sizes or depth > 0, f"{c} is no array column")
        base[c] = sizes.get(c, array_sizes(c, max(depth, 1)) if depth else None)
        columns[c] = (spec, parts, open_[0] if open_ else None)
    rows = df.select(F.col(key).alias("k_"), *(base[c].alias(f"s{i}_") for i, c in enumerate(specs)))
    places: dict[str, list] = {}  # of each name: (column, axis, size, may be 1)
    spans: dict[str, list] = {}  # of each group of axes
    exact, rank_of = [], {}
    for i, (c, (spec, parts, open_)) in enumerate(columns.items()):
        s, rank = F.col(f"s{i}_"), len(parts) - (open_ is not None)
        fits = F.size(s) >= rank if open_ is not None else F.size(s) == rank
        rank_of[c] = fits
        exact.append((c, None, ~fits, F.concat(F.lit(f"rank is not that of '{spec}': "), F.size(s).cast("string"))))
        for k, p in enumerate(parts):
            axis = k if open_ is None or k < open_ else k - len(parts)
            loose, name = p.startswith("#"), p.lstrip("#")
            if k == open_:
                if name.startswith("*"):
                    spans.setdefault(name[1:], []).append((c, F.when(fits, F.slice(s, F.lit(k + 1), F.greatest(F.size(s) - rank, F.lit(0)))), loose))
            elif name != "_":
                places.setdefault(name.split("=")[-1], []).append((c, axis, F.when(fits, size_at(s, axis)), loose))
    bound: dict[str, Column] = {}
    for name, uses in places.items():
        if name.isidentifier():  # the first size that must hold, else the first that is not a stretched 1
            bound[name] = F.coalesce(*(size for _, _, size, loose in uses if not loose), *(F.nullif(size, F.lit(1)) for _, _, size, loose in uses if loose), F.lit(None).cast("int"))
    checks = list(exact)
    for name, uses in places.items():
        want = bound[name] if name in bound else dim_value(name, bound)
        if want is None:
            continue
        for c, axis, size, loose in uses:
            wrong = (size != want) & ((size != 1) if loose else F.lit(True))
            text = f"size is not {name}: " if name.isdigit() else f"size is not {name} = "
            says = F.concat(F.lit(text), size.cast("string")) if name.isdigit() else F.concat(F.lit(text), want.cast("string"), F.lit(": "), size.cast("string"))
            checks.append((c, axis, wrong, says))
    for name, uses in spans.items():
        for j, (c, span, loose) in enumerate(uses):
            for _, other, other_loose in uses[:j]:
                wrong = F.exists(aligned_sizes(other, span), lambda p: (p["l"] != p["r"]) & (p["l"] != 1) & (p["r"] != 1)) if loose or other_loose else span != other
                checks.append((c, None, wrong, F.concat(F.lit(f"sizes of *{name} differ: "), F.to_json(other), F.lit(" and "), F.to_json(span))))
    found = F.array(*(F.when(wrong, F.struct(F.lit(c).alias("source"), F.lit(axis).cast("int").alias("axis"), message.alias("message"))) for c, axis, wrong, message in checks))
    told = rows.select("k_", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("c")).distinct()
    return told.select(F.col("c.source").alias("source"), F.col("k_").cast("string").alias("row_key"), F.lit("contract").alias("rule"), F.lit("mismatch").alias("kind"), F.col("c.message").alias("message"), F.col("c.axis").alias("axis"))


def check_contract(df: DataFrame, key: str, column: str, spec: str, sizes: Column | None = None) -> DataFrame:
    """Findings for rows whose sizes break a spec such as 'batch 64'; see check_contracts."""
    return check_contracts(df, key, {column: spec}, {} if sizes is None else {column: sizes})


def bind_dims(observed: DataFrame) -> DataFrame:
    """(name, least, most, sizes, one_size) of observed rows (name, size): a name has one size throughout, 1 aside, which a dim has
    where it is stretched."""
    return observed.groupBy("name").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.count_distinct("size").alias("sizes"), (F.count_distinct(F.when(F.col("size") != 1, F.col("size"))) <= 1).alias("one_size"))


def observed_sizes(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """(name, size): the distinct sizes that a column's arrays show for each named axis."""
    sizes = array_sizes(column, len(names))
    return df.select(F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("name"), sizes.alias("size"))).alias("o")).select("o.name", "o.size").dropna().distinct()


def aligned_sizes(a: Column, b: Column) -> Column:
    """Right-aligned pairs of sizes, absent axes as 1."""
    n = F.greatest(F.size(a), F.size(b))
    side = lambda x: F.concat(F.array_repeat(F.lit(1), n - F.size(x)), x)
    return F.zip_with(side(a), side(b), lambda x, y: F.struct(x.alias("l"), y.alias("r")))


def aligned(a: str, b: str) -> Column:
    return aligned_sizes(F.col(a), F.col(b))


def broadcast_audit(ops: DataFrame, key: str = "op_id", left: str = "left_shape", right: str = "right_shape") -> DataFrame:
    """ops with `result` (null on a conflict) and `conflicts`, the axes counted from the left of the result."""
    pairs = aligned(left, right)
    clash = lambda p: (p["l"] != p["r"]) & (p["l"] != 1) & (p["r"] != 1)
    out = ops.withColumn("pairs_", pairs)
    axes = F.filter(F.transform("pairs_", lambda p, i: F.when(clash(p), i)), lambda i: i.isNotNull())
    result = F.when(F.exists("pairs_", clash), F.lit(None)).otherwise(F.transform("pairs_", lambda p: F.when(p["l"] == 1, p["r"]).otherwise(p["l"])))
    return out.withColumn("conflicts", axes).withColumn("result", result).drop("pairs_")


def contraction_audit(ops: DataFrame, left: str = "left_shape", right: str = "right_shape") -> DataFrame:
    """ops with `conflict` and `result` (null on a conflict) of logged products of any ranks.

    The last size of the left meets the last but one of the right, or its only one; the sizes before these two on each side are
    batch sizes and broadcast from the right. Scalars are refused. An unknown size (null) conflicts with nothing, an unknown
    shape gives no result.
    """
    a, b = F.col(left), F.col(right)
    rank_a, rank_b = F.size(a), F.size(b)
    lead = lambda x, rank: F.slice(x, F.lit(1), F.greatest(rank - 2, F.lit(0)))
    inner = F.when(rank_b > 1, F.try_element_at(b, F.lit(-2))).otherwise(F.try_element_at(b, F.lit(-1)))
    pairs = aligned_sizes(lead(a, rank_a), lead(b, rank_b))
    clash = lambda p: F.coalesce((p["l"] != p["r"]) & (p["l"] != 1) & (p["r"] != 1), F.lit(False))
    conflict = (rank_a == 0) | (rank_b == 0) | F.coalesce(F.try_element_at(a, F.lit(-1)) != inner, F.lit(False)) | F.exists(pairs, clash)
    own = lambda x, rank, at: F.when(rank > 1, F.array(F.try_element_at(x, F.lit(at)))).otherwise(F.slice(x, F.lit(1), F.lit(0)))
    batch = F.transform(pairs, lambda p: F.when(p["l"] == 1, p["r"]).when(p["r"] == 1, p["l"]).otherwise(F.coalesce(p["l"], p["r"])))
    result = F.concat(batch, own(a, rank_a, -2), own(b, rank_b, -1))
    known = a.isNotNull() & b.isNotNull()
    return ops.withColumn("conflict", known & conflict).withColumn("result", F.when(known & ~conflict, result))


def reshape_audit(ops: DataFrame, old: str = "old_shape", new: str = "new_shape") -> DataFrame:
    """ops with `conflict`: the element counts differ; one -1 stands for what divides, and other negative sizes are refused."""
    negative = F.exists(F.col(new), lambda x: x < -1)
    known = product_of(F.filter(F.col(new), lambda x: x != -1))
    free = F.size(F.filter(F.col(new), lambda x: x == -1))
    fits = F.when(free == 0, known == product_of(F.col(old))).when(free == 1, (known > 0) & (product_of(F.col(old)) % F.when(known > 0, known).otherwise(1) == 0)).otherwise(F.lit(False))
    return ops.withColumn("conflict", negative | ~fits)


def concat_audit(operands: DataFrame, key: str = "op_id", shape: str = "shape", axis: str = "axis") -> DataFrame:
    """(op_id, conflict) of operand rows: ranks differ, sizes beside the joined axis differ, an operand is a scalar, or the axis,
    negative ones counted from the end, does not exist.

    Where an empty vector is among operands of other ranks, nothing is claimed: some libraries skip it. Unknown shapes and
    sizes conflict with nothing.
    """
    rows = operands.filter(F.col(shape).isNotNull()).select(key, axis, shape, F.size(shape).alias("rank_"))
    ranks = rows.groupBy(key).agg(
        F.min("rank_").alias("least"), F.max("rank_").alias("most"), F.min(axis).alias("axis_"),
        F.bool_or((F.col("rank_") == 1) & F.coalesce(F.try_element_at(F.col(shape), F.lit(1)) == 0, F.lit(False))).alias("empty"), F.bool_or(F.col("rank_") != 1).alias("other"),
    )
    place = F.when(F.col("axis_") < 0, F.col("axis_") + F.col("most")).otherwise(F.col("axis_"))
    sizes = rows.select(key, F.posexplode_outer(shape).alias("at", "size")).groupBy(key, "at").agg((F.min("size") != F.max("size")).alias("differ"))
    beside = ranks.select(key, place.alias("place")).join(sizes, key).groupBy(key).agg(F.bool_or(F.coalesce("differ", F.lit(False)) & (F.col("at") != F.col("place"))).alias("beside"))
    wrong = (F.col("least") != F.col("most")) | (F.col("least") == 0) | (place < 0) | (place >= F.col("most")) | F.coalesce("beside", F.lit(False))
    claimed = ranks.join(beside, key).select(key, (wrong & ~(F.col("empty") & F.col("other"))).alias("conflict"))
    return operands.select(key).distinct().join(claimed, key, "left").select(key, F.coalesce("conflict", F.lit(False)).alias("conflict"))


def grade(df: DataFrame, declared: str, measured: str) -> DataFrame:
    """df with `kind`: mismatch where two known sizes differ, approximation where only a name speaks, else null. Declared sizes are
    numbers or names, as text."""
    number = F.col(declared).try_cast("int")
    return df.withColumn("kind", F.when(number.isNotNull() & F.col(measured).isNotNull() & (number != F.col(measured)), "mismatch").when(number.isNull() | F.col(measured).isNull(), "approximation"))


def summary(findings: DataFrame) -> DataFrame:
    """One row: sources, errors, warnings and the exit code."""
    out = findings.agg(F.count_distinct("source").alias("sources"), F.count_if(F.col("kind") == "mismatch").alias("errors"), F.count_if(F.col("kind") == "approximation").alias("warnings"))
    return out.withColumn("exit_code", F.when(F.col("errors") > 0, 1).otherwise(0))


def dedupe(findings: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first finding of each key."""
    first = findings.groupBy(*keys).agg(F.min(F.struct(*order, *(c for c in findings.columns if c not in order and c not in keys))).alias("f_"))
    return first.select(*keys, "f_.*").select(*findings.columns)


def coverage(df: DataFrame, known: Column, cause: str) -> DataFrame:
    """(cause, rows, known, share), the largest number of unknown rows first."""
    out = df.groupBy(cause).agg(F.count("*").alias("rows"), F.count_if(known).alias("known"))
    return out.withColumn("share", F.col("known") / F.col("rows")).orderBy(F.desc(F.col("rows") - F.col("known")), cause)


def shape_profile(df: DataFrame, column: str, rank: int = 1) -> DataFrame:
    """How often each shape of an array column occurs."""
    return df.groupBy(array_sizes(column, rank).alias("sizes")).agg(F.count("*").alias("rows"))


def oracle_compare(predicted: DataFrame, measured: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, both values and `passes`: a prediction that is null passes, a missing or unequal one does not."""
    p, m = predicted.select(*keys, F.col(column).alias("predicted"), F.lit(True).alias("there_")), measured.select(*keys, F.col(column).alias("measured"))
    both = p.join(m, keys, "full")
    ok = (F.col("there_") & F.col("predicted").isNull()) | (F.col("predicted") == F.col("measured"))
    return both.withColumn("passes", F.coalesce(ok, F.lit(False))).drop("there_")


def oversize(df: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """(column, rows, over, largest): arrays longer than a limit."""
    parts = [df.agg(F.lit(c).alias("column"), F.count(c).alias("rows"), F.count_if(F.size(c) > limit).alias("over"), F.max(F.size(c)).alias("largest")) for c in columns]
    return fold(DataFrame.unionByName, parts)


def worst(df: DataFrame, key: str, column: str, k: int) -> DataFrame:
    """The k longest arrays."""
    return df.select(key, F.size(column).alias("size")).orderBy(F.desc("size"), key).limit(k)


def latency_stats(samples: DataFrame, scenario: str, value: str) -> DataFrame:
    """p50, p95 (nearest rank) and the largest, to one digit."""
    rows = placed(samples.filter(F.col(value).isNotNull()).select(scenario, F.col(value).alias("v_")), [scenario], ["v_"])
    at = lambda q: F.round(F.max(F.when(F.col("r_") == F.greatest(F.ceil(F.col("n_") * q), F.lit(1)) - 1, F.col("v_"))), 1)
    return rows.groupBy(scenario).agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.round(F.max("v_"), 1).alias("max"))


