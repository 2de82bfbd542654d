"""Contractions: joins on the summed dims, then a grouped sum."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import functions as F

from ..sources.scratch import durable
from ..tensor import Tensor, fail_unless, fresh
from .blocks import blocked, pays
from .broadcast import align, binary, join_sizes, joined
from .cyclic import applies, cyclic_sum

SMALL = 100_000  # cells of a side that is sent to every task


def small(t: Tensor) -> bool:
    n = 1
    for s in t.sizes:
        if s is None:
            return False
        n *= s
    return n <= SMALL


def contract(a: Tensor, b: Tensor, over: list[str], keep: list[str] | None = None) -> Tensor:
    """Sum over the dims `over` of products of cells that agree on all shared dims; `keep` orders the result's dims.

    A small side is sent to every task; two large ones of known sizes are multiplied in tiles; otherwise products are rows.
    """
    a, b = (t if not t.fill else t.dense() for t in (a, b))
    for d in a.dims:
        if d in b.dims:
            x, y = a.size(d), b.size(d)
            fail_unless(x is None or y is None or x == y or (1 in (x, y) and d not in over), f"sizes {x} and {y} of {d} differ")
    dims = [d for d in (*a.dims, *(d for d in b.dims if d not in a.dims)) if d not in over]
    dims = keep if keep is not None else dims
    size = {d: join_sizes(d, *(t.size(d) for t in (a, b))) if d in a.dims and d in b.dims else (a if d in a.dims else b).size(d) for d in dims}
    if over and not small(a) and not small(b) and all(d in a.dims and d in b.dims for d in over) and pays(a, b, over):
        return blocked(a, b, over, list(dims))
    if small(b):  # its size is known and bounded
        b = b.with_df(F.broadcast(b.df))
    elif small(a):
        a = a.with_df(F.broadcast(a.df))
    pair = align(a, b)
    out = pair.df.withColumn("value", F.col("left") * F.col("right"))
    if over:
        out = out.groupBy(*dims).agg(F.sum("value").alias("value"))
    return Tensor(out.select(*dims, "value"), dims, [size[d] for d in dims], 0.0)


def renamed(b: Tensor, names: dict[str, str], taken) -> Tensor:
    """b with the given names, and its other dims renamed where taken."""
    out, used = {}, set(taken) | set(names.values())
    for d in b.dims:
        out[d] = names[d] if d in names else fresh(d, used)
        used.add(out[d])
    return b.rename(**out)


def matmul(a: Tensor, b: Tensor) -> Tensor:
    """The matrix product over the last dim of a and the last but one of b; leading dims broadcast from the right."""
    fail_unless(a.rank > 0 and b.rank > 0, "a scalar has no matrix product")
    k = a.dims[-1]
    inner = b.dims[-2] if b.rank > 1 else b.dims[0]
    x, y = a.size(k), b.size(inner)
    fail_unless(x is None or y is None or x == y, f"inner sizes {x} and {y} differ")
    lead = dict(zip(reversed(b.dims[:-2]), reversed(a.dims[:-2]), strict=False))
    other = renamed(b, {inner: k, **lead}, a.dims)
    batch = [d for d in other.dims[:-2] if d not in a.dims] + list(a.dims[:-2]) if b.rank > 2 else list(a.dims[:-2])
    keep = [*batch, *(a.dims[-2:-1]), *(other.dims[-1:] if b.rank > 1 else [])]
    return contract(a, other, [k], keep)


def strict(a: Tensor, b: Tensor, ranks: tuple[int, int], what: str) -> None:
    fail_unless((a.rank, b.rank) == ranks, f"{what} takes ranks {ranks}, not {(a.rank, b.rank)}")


def mm(a: Tensor, b: Tensor) -> Tensor:
    strict(a, b, (2, 2), "mm")
    return matmul(a, b)


def mv(a: Tensor, b: Tensor) -> Tensor:
    strict(a, b, (2, 1), "mv")
    return matmul(a, b)


def bmm(a: Tensor, b: Tensor) -> Tensor:
    strict(a, b, (3, 3), "bmm")
    x, y = a.size(0), b.size(0)
    fail_unless(x is None or y is None or x == y, f"batch sizes {x} and {y} differ")
    return matmul(a, b)


def addmm(c: Tensor, a: Tensor, b: Tensor, beta: float = 1, alpha: float = 1) -> Tensor:
    product = mm(a, b)
    return binary(product, c, expression=lambda x, y: alpha * x + beta * y, positional=True)


def baddbmm(c: Tensor, a: Tensor, b: Tensor, beta: float = 1, alpha: float = 1) -> Tensor:
    return binary(bmm(a, b), c, expression=lambda x, y: alpha * x + beta * y, positional=True)


def dot(a: Tensor, b: Tensor) -> Tensor:
    """Last dim with last but one; a scalar multiplies."""
    if not a.rank or not b.rank:
        return binary(a, b, "multiply")
    inner = b.dims[-2] if b.rank > 1 else b.dims[0]
    return tensordot(a, b, [a.dims[-1]], [inner])


def inner(a: Tensor, b: Tensor) -> Tensor:
    return tensordot(a, b, [a.dims[-1]], [b.dims[-1]]) if a.rank and b.rank else binary(a, b, "multiply")


def vdot(a: Tensor, b: Tensor) -> Tensor:
    """The sum over all cells of two tensors of one shape."""
    fail_unless(a.rank == b.rank, "vdot needs equal ranks")
    return tensordot(a, b, list(a.dims), list(b.dims))


def tensordot(a: Tensor, b: Tensor, over_a: list, over_b: list) -> Tensor:
    over_a, over_b = a.names(over_a), b.names(over_b)
    fail_unless(len(over_a) == len(over_b), "as many dims of a as of b are contracted")
    for x, y in zip(over_a, over_b, strict=True):
        fail_unless(a.size(x) is None or b.size(y) is None or a.size(x) == b.size(y), f"sizes {a.size(x)} and {b.size(y)} differ")
    return contract(a, renamed(b, dict(zip(over_b, over_a, strict=True)), a.dims), over_a)


def dot_general(a: Tensor, b: Tensor, over: tuple[list, list], batch: tuple[list, list]) -> Tensor:
    """Contracted and batch dims by name or number; the batch dims come first."""
    names = dict(zip(b.names(over[1]), a.names(over[0]), strict=True)) | dict(zip(b.names(batch[1]), a.names(batch[0]), strict=True))
    other = renamed(b, names, a.dims)
    gone, first = a.names(over[0]), a.names(batch[0])
    keep = [*first, *(d for d in a.dims if d not in gone and d not in first), *(d for d in other.dims if d not in a.dims)]
    return contract(a, other, gone, keep)


def outer(a: Tensor, b: Tensor) -> Tensor:
    """Products of all pairs: as many cells as the result has."""
    return contract(a, renamed(b, {}, a.dims), [])


def kron(a: Tensor, b: Tensor) -> Tensor:
    """Dims multiply: the cell (i, p) goes to i * size + p."""
    fail_unless(a.rank == b.rank, "kron needs equal ranks")
    n, other = b.measured, renamed(b, {}, a.dims)
    out = contract(a, other, []).df
    for d, e, s in zip(a.dims, other.dims, n, strict=True):
        out = out.withColumn(d, F.col(d) * s + F.col(e))
    return Tensor(out.select(*a.dims, "value"), a.dims, [x * y for x, y in zip(a.measured, n, strict=True)], 0.0)


def cartesian_prod(*vectors: Tensor):
    """A row for each combination of the vectors' values: columns v0, v1, …, and the position `i` in row-major order."""
    fail_unless(all(v.rank == 1 for v in vectors), "vectors are needed")
    out, place = None, F.lit(0).cast("long")
    for k, v in enumerate(vectors):
        part = v.df.select(F.col(v.dims[0]).alias(f"i{k}"), F.col("value").alias(f"v{k}"))
        out = part if out is None else out.crossJoin(part)
        place = place * v.length(0) + F.col(f"i{k}")
    return out.select(place.alias("i"), *(f"v{k}" for k in range(len(vectors))))


def combinations(v: Tensor, r: int = 2):
    """Rows of r values at increasing positions."""
    fail_unless(v.rank == 1 and r >= 1, "a vector and r >= 1 are needed")
    part = lambda k: v.df.select(F.col(v.dims[0]).alias(f"i{k}"), F.col("value").alias(f"v{k}"))
    return fold(lambda df, k: df.join(part(k), F.col(f"i{k - 1}") < F.col(f"i{k}")), range(1, r), part(0))


def parse_einsum(spec: str, ranks: list[int]) -> tuple[list[str], str]:
    left, arrow, right = spec.replace(" ", "").partition("->")
    inputs = left.split(",")
    fail_unless(len(inputs) == len(ranks), f"{len(inputs)} terms for {len(ranks)} operands")
    for term, rank in zip(inputs, ranks, strict=True):
        fail_unless(len(term) == rank, f"{term} for rank {rank}")
    letters = "".join(inputs)
    if not arrow:
        right = "".join(sorted(c for c in set(letters) if letters.count(c) == 1))
    fail_unless(all(c in letters for c in right) and len(set(right)) == len(right), f"output {right}")
    return inputs, right


def einsum(spec: str, *tensors: Tensor) -> Tensor:
    """Any labels. Operands are joined two at a time, the pair with the smallest result first, and labels that nothing
    else needs are summed away at once. Labels that form a cycle are joined in one round instead."""
    inputs, output = parse_einsum(spec, [t.rank for t in tensors])
    sizes: dict[str, int | None] = {}
    parts = []
    for term, t in zip(inputs, tensors, strict=True):
        t = t if not t.fill else t.dense()
        df, seen = t.df, {}
        for c, d in zip(term, t.dims, strict=True):
            sizes[c] = join_sizes(c, sizes.get(c, 1), t.size(d)) if c in sizes else t.size(d)
            if c in seen:
                df = df.filter(F.col(seen[c]) == F.col(d))
            else:
                seen[c] = d
        labels = list(seen)
        one = Tensor(df.select(*(F.col(seen[c]).alias(c) for c in labels), "value"), labels, [t.size(seen[c]) for c in labels], 0.0)
        parts.append(one)
    if applies(parts):
        return Tensor(cyclic_sum(parts, list(output)).select(*output, "value"), list(output), [sizes[c] for c in output], 0.0)
    guess = lambda c: sizes[c] or 1000  # noqa: E731  only to order the joins
    while len(parts) > 1:
        best = None
        for i in range(len(parts)):
            for j in range(i):
                rest = set(output).union(*(p.dims for k, p in enumerate(parts) if k not in (i, j)))
                labels = [c for c in dict.fromkeys((*parts[j].dims, *parts[i].dims)) if c in rest]
                cost = 1
                for c in labels:
                    cost *= guess(c)
                if best is None or cost < best[0]:
                    best = cost, j, i, labels
        _, j, i, labels = best
        a, b = parts[j], parts[i]
        over = [c for c in dict.fromkeys((*a.dims, *b.dims)) if c not in labels]
        merged = contract(a, b, over, labels)
        parts = [p for k, p in enumerate(parts) if k not in (i, j)] + [merged]
    (last,) = parts
    if set(last.dims) != set(output):
        last = last.with_df(last.df.groupBy(*output).agg(F.sum("value").alias("value")), list(output), fill=0.0)
    return last.with_df(last.df, list(output))


def multi_dot(matrices: list[Tensor]) -> Tensor:
    """The product of a chain of matrices, in the cheapest order."""
    fail_unless(len(matrices) >= 2, "two matrices at least")
    letters = "abcdefghijklmnopqrstuvwxyz"
    fail_unless(len(matrices) < 26, "too many matrices")
    for x, y in zip(matrices, matrices[1:], strict=False):
        fail_unless(x.size(-1) is None or y.size(0) is None or x.size(-1) == y.size(0), "inner sizes differ")
    spec = ",".join(letters[i : i + 2] for i in range(len(matrices))) + f"->a{letters[len(matrices)]}"
    return einsum(spec, *matrices).rename(a=matrices[0].dims[0], **{letters[len(matrices)]: fresh(matrices[-1].dims[1], matrices[0].dims[:1])})


def matrix_power(t: Tensor, n: int) -> Tensor:
    """Repeated squaring; each square is a written table, so the plan does not grow."""
    fail_unless(t.rank == 2 and n >= 1, "a square matrix and n >= 1 are needed")
    fail_unless(t.size(0) is None or t.size(1) is None or t.size(0) == t.size(1), "the matrix is not square")
    i, j = t.dims
    out, square = None, t
    while n:
        if n & 1:
            out = square if out is None else Tensor(mm(out, square).df.toDF(i, j, "value"), (i, j), t.sizes, 0.0)
        n >>= 1
        if n:
            p = mm(square, square)
            square = Tensor(durable(p.df.toDF(i, j, "value")), (i, j), t.sizes, 0.0)
    return out


def cross(a: Tensor, b: Tensor, axis: str | int = -1) -> Tensor:
    """The vector product along a dim of size 3."""
    d = a.name(axis)
    fail_unless(a.size(d) in (3, None) and b.size(b.name(axis)) in (3, None), "cross needs size 3")
    rest = a.others(d)
    b = b.rename(**dict(zip(b.dims, a.dims, strict=True)))
    sparse = a.fill == b.fill == 0  # vectors that one side lacks have a product of zeros
    if not sparse:
        a, b = a.dense(), b.dense()
    wide = lambda t: t.df.groupBy(*rest).agg(*(F.coalesce(F.sum(F.when(F.col(d) == k, F.col("value"))), F.lit(0.0) if sparse else F.lit(None)).alias(f"x{k}") for k in range(3)))
    x, y = wide(a).toDF(*rest, "a0", "a1", "a2"), wide(b).toDF(*rest, "b0", "b1", "b2")
    both = x.join(y, rest) if rest else x.crossJoin(y)
    c = F.col
    parts = F.array(c("a1") * c("b2") - c("a2") * c("b1"), c("a2") * c("b0") - c("a0") * c("b2"), c("a0") * c("b1") - c("a1") * c("b0"))
    out = both.select(*rest, F.posexplode(parts).alias(d, "value")).withColumn(d, c(d).cast("long"))
    return Tensor(out.select(*a.dims, "value"), a.dims, tuple(3 if x == d else s for x, s in zip(a.dims, a.sizes, strict=True)), 0.0 if sparse else None)


def linear(x: Tensor, weight: Tensor, bias: Tensor | None = None) -> Tensor:
    """x times the transposed weight (out, in), plus a bias (out)."""
    fail_unless(weight.rank == 2, "the weight is a matrix")
    n, m = x.size(-1), weight.size(1)
    fail_unless(n is None or m is None or n == m, f"input width {n}, weight width {m}")
    out = tensordot(x, weight, [x.dims[-1]], [weight.dims[1]])
    return out if bias is None else binary(out, bias.rename(**{bias.dims[0]: out.dims[-1]}), "add")


def packed_linear(df, column: str, weight: list[list[float]], out: str = "scores"):
    """Scoring of array columns with a small weight matrix (out, in): no join, no shuffle."""
    row = lambda w: F.aggregate(F.zip_with(F.col(column), F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn(out, F.array(*(row(w) for w in weight)))


def bilinear(x: Tensor, w: Tensor, y: Tensor) -> Tensor:
    """x' W_o y for every output o of w (out, in1, in2); leading dims of x and y are shared."""
    fail_unless(w.rank == 3, "the weight has three dims")
    o = fresh(w.dims[0], (*x.dims, *y.dims))
    p, q = x.dims[-1], fresh(y.dims[-1], x.dims)
    y = y.rename(**{y.dims[-1]: q})
    w = w.rename(**dict(zip(w.dims, (o, p, q), strict=True)))
    half = contract(x, w, [p])
    return contract(half, y, [q], [*x.dims[:-1], o])


def packed_dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b):
    """Similarity of two array columns; 0 where one has length 0."""
    n = F.sqrt(packed_dot(a, a)) * F.sqrt(packed_dot(b, b))
    return F.when(n == 0, 0.0).otherwise(packed_dot(a, b) / n)


def cosine_similarity(a: Tensor, b: Tensor, axis: str | int = -1) -> Tensor:
    """Drops one dim; the other dims are shared. 0 where one side has length 0."""
    d = a.name(axis)
    ratio = lambda p, x, y: F.when(x * y == 0, 0.0).otherwise(p / (F.sqrt(x) * F.sqrt(y)))
    if a.fill is None and b.fill is None:  # every cell is there: all sums in one pass
        pair = align(a, b)
        kept = [x for x in pair.dims if x != d]
        sums = pair.df.groupBy(*kept).agg(F.sum(F.col("left") * F.col("right")).alias("p"), F.sum(F.col("left") ** 2).alias("x"), F.sum(F.col("right") ** 2).alias("y"))
        return Tensor(sums.select(*kept, ratio(F.col("p"), F.col("x"), F.col("y")).alias("value")), kept, [s for x, s in zip(pair.dims, pair.sizes, strict=True) if x != d], None)
    a, b = (t if t.fill in (0, None) else t.dense() for t in (a, b))
    square = lambda t: Tensor(t.df.groupBy(*t.others(d)).agg(F.sum(F.col("value") ** 2).alias("value")), t.others(d), [t.size(x) for x in t.others(d)], 0.0)
    return joined(contract(a, b, [d]), square(a), square(b)).map(ratio)


def attention(q: Tensor, k: Tensor, v: Tensor) -> Tensor:
    """softmax(q k' / sqrt(width)) v on (…, query, width), (…, key, width), (…, key, out)."""
    from .window import softmax

    width = q.length(-1)
    fail_unless(k.size(-1) in (None, width), "query and key widths differ")
    key = fresh("key", q.dims)
    k = k.rename(**{k.dims[-2]: key, k.dims[-1]: q.dims[-1]})
    out = fresh(v.dims[-1], (*q.dims, key)) if v.dims[-1] in q.dims[:-1] else v.dims[-1]
    v = v.rename(**{v.dims[-2]: key, v.dims[-1]: out})
    scores = contract(q, k, [q.dims[-1]]).map(lambda x: x / F.sqrt(F.lit(float(width))))
    return contract(softmax(scores, key), v, [key])
