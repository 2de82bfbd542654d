"""Evaluation losses with reduction none, mean or sum."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.catalogue import softplus
from ..tensor import Tensor, fail_unless
from .broadcast import binary
from .index import take_along
from .reduce import logsumexp, reduce
from .window import softmax

POINTWISE = {
    "mse": lambda x, y: (x - y) * (x - y), "l1": lambda x, y: F.abs(x - y),
    "smooth_l1": lambda x, y, beta=1.0: F.when(F.abs(x - y) < beta, 0.5 * (x - y) * (x - y) / beta).otherwise(F.abs(x - y) - 0.5 * beta),
    "huber": lambda x, y, delta=1.0: F.when(F.abs(x - y) <= delta, 0.5 * (x - y) * (x - y)).otherwise(delta * (F.abs(x - y) - 0.5 * delta)),
    "bce": lambda p, y: -(y * F.greatest(F.log(p), F.lit(-100.0)) + (1 - y) * F.greatest(F.log(1 - p), F.lit(-100.0))),
    "bce_with_logits": lambda x, y: softplus(x) - x * y,
}


def finished(t: Tensor, reduction: str) -> Tensor:
    fail_unless(reduction in ("none", "mean", "sum"), f"unknown reduction {reduction}")
    return t if reduction == "none" else reduce(t, reduction)


def loss(name: str, x: Tensor, y: Tensor, reduction: str = "mean", **options) -> Tensor:
    fail_unless(name in POINTWISE, f"unknown loss {name}")
    fail_unless(reduction in ("none", "mean", "sum"), f"unknown reduction {reduction}")
    if name.startswith("bce"):
        fail_unless(x.rank == y.rank and all(None in (a, b) or a == b for a, b in zip(x.sizes, y.sizes, strict=True)), f"sizes {x.sizes} and {y.sizes} differ")
    return finished(binary(x, y, expression=lambda a, b: POINTWISE[name](a, b, **options)), reduction)


def cross_entropy(x: Tensor, target: Tensor, reduction: str = "mean") -> Tensor:
    """x holds scores, classes in dim 0 of a vector, else dim 1; the target holds classes or, with x's dims, probabilities."""
    fail_unless(reduction in ("none", "mean", "sum"), f"unknown reduction {reduction}")
    c = x.dims[0 if x.rank == 1 else 1]
    if set(target.dims) == set(x.dims):
        per_cell = binary(softmax(x, c, log=True), target, expression=lambda a, b: -a * b)
        return finished(reduce(per_cell, "sum", c), reduction)
    fail_unless(set(target.dims) == set(x.others(c)), f"target dims {target.dims} for {x.dims}")
    return finished(binary(logsumexp(x, c), picked(x, target, c), "subtract"), reduction)


def picked(x: Tensor, target: Tensor, c: str) -> Tensor:
    at = target.with_df(target.df.withColumn(c, F.lit(0).cast("long")), [*target.dims, c], [*target.sizes, 1])
    return take_along(x, at, c).with_df(take_along(x, at, c).df, list(target.dims), list(target.sizes))


def nll_loss(x: Tensor, target: Tensor, reduction: str = "mean") -> Tensor:
    """The negated log probability of each target class."""
    return finished(picked(x, target, x.dims[0 if x.rank == 1 else 1]).map(lambda v: -v), reduction)
