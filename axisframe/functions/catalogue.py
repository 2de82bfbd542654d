"""Elementwise functions by name, as built-in column expressions that stay in generated code.

Random forms (dropout) hash the coordinates, so a cell's fate does not depend on partitioning.
"""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
BIGGEST = 1.7976931348623157e308


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def erf(x: Column) -> Column:
    """The error function to about 1e-15: its series of positive terms up to 2.5, beyond that a continued fraction."""
    a = F.abs(x)
    z = a * a
    series, fraction = F.lit(1.0), F.lit(1.0)
    for n in range(48, 0, -1):
        series = series * z * (2 / (2 * n + 1)) + 1
    for n in range(32, 0, -1):
        fraction = F.lit(n / 2) / (z * fraction) + 1
    near = a * series * F.exp(-z) * (2 / sqrt(pi))
    far = 1 - F.exp(-z) / (a * fraction * sqrt(pi))
    return F.when(F.isnan(x), x).otherwise(F.signum(x) * F.when(a < 2.5, near).when(a > 6, 1.0).otherwise(far))


def log_of(f):
    """A logarithm that gives NaN and -inf where the array libraries do; Spark's gives null."""
    return lambda x: F.when(x > 0, f(x)).when(x == 0, F.lit(-INF)).otherwise(F.lit(float("nan")))


def div(a: Column, b: Column) -> Column:
    """a / b with the array libraries' infinities and NaN for b = 0."""
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).otherwise(F.signum(a) * INF)
    return F.when(b == 0, by_zero).otherwise(a.cast("double") / b)


UNARY = {
    "exp": F.exp, "exp2": lambda x: F.pow(F.lit(2.0), x), "expm1": F.expm1, "log": log_of(F.log), "log2": log_of(F.log2), "log10": log_of(F.log10),
    "log1p": lambda x: log_of(lambda y: F.log1p(y - 1))(x + 1), "sqrt": F.sqrt, "rsqrt": lambda x: div(F.lit(1.0), F.sqrt(x)), "cbrt": F.cbrt, "square": lambda x: x * x,
    "abs": F.abs, "fabs": F.abs, "sign": F.signum, "ceil": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"), "trunc": trunc, "rint": F.rint,
    "positive": lambda x: x, "negative": lambda x: -x, "reciprocal": lambda x: div(F.lit(1.0), x),
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh, "deg2rad": F.radians, "rad2deg": F.degrees,
    "isnan": F.isnan, "isinf": lambda x: F.abs(x) == INF, "isfinite": lambda x: ~F.isnan(x) & (F.abs(x) < INF), "isneginf": lambda x: x == -INF, "isposinf": lambda x: x == INF,
    "signbit": lambda x: (x < 0) | ((x == 0) & x.cast("string").startswith("-")), "logical_not": lambda x: ~x.cast("boolean"),
    "nan_to_num": lambda x: F.when(F.isnan(x), 0.0).when(x == INF, BIGGEST).when(x == -INF, -BIGGEST).otherwise(x),
    "relu": lambda x: F.greatest(x, F.lit(0.0)), "relu6": lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(6.0)), "sigmoid": sigmoid,
    "erf": erf, "gelu_exact": lambda x: 0.5 * x * (1 + erf(x / sqrt(2))), "gelu": lambda x: 0.5 * x * (1 + F.tanh(sqrt(2 / pi) * (x + 0.044715 * x * x * x))), "silu": lambda x: x * sigmoid(x),
    "hard_sigmoid": lambda x: F.least(F.greatest(x / 6 + 0.5, F.lit(0.0)), F.lit(1.0)), "hard_tanh": lambda x: F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)),
    "softplus": softplus, "softsign": lambda x: x / (1 + F.abs(x)), "selu": lambda x: 1.0507009873554805 * F.when(x > 0, x).otherwise(1.6732632423543772 * F.expm1(x)),
    "celu": lambda x, a=1.0: F.when(x > 0, x).otherwise(a * F.expm1(x / a)), "elu": lambda x, a=1.0: F.when(x > 0, x).otherwise(a * F.expm1(x)),
    "leaky_relu": lambda x, slope=0.01: F.when(x >= 0, x).otherwise(slope * x), "prelu": lambda x, slope=0.25: F.when(x >= 0, x).otherwise(slope * x),
    "hardswish": lambda x: x * F.least(F.greatest(x + 3, F.lit(0.0)), F.lit(6.0)) / 6, "mish": lambda x: x * F.tanh(softplus(x)), "log_sigmoid": lambda x: -softplus(-x),
    "tanhshrink": lambda x: x - F.tanh(x), "threshold": lambda x, at=0.0, value=0.0: F.when(x > at, x).otherwise(F.lit(value)),
    "softshrink": lambda x, at=0.5: F.when(x > at, x - at).when(x < -at, x + at).otherwise(0.0), "hardshrink": lambda x, at=0.5: F.when(F.abs(x) > at, x).otherwise(0.0),
    "one_minus_square": lambda x: 1 - x * x,
}
UNARY |= {a: UNARY[b] for a, b in {
    "absolute": "abs", "neg": "negative", "fix": "trunc", "round": "rint", "around": "rint", "degrees": "rad2deg", "radians": "deg2rad", "swish": "silu",
    "hard_silu": "hardswish", "hardtanh": "hard_tanh", "hardsigmoid": "hard_sigmoid", "LogSigmoid": "log_sigmoid", "acos": "arccos", "asin": "arcsin", "atan": "arctan",
}.items()}


def round_to(x: Column, digits: int = 0) -> Column:
    """Half to even."""
    return F.bround(x, digits)


def logaddexp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def skip_nan(f):
    return lambda a, b: F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(f(a, b))


def keep_nan(f):
    return lambda a, b: F.when(F.isnan(a) | F.isnan(b), F.lit(float("nan"))).otherwise(f(a, b))


BINARY = {
    "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": div,
    "floor_divide": lambda a, b: F.floor(div(a, b)).cast("double"), "power": F.pow, "remainder": lambda a, b: F.when(b == 0, F.lit(float("nan"))).otherwise(a - b * F.floor(a / b)), "fmod": lambda a, b: F.when(b == 0, F.lit(float("nan"))).otherwise(a % b),
    "copysign": lambda a, b: F.when(UNARY["signbit"](b), -F.abs(a)).otherwise(F.abs(a)),
    "maximum": keep_nan(F.greatest), "minimum": keep_nan(F.least), "fmax": skip_nan(F.greatest), "fmin": skip_nan(F.least),
    "equal": lambda a, b: a == b, "not_equal": lambda a, b: a != b, "less": lambda a, b: a < b, "less_equal": lambda a, b: a <= b, "greater": lambda a, b: a > b, "greater_equal": lambda a, b: a >= b,
    "logical_and": lambda a, b: a.cast("boolean") & b.cast("boolean"), "logical_or": lambda a, b: a.cast("boolean") | b.cast("boolean"), "logical_xor": lambda a, b: a.cast("boolean") != b.cast("boolean"),
    "arctan2": F.atan2, "hypot": F.hypot, "logaddexp": logaddexp, "heaviside": lambda a, b: F.when(a < 0, 0.0).when(a > 0, 1.0).otherwise(b),
    "boxcox": lambda x, l: F.when(l == 0, log_of(F.log)(x)).otherwise((F.pow(x, l) - 1) / l), "boxcox1p": lambda x, l: F.when(l == 0, UNARY["log1p"](x)).otherwise((F.pow(1 + x, l) - 1) / l),
}
BINARY |= {a: BINARY[b] for a, b in {
    "sub": "subtract", "mul": "multiply", "div": "divide", "true_divide": "divide", "pow": "power", "float_power": "power", "mod": "remainder",
    "eq": "equal", "ne": "not_equal", "lt": "less", "le": "less_equal", "gt": "greater", "ge": "greater_equal", "atan2": "arctan2",
}.items()}


def comb(n: Column, k: Column) -> Column:
    """Binomial coefficients of whole numbers; 0 outside 0 <= k <= n. Rounded to the nearest whole number."""
    product = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), k.cast("int"))), F.lit(1.0), lambda a, i: a * (n - k + i) / i)
    return F.when((k < 0) | (k > n), 0.0).when(k == 0, 1.0).otherwise(F.rint(product))


def mulhi(a: Column, b: Column) -> Column:
    """The upper 32 bits of the 64-bit product of 32-bit integers."""
    return F.shiftright(a.cast("long") * b.cast("long"), 32)


def polynomial(x: Column, coefficients: Column) -> Column:
    """Horner's rule; the highest coefficient first."""
    return F.aggregate(coefficients, F.lit(0.0), lambda a, c: a * x + c)

