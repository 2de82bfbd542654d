"""Queries on constructors and elementwise operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.catalogue import BINARY, UNARY, comb, mulhi, polynomial, round_to
from ..operators import broadcast as B
from ..operators import reduce as R
from ..operators import reshape as S
from ..operators import window as W
from ..operators.contract import contract
from ..sources import build
from .common import ACT, EMB, PART, QTY, act, emb, month_of, plain, price, qty, query, rounded, size, table


@query(f"WITH {QTY} SELECT nation, month, value FROM qty")
def s1_tensor_from_table(spark, d):
    return qty(spark, d).df


@query(f"WITH {QTY} SELECT nation, month, 1.0::DOUBLE AS value FROM dense")
def s4_ones_like(spark, d):
    return build.full_like(qty(spark, d), 1.0).df


@query(f"WITH {QTY} SELECT nation, list(value ORDER BY month) AS vec FROM dense GROUP BY nation")
def s5_pack(spark, d):
    return build.pack(qty(spark, d), "month")


@query(f"WITH {EMB} SELECT vec, k, value FROM emb")
def s5_unpack_axis(spark, d):
    return emb(spark, d).df


@query(f"WITH {QTY} SELECT month, month * 2.5 + 1 AS value, total FROM (SELECT month, sum(value) AS total FROM dense GROUP BY month)")
def s6_arange_axis(spark, d):
    t = R.reduce(qty(spark, d), "sum", "nation")
    axis = build.arange(spark, 1, 1 + 2.5 * t.length("month"), 2.5, dim="month")
    return axis.df.join(t.dense().df.withColumnRenamed("value", "total"), "month")


@query("""SELECT i::BIGINT AS i, p_brand AS brand, round(lo + (hi - lo) * (i / 4.0), 6) AS value
FROM (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY p_brand), range(5) r(i)""")
def s7_linspace_price_steps(spark, d):
    t = build.tensor_from_table(table(spark, d, "part"), {"brand": F.col("p_brand")}, "p_retailprice", "min")
    u = build.tensor_from_table(table(spark, d, "part"), {"brand": F.col("p_brand")}, "p_retailprice", "max")
    return rounded(build.linspace(spark, t, u, 5))


GRAM = f"WITH {QTY}, gram AS (SELECT a.nation, b.nation AS other, sum(a.value * b.value) AS value FROM qty a JOIN qty b USING (month) GROUP BY ALL)"


def gram(spark, d):
    t = qty(spark, d)
    return contract(t, t.rename(nation="other"), ["month"])


@query(f"{GRAM} SELECT nation, other, value FROM gram WHERE nation = other")
def s8_identity_mask(spark, d):
    g = gram(spark, d)
    one = build.eye(spark, 25, dims=("nation", "other"))
    return B.binary(g, one, "multiply", outer=False).df


@query(f"{GRAM} SELECT nation, other, value FROM gram WHERE other >= nation + 1")
def s9_triu(spark, d):
    return build.triu(gram(spark, d), 1).df


@query(f"{GRAM} SELECT nation, value FROM gram WHERE nation = other")
def s10_diagonal(spark, d):
    return build.diagonal(gram(spark, d)).df


@query(f"{GRAM} SELECT sum(value) AS value FROM gram WHERE nation = other")
def s10_trace(spark, d):
    return build.trace(gram(spark, d)).df


@query(f"WITH {QTY}, x AS (SELECT nation, sum(value) AS value FROM dense GROUP BY nation) SELECT month, nation, value FROM months CROSS JOIN x")
def s11_meshgrid(spark, d):
    t = qty(spark, d)
    x, y = R.reduce(t, "sum", "month").dense(), R.reduce(t, "sum", "nation")
    return build.meshgrid(build.Tensor(x.df, x.dims, x.sizes, None), y)[0].df


@query(f"WITH {QTY} SELECT 0::BIGINT AS axis, nation, month, nation::DOUBLE AS value FROM dense UNION ALL SELECT 1, nation, month, month FROM dense")
def s12_indices(spark, d):
    t = qty(spark, d)
    return plain(build.indices(spark, dict(zip(t.dims, t.measured, strict=True))))


@query(f"WITH {EMB} SELECT count(*) AS cells, true AS inside, true AS centred, true AS spread, true AS varied FROM emb")
def s13_sample_noise(spark, d):
    """A truncated normal sample of the embeddings' shape: its bounds, mean, standard deviation and number of values."""
    t = emb(spark, d)
    noise = build.sample(spark, dict(zip(t.dims, t.measured, strict=True)), "truncated_normal", seed=11, low=-2.0, high=2.0).df
    v = F.col("value")
    near = lambda x, at, n: F.abs(x - at) < 6 / F.sqrt(n)  # noqa: E731  six standard errors
    n = F.count("*")
    return noise.agg(n.alias("cells"), (F.min(v).between(-2, 0) & F.max(v).between(0, 2)).alias("inside"), near(F.avg(v), 0.0, n).alias("centred"), near(F.stddev_pop(v), 0.8796, n).alias("spread"), (F.count_distinct("value") > 0.9 * n).alias("varied"))


@query(f"WITH {ACT} SELECT \"user\", 10.0::DOUBLE AS draws, true AS possible FROM act GROUP BY \"user\"")
def s14_sample_multinomial(spark, d):
    """Ten draws for each user, only of hours that the user has."""
    t = act(spark, d)
    drawn = build.sample_multinomial(t, 10, seed=5).df.withColumnRenamed("value", "drawn")
    both = drawn.join(t.df, ["user", "hour"], "left")
    return both.groupBy("user").agg(F.sum("drawn").alias("draws"), F.bool_and(F.coalesce(F.col("value") > 0, F.lit(False))).alias("possible"))


@query(f"""WITH {QTY}, m AS (SELECT month, sum(value) AS value FROM dense GROUP BY month), n AS (SELECT count(*) AS n FROM m)
SELECT (a.month + b.month) % n AS month, b.month AS j, a.value FROM m a, m b, n""")
def s16_circulant(spark, d):
    return build.circulant(R.reduce(qty(spark, d), "sum", "nation")).df


@query(f"""WITH {QTY}, m AS (SELECT month, sum(value) AS value FROM dense GROUP BY month)
SELECT (month + j)::BIGINT AS month, j::BIGINT AS j, value FROM m, range(3) r(j)""")
def s16_convolution_matrix(spark, d):
    return build.convolution_matrix(R.reduce(qty(spark, d), "sum", "nation").dense(), 3).df


def columns(df, key, x, names, make):
    return df.select(key, *(F.round(make(n)(x), 6).alias(n) for n in names))


UN1 = ["exp", "exp2", "expm1", "log1p", "sqrt", "rsqrt", "cbrt", "square", "abs", "sign", "ceil", "floor", "trunc", "rint", "negative", "reciprocal"]


@query("""SELECT c_custkey, round(exp(x), 6) AS "exp", round(pow(2, x), 6) AS exp2, round(exp(x) - 1, 6) AS expm1, round(ln(x + 1), 6) AS log1p, round(sqrt(x), 6) AS "sqrt", round(1 / sqrt(x), 6) AS rsqrt,
round(cbrt(x), 6) AS "cbrt", round(x * x, 6) AS square, abs(x) AS "abs", sign(x)::DOUBLE AS sign, ceil(x) AS ceil, floor(x) AS floor, trunc(x) AS trunc, round_even(x, 0) AS rint, -x AS negative, round(1 / x, 6) AS reciprocal
FROM (SELECT c_custkey, abs(c_acctbal) / 1000 + 0.0625 AS x FROM customer)""")
def e1_unary_maths(spark, d):
    x = F.abs("c_acctbal") / 1000 + 0.0625
    t = table(spark, d, "customer").select("c_custkey", x.alias("x"))
    keep = {"abs", "negative", "ceil", "floor", "trunc", "rint", "sign"}
    return t.select("c_custkey", *((UNARY[n](F.col("x")) if n in keep else F.round(UNARY[n](F.col("x")), 6)).alias(n) for n in UN1))


TRIG = ["sin", "cos", "tan", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "arcsinh", "arctanh", "deg2rad", "rad2deg"]


@query("""SELECT vec_id, round(sin(x), 6) AS "sin", round(cos(x), 6) AS "cos", round(tan(x), 6) AS "tan", round(asin(x), 6) AS arcsin, round(acos(x), 6) AS arccos, round(atan(x), 6) AS arctan,
round(sinh(x), 6) AS "sinh", round(cosh(x), 6) AS "cosh", round(tanh(x), 6) AS "tanh", round(asinh(x), 6) AS arcsinh, round(atanh(x), 6) AS arctanh, round(radians(x), 6) AS deg2rad, round(degrees(x), 6) AS rad2deg
FROM (SELECT vec_id, embedding[1]::DOUBLE AS x FROM embeddings)""")
def e2_trigonometry(spark, d):
    t = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"))
    return columns(t, "vec_id", F.col("x"), TRIG, lambda n: UNARY[n])


@query("""SELECT c_custkey, isnan(x) AS "isnan", isinf(x) AS "isinf", isfinite(x) AS "isfinite", x = 'inf'::DOUBLE AS isposinf, x = '-inf'::DOUBLE AS isneginf, x < 0 AS signbit, x = 0 AS logical_not,
CASE WHEN isnan(x) THEN 0.0 WHEN x = 'inf'::DOUBLE THEN 1.7976931348623157e308 WHEN x = '-inf'::DOUBLE THEN -1.7976931348623157e308 ELSE x END AS nan_to_num
FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'inf'::DOUBLE WHEN 1 THEN '-inf'::DOUBLE WHEN 2 THEN 'nan'::DOUBLE WHEN 3 THEN 0.0 ELSE c_acctbal END AS x FROM customer)""")
def e3_predicates_e4_nan_to_num(spark, d):
    k = F.col("c_custkey") % 5
    x = F.when(k == 0, float("inf")).when(k == 1, float("-inf")).when(k == 2, float("nan")).when(k == 3, 0.0).otherwise(F.col("c_acctbal"))
    t = table(spark, d, "customer").select("c_custkey", x.alias("x"))
    names = ["isnan", "isinf", "isfinite", "isposinf", "isneginf", "signbit", "logical_not", "nan_to_num"]
    return t.select("c_custkey", *(UNARY[n](F.col("x")).alias(n) for n in names))


@query(f"WITH {QTY}, n AS (SELECT nation, sum(value) AS total FROM qty GROUP BY nation) SELECT nation, month, round(value / total, 9) AS value FROM qty JOIN n USING (nation)")
def e5_share_of_nation(spark, d):
    t = qty(spark, d)
    return rounded(B.binary(t, R.reduce(t, "sum", "month"), "divide", outer=False), 9)


PAIRS = ["add", "subtract", "multiply", "divide", "floor_divide", "remainder", "fmod", "copysign"]


@query(f"""WITH {PART} SELECT part, round(price + size, 4) AS add, round(price - size, 4) AS subtract, round(price * size, 4) AS multiply, round(price / size, 6) AS divide, floor(price / size) AS floor_divide,
round(price - size * floor(price / size), 4) AS remainder, round(price % size, 4) AS "fmod", price AS "copysign" FROM pr""")
def e5_binary_arithmetic(spark, d):
    pair = B.align(price(spark, d), size(spark, d))
    exact = {"floor_divide", "copysign"}
    return pair.df.select("part", *((BINARY[n](F.col("left"), F.col("right")) if n in exact else F.round(BINARY[n](F.col("left"), F.col("right")), 6 if n == "divide" else 4)).alias(n) for n in PAIRS))


@query(f"""WITH {PART} SELECT part, greatest(price / 40, size) AS maximum, least(price / 40, size) AS minimum, price / 40 = size AS "equal", price / 40 < size AS less, price / 40 >= size AS greater_equal,
(size % 2 <> 0) <> (part % 2 <> 0) AS logical_xor, round(atan2(price / 40, size), 6) AS arctan2, round(sqrt(price / 40 * price / 40 + size * size), 6) AS hypot, round(greatest(price / 40, size) + ln(1 + exp(-abs(price / 40 - size))), 6) AS logaddexp,
CASE WHEN price / 40 - size < 0 THEN 0.0 WHEN price / 40 - size > 0 THEN 1.0 ELSE 0.5 END AS heaviside FROM pr""")
def e6_e7_e8_pairs(spark, d):
    pair = B.align(B.binary(price(spark, d), 40, "divide"), size(spark, d))
    a, b = F.col("left"), F.col("right")
    exact = {n: BINARY[n](a, b).alias(n) for n in ("maximum", "minimum", "equal", "less", "greater_equal")}
    rough = {n: F.round(BINARY[n](a, b), 6).alias(n) for n in ("arctan2", "hypot", "logaddexp")}
    return pair.df.select("part", *exact.values(), BINARY["logical_xor"](b % 2, F.col("part") % 2).alias("logical_xor"), *rough.values(), BINARY["heaviside"](a - b, F.lit(0.5)).alias("heaviside"))


@query(f"WITH {QTY} SELECT nation, month, 3 - value * 2 AS value FROM dense")
def e9_scalar_operand(spark, d):
    return B.binary(3, B.binary(qty(spark, d), 2, "multiply"), "subtract").dense().df


@query(f"""WITH {QTY}, n AS (SELECT nation, avg(value) AS mean FROM dense GROUP BY nation)
SELECT nation, month, round(CASE WHEN value > mean THEN value ELSE mean END, 6) AS value FROM dense JOIN n USING (nation)""")
def e10_where(spark, d):
    t = qty(spark, d)
    mean = R.reduce(t, "mean", "month")
    return rounded(B.where(B.binary(t, mean, "greater"), t, mean))


@query(f"WITH {QTY} SELECT nation, month, CASE WHEN value > 2000 THEN 2.0 WHEN value > 500 THEN value ELSE -1.0 END AS value FROM dense")
def e11_select(spark, d):
    t = qty(spark, d)
    return B.select([B.binary(t, 2000, "greater"), B.binary(t, 500, "greater")], [2.0, t], -1.0).dense().df


@query(f"WITH {QTY}, n AS (SELECT nation, avg(value) AS mean FROM dense GROUP BY nation) SELECT nation, month, round(least(greatest(value, 100), mean), 6) AS value FROM dense JOIN n USING (nation)")
def e12_clip(spark, d):
    t = qty(spark, d)
    return rounded(B.clip(t, 100, R.reduce(t, "mean", "month")))


@query(f"WITH {QTY} SELECT nation, month, CASE WHEN month % 12 = 0 THEN -1 ELSE value END AS value FROM dense")
def e13_masked_fill(spark, d):
    """January of every year filled, whether or not a nation sold anything."""
    t = qty(spark, d)
    january = B.mapped(build.arange(spark, t.length("month"), dim="month"), lambda v: v % 12 == 0)
    return B.masked_fill(t, january, -1.0).dense().df


@query(f"WITH {QTY} SELECT row_number() OVER (ORDER BY nation, month) - 1 AS i, value FROM dense WHERE value > 800")
def e14_masked_select(spark, d):
    t = qty(spark, d).dense()
    return B.masked_select(t, B.binary(t, 800, "greater")).df


@query(f'WITH {ACT} SELECT "user", hour FROM act WHERE value <> 0')
def e15_nonzero(spark, d):
    return B.nonzero(act(spark, d))


ACTS = ["relu", "relu6", "gelu", "silu", "sigmoid", "hard_sigmoid", "hard_tanh", "softplus", "softsign", "selu", "elu", "leaky_relu", "hardswish", "mish", "log_sigmoid", "tanhshrink", "softshrink", "hardshrink"]


@query("""SELECT c_custkey, greatest(x, 0) AS relu, least(greatest(x, 0), 6) AS relu6, round(0.5 * x * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715 * x * x * x))), 6) + 0.0 AS gelu, round(x / (1 + exp(-x)), 6) + 0.0 AS silu, round(1 / (1 + exp(-x)), 6) AS sigmoid,
round(least(greatest(x / 6 + 0.5, 0), 1), 6) AS hard_sigmoid, least(greatest(x, -1), 1) AS hard_tanh, round(greatest(x, 0) + ln(1 + exp(-abs(x))), 6) AS softplus, round(x / (1 + abs(x)), 6) AS softsign,
round(1.0507009873554805 * CASE WHEN x > 0 THEN x ELSE 1.6732632423543772 * (exp(x) - 1) END, 6) AS selu, round(CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END, 6) AS elu, round(CASE WHEN x >= 0 THEN x ELSE 0.01 * x END, 6) AS leaky_relu,
round(x * least(greatest(x + 3, 0), 6) / 6, 6) + 0.0 AS hardswish, round(x * tanh(greatest(x, 0) + ln(1 + exp(-abs(x)))), 6) + 0.0 AS mish, round(-(greatest(-x, 0) + ln(1 + exp(-abs(x)))), 6) + 0.0 AS log_sigmoid, round(x - tanh(x), 6) + 0.0 AS tanhshrink,
round(CASE WHEN x > 0.5 THEN x - 0.5 WHEN x < -0.5 THEN x + 0.5 ELSE 0 END, 6) AS softshrink, CASE WHEN abs(x) > 0.5 THEN x ELSE 0 END AS hardshrink FROM (SELECT c_custkey, c_acctbal / 997 AS x FROM customer)""")
def e16_activations(spark, d):
    t = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 997).alias("x"))
    exact = {"relu", "relu6", "hard_tanh", "hardshrink"}
    return t.select("c_custkey", *((UNARY[n](F.col("x")) if n in exact else F.round(UNARY[n](F.col("x")), 6) + 0.0).alias(n) for n in ACTS))


@query(f"WITH {EMB}, m AS (SELECT vec, max(value) AS top FROM emb GROUP BY vec), e AS (SELECT vec, k, exp(value - top) AS e FROM emb JOIN m USING (vec)) SELECT vec, k, round(e / sum(e) OVER (PARTITION BY vec), 8) AS value FROM e")
def e17_softmax(spark, d):
    return rounded(W.softmax(emb(spark, d), "k"), 8)


@query(f"WITH {EMB} SELECT a.vec, a.k, round(a.value / (1 + exp(-b.value)), 8) + 0.0 AS value FROM emb a JOIN emb b ON a.vec = b.vec AND b.k = a.k + 32")
def e18_glu(spark, d):
    return rounded(B.glu(emb(spark, d)), 8)


KEPT = f"WITH {EMB} SELECT count(*) AS cells, true AS exact, true AS share FROM emb"


def dropped(t, out, kept, gone, p: float):
    """Whether every cell is as kept or as gone, and as many are gone as p says, within six standard errors."""
    both = t.df.join(out.df.withColumnRenamed("value", "out"), list(t.dims))
    near = lambda a, b: F.abs(a - b) < 1e-9
    stays, goes = near(F.col("out"), kept(F.col("value"))), near(F.col("out"), gone(F.col("value")))
    n = F.count("*")
    return both.agg(n.alias("cells"), F.bool_and(stays | goes).alias("exact"), (F.abs(F.count_if(goes) / n - p) < 6 * F.sqrt(p * (1 - p) / n)).alias("share"))


@query(KEPT)
def e19_dropout(spark, d):
    t = emb(spark, d)
    return dropped(t, B.dropout(t, 0.25, seed=3), lambda v: v / 0.75, lambda v: v * 0, 0.25)


@query(KEPT)
def e19_alpha_dropout(spark, d):
    """The cells' mean and variance stay where they are 0 and 1: what is dropped takes the activation's lower limit."""
    t, p = emb(spark, d), 0.25
    a = ((1 - p) * (1 + p * B.ALPHA_LIMIT**2)) ** -0.5
    shift = -a * B.ALPHA_LIMIT * p
    return dropped(t, B.alpha_dropout(t, p, seed=3), lambda v: v * a + shift, lambda v: F.lit(B.ALPHA_LIMIT) * a + shift, p)


@query(f"WITH {EMB}, p AS (SELECT vec, k // 8 AS c, k % 8 AS j, value FROM emb) SELECT count(DISTINCT (vec, c)) AS slices, true AS whole, true AS share FROM p")
def e19_feature_alpha_dropout(spark, d):
    """A slice is dropped as a whole or kept as a whole."""
    t = S.unflatten(emb(spark, d), "k", {"c": 8, "j": 8})
    out = B.alpha_dropout(t, 0.25, seed=3, over=["vec", "c"]).df.groupBy("vec", "c").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    gone = F.col("low") == F.col("high")
    n = F.count("*")
    return out.agg(n.alias("slices"), (F.count_if(gone) > 0).alias("whole"), (F.abs(F.count_if(gone) / n - 0.25) < 6 * F.sqrt(0.1875 / n)).alias("share"))


@query("SELECT c_custkey, true AS exact FROM customer")
def e16_gelu_exact(spark, d):
    """The error function's form of gelu, against the derivative of the normal distribution function by differences."""
    x = F.col("c_acctbal") / 2000
    c = table(spark, d, "customer")
    h = 1e-3
    slope = (UNARY["erf"](x + h) - UNARY["erf"](x - h)) / (2 * h)
    density = 2 / F.sqrt(F.lit(3.141592653589793)) * F.exp(-x * x)
    form = 0.5 * x * (1 + UNARY["erf"](x / F.sqrt(F.lit(2.0))))
    return c.select("c_custkey", ((F.abs(slope - density) < 2e-6) & (F.abs(UNARY["gelu_exact"](x) - form) < 1e-12) & (F.abs(UNARY["erf"](x) + UNARY["erf"](-x)) < 1e-15)).alias("exact"))


@query(f"WITH {EMB} SELECT vec, k, round((value - avg(value) OVER w) / sqrt(var_pop(value) OVER w + 1e-5), 6) + 0.0 AS value FROM emb WINDOW w AS (PARTITION BY vec)")
def e20_layer_norm(spark, d):
    return rounded(W.normalise(emb(spark, d), "k"))


@query(f"WITH {EMB} SELECT vec, k, round(value / sqrt(avg(value * value) OVER (PARTITION BY vec, k // 16) + 1e-5), 6) + 0.0 AS value FROM emb")
def e20_rms_norm_of_groups(spark, d):
    t = S.unflatten(emb(spark, d), "k", {"g": 4, "j": 16})
    return rounded(S.flatten(W.normalise(t, "j", kind="rms"), 1, 2, "k"))


@query(f"WITH {PART} SELECT part, trunc(price)::BIGINT AS value FROM pr")
def e21_cast(spark, d):
    return price(spark, d).map(lambda v: v.cast("long")).df


@query(f"WITH {PART} SELECT part, (2 * size + 3) * size - 1 AS value FROM pr")
def e22_polynomial(spark, d):
    return size(spark, d).map(lambda v: polynomial(v, F.array(F.lit(2.0), F.lit(3.0), F.lit(-1.0)))).df


@query(f"""WITH {PART} SELECT part, round((sqrt(price) - 1) / 0.5, 6) AS boxcox, size * (size - 1) / 2 AS comb2, 1 - size * size AS one_minus_square, ((price * 1000000)::BIGINT * 3000) >> 32 AS mulhi,
round_even(price, 1) AS rounded FROM pr""")
def e23_special_maths(spark, d):
    pair = B.align(price(spark, d), size(spark, d)).df
    p, s = F.col("left"), F.col("right")
    return pair.select("part", F.round(BINARY["boxcox"](p, F.lit(0.5)), 6).alias("boxcox"), comb(s, F.lit(2)).alias("comb2"), UNARY["one_minus_square"](s).alias("one_minus_square"), mulhi(F.round(p * 1000000), F.lit(3000)).alias("mulhi"), round_to(p, 1).alias("rounded"))


@query(f"WITH {QTY} SELECT month AS row, nation AS \"column\", value FROM qty")
def e24_rename_axes(spark, d):
    t = S.transpose(qty(spark, d)).rename(month="row", nation="column")
    return t.df


@query("SELECT ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::BIGINT AS month, count(*) AS orders FROM orders GROUP BY ALL")
def c5_time_axis(spark, d):
    return table(spark, d, "orders").groupBy(month_of("o_orderdate").alias("month")).agg(F.count("*").alias("orders"))
