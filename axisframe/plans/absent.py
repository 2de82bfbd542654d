"""Queries on tensors with holes: clicks and views by user and hour of day, most of whose cells have no event. Absent cells
are zeros and count in every result; the SQL works on the dense tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.catalogue import BINARY
from ..operators import broadcast as B
from ..operators import contract as C
from ..operators import losses as L
from ..operators import reduce as R
from ..operators import reshape as S
from ..operators import window as W
from ..sources import build
from ..tensor import Tensor
from .common import query, rounded, table


def kind(spark, d, event: str) -> Tensor:
    """The number of events of a kind by user and hour of day; cells without one have no row."""
    events = table(spark, d, "events")
    users = events.agg(F.max("user_id")).first()[0] + 1
    return build.tensor_from_table(events.filter(F.col("event_type") == event), {"user": F.col("user_id"), "hour": F.hour("ts").cast("long")}, F.lit(1.0), sizes={"user": users, "hour": 24})


def both(spark, d) -> tuple[Tensor, Tensor]:
    return kind(spark, d, "click"), kind(spark, d, "view")


CELLS = """u AS (SELECT unnest(range(max(user_id) + 1)) AS "user" FROM events), h AS (SELECT unnest(range(24)) AS hour),
x AS (SELECT u."user", h.hour, count(*) FILTER (event_type = 'click')::DOUBLE AS a, count(*) FILTER (event_type = 'view')::DOUBLE AS b
      FROM u CROSS JOIN h LEFT JOIN events e ON e.user_id = u."user" AND hour(e.ts) = h.hour GROUP BY ALL)"""


def named_totals(parts: dict[str, Tensor], axis: str, digits: int = 5) -> DataFrame:
    """(what is left of the dims, name, value): the totals of several tensors along a dim."""
    out = None
    for name, t in parts.items():
        one = rounded(R.reduce(t, "sum", axis).dense(), digits).withColumn("value", F.col("value").cast("double")).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def totals_sql(forms: dict[str, str], keys: str) -> str:
    """Rows (keys, name, value) of the sums of SQL expressions in a and b."""
    return f"WITH {CELLS} " + " UNION ALL ".join(f"SELECT {keys}, '{n}' AS name, round(sum({e}), 5) + 0.0 AS value FROM x GROUP BY ALL" for n, e in forms.items())


MATHS = {
    "exp": "exp(a)", "exp2": "pow(2, a)", "expm1": "exp(a) - 1", "log1p": "ln(1 + a)", "rsqrt": "CASE WHEN a = 0 THEN 'inf'::DOUBLE ELSE 1 / sqrt(a) END", "cos": "cos(a)", "cosh": "cosh(a)", "arcsinh": "asinh(a)",
    "one_minus_square": "1 - a * a", "logical_not": "CASE WHEN a = 0 THEN 1.0 ELSE 0.0 END",
}


@query(totals_sql(MATHS, "hour"))
def e1_e2_absent_maths(spark, d):
    a = kind(spark, d, "click")
    return named_totals({n: B.elementwise(a, n) for n in MATHS}, "user")


ACTIVATIONS = {"sigmoid": "1 / (1 + exp(-a))", "softplus": "a + ln(1 + exp(-a))", "hard_sigmoid": "least(greatest(a / 6 + 0.5, 0), 1)", "log_sigmoid": "-ln(1 + exp(-a))", "threshold": "CASE WHEN a > 1 THEN a ELSE -2 END"}


@query(totals_sql(ACTIVATIONS, "hour"))
def e16_absent_activations(spark, d):
    a = kind(spark, d, "click")
    options = {"threshold": {"at": 1.0, "value": -2.0}}
    return named_totals({n: B.elementwise(a, n, **options.get(n, {})) for n in ACTIVATIONS}, "user")


PAIRS = {
    "equal": "(a = b)::INT", "not_equal": "(a <> b)::INT", "less_equal": "(a <= b)::INT", "greater": "(a > b)::INT", "logical_or": "(a <> 0 OR b <> 0)::INT", "logical_xor": "((a <> 0) <> (b <> 0))::INT",
    "add": "a + b", "subtract": "a - b", "multiply": "a * b", "power": "pow(a, b)", "maximum": "greatest(a, b)", "hypot": "sqrt(a * a + b * b)", "logaddexp": "greatest(a, b) + ln(1 + exp(-abs(a - b)))", "heaviside": "CASE WHEN a > 0 THEN 1 ELSE b END",
}


@query(totals_sql(PAIRS, '"user"'))
def e5_e6_e7_e8_absent_pairs(spark, d):
    a, b = both(spark, d)
    return named_totals({n: B.binary(a, b, n) for n in PAIRS}, "hour")


@query(f'WITH {CELLS}, m AS (SELECT hour, avg(b) AS m FROM x GROUP BY hour) SELECT "user", hour, round(a - m, 8) + 0.0 AS value FROM x JOIN m USING (hour)')
def e5_absent_broadcast(spark, d):
    """Clicks less the mean views of the hour: values stretch over absent cells."""
    a, b = both(spark, d)
    return rounded(B.binary(a, R.reduce(b, "mean", "user"), "subtract").dense(), 8)


@query(f'WITH {CELLS} SELECT "user", hour, 3 - 2 * a AS value FROM x')
def e9_absent_scalar(spark, d):
    return B.binary(3, B.binary(kind(spark, d, "click"), 2, "multiply"), "subtract").dense().df


@query(f'WITH {CELLS} SELECT "user", hour, CASE WHEN a = b THEN a + 1 ELSE b * 0.5 END AS value FROM x')
def e10_absent_where(spark, d):
    a, b = both(spark, d)
    return B.where(B.binary(a, b, "equal"), B.binary(a, 1, "add"), B.binary(b, 0.5, "multiply")).dense().df


@query(f'WITH {CELLS} SELECT "user", hour, CASE WHEN a > b THEN a WHEN b = 0 THEN 7 ELSE -1 END AS value FROM x')
def e11_absent_select(spark, d):
    a, b = both(spark, d)
    return B.select([B.binary(a, b, "greater"), B.binary(b, 0, "equal")], [a, 7.0], -1.0).dense().df


@query(f'WITH {CELLS}, m AS (SELECT "user", 2 + avg(b) AS m FROM x GROUP BY "user") SELECT "user", hour, round(least(greatest(a, 0.5), m), 8) AS value FROM x JOIN m USING ("user")')
def e12_absent_clip(spark, d):
    a, b = both(spark, d)
    return rounded(B.clip(a, 0.5, B.binary(R.reduce(b, "mean", "hour"), 2, "add")).dense(), 8)


@query(f'WITH {CELLS} SELECT "user", hour, CASE WHEN b > 0 THEN -1 ELSE a END AS value FROM x')
def e13_absent_masked_fill(spark, d):
    a, b = both(spark, d)
    return B.masked_fill(a, B.binary(b, 0, "greater"), -1.0).dense().df


@query(f'WITH {CELLS} SELECT row_number() OVER (ORDER BY "user", hour) - 1 AS i, a AS value FROM x WHERE b = 0')
def e14_absent_masked_select(spark, d):
    a, b = both(spark, d)
    return B.masked_select(a, B.binary(b, 0, "equal")).df


@query(f'WITH {CELLS} SELECT l."user", l.hour, round(l.a / (1 + exp(-r.a)), 8) AS value FROM x l JOIN x r ON r."user" = l."user" AND r.hour = l.hour + 12')
def e18_absent_glu(spark, d):
    return rounded(B.glu(kind(spark, d, "click"), "hour").dense(), 8)


@query(f"""WITH {CELLS}, w AS (SELECT "user", max(a) FILTER (hour = 0) AS a0, max(a) FILTER (hour = 1) AS a1, max(a) FILTER (hour = 2) AS a2, max(b) FILTER (hour = 0) AS b0, max(b) FILTER (hour = 1) AS b1, max(b) FILTER (hour = 2) AS b2 FROM x WHERE hour < 3 GROUP BY "user")
SELECT "user", j::BIGINT AS hour, CASE j WHEN 0 THEN a1 * b2 - a2 * b1 WHEN 1 THEN a2 * b0 - a0 * b2 ELSE a0 * b1 - a1 * b0 END + 0.0 AS value FROM w, range(3) r(j)""")
def j8_absent_cross(spark, d):
    a, b = (t.with_df(t.df.filter("hour < 3"), sizes=(t.size("user"), 3)) for t in both(spark, d))
    return rounded(C.cross(a, b, "hour").dense())


@query(f'WITH {CELLS} SELECT "user", o::BIGINT AS o, sum(a * ((hour + o) % 3)) + any_value(10 * (o + 1)) AS value FROM x, range(2) r(o) GROUP BY ALL')
def j9_absent_linear(spark, d):
    weight = build.array_literal(spark, [[(h + o) % 3 for h in range(24)] for o in range(2)], ["o", "hour"])
    return C.linear(kind(spark, d, "click"), weight, build.array_literal(spark, [10, 20], ["o"])).dense().df


@query(f'WITH {CELLS} SELECT "user", round(CASE WHEN sum(a * a) * sum(b * b) = 0 THEN 0 ELSE sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) END, 8) AS value FROM x GROUP BY "user"')
def j11_absent_cosine(spark, d):
    return rounded(C.cosine_similarity(*both(spark, d), "hour").dense(), 8)


@query(f"""WITH {CELLS}, w AS (SELECT sqrt(count(*)) AS w FROM u), s AS (SELECT q.hour AS q, k.hour AS k, sum(q.a * k.b) / any_value(w) AS s FROM x q JOIN x k USING ("user"), w GROUP BY ALL),
p AS (SELECT q, k, exp(s - max(s) OVER (PARTITION BY q)) AS e FROM s), z AS (SELECT q, k, e / sum(e) OVER (PARTITION BY q) AS p FROM p)
SELECT q AS hour, x."user", round(sum(p * x.b), 7) AS value FROM z JOIN x ON x.hour = z.k GROUP BY ALL""")
def j12_absent_attention(spark, d):
    """Hours of clicks attend to hours of views, by the users they share."""
    a, b = (S.transpose(t, ["hour", "user"]) for t in both(spark, d))
    out = C.attention(a, b, b).dense()
    return out.df.select("hour", F.col(out.dims[-1]).alias("user"), F.round("value", 7).alias("value"))


@query(f"WITH {CELLS}, e AS (SELECT a - b AS e FROM x) SELECT round(avg(e * e), 8) AS mse, round(avg(abs(e)), 8) AS l1, round(avg(CASE WHEN abs(e) < 1 THEN 0.5 * e * e ELSE abs(e) - 0.5 END), 8) AS smooth_l1, round(avg(CASE WHEN abs(e) <= 2 THEN 0.5 * e * e ELSE 2 * (abs(e) - 1) END), 8) AS huber FROM e")
def m1_absent_losses(spark, d):
    a, b = both(spark, d)
    out = None
    for name, options in (("mse", {}), ("l1", {}), ("smooth_l1", {}), ("huber", {"delta": 2.0})):
        one = L.loss(name, a, b, **options).df.select(F.round("value", 8).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


@query(f'WITH {CELLS} SELECT "user", round(sum(a + ln(1 + exp(-a)) - a * (b > 0)::INT), 7) AS value FROM x GROUP BY "user"')
def m2_absent_bce(spark, d):
    """Do clicks foretell whether there are views? Loss by user."""
    a, b = both(spark, d)
    seen = B.mapped(b, lambda v: (v > 0).cast("double"))
    return rounded(R.reduce(L.loss("bce_with_logits", a, seen, "none"), "sum", "hour").dense(), 7)


@query(f'WITH {CELLS}, m AS (SELECT "user", ln(sum(exp(a))) AS z FROM x GROUP BY "user"), t AS (SELECT "user", sum(b * (z - a)) AS l FROM x JOIN m USING ("user") GROUP BY "user") SELECT round(avg(l), 7) AS value FROM t')
def m3_absent_cross_entropy(spark, d):
    """Clicks as scores of hours, views as the weights of the true ones."""
    return rounded(L.cross_entropy(*both(spark, d)), 7)


@query(f'WITH {CELLS}, f AS (SELECT "user", arg_max(hour, (b, -hour)) AS at FROM x GROUP BY "user"), m AS (SELECT "user", ln(sum(exp(a))) AS z FROM x GROUP BY "user") SELECT round(avg(z - a), 7) AS value FROM x JOIN f ON f."user" = x."user" AND f.at = x.hour JOIN m ON m."user" = x."user"')
def m3_absent_classes(spark, d):
    """Clicks as scores of hours; the true class is the hour with the most views, and 0 without a row."""
    a, b = both(spark, d)
    at = R.arg(b, "max", "hour")
    return rounded(L.cross_entropy(a, replace(at, df=at.df.filter("value > 0"), fill=0)), 7)


@query(f"""WITH {CELLS} SELECT x."user", o::BIGINT AS c, x.hour, round(sum(y.a * ((y.hour - x.hour) * 2 + 1 + o)) + any_value(5 * (o + 1)), 6) + 0.0 AS value
FROM x JOIN x y ON y."user" = x."user" AND y.hour BETWEEN x.hour - 1 AND x.hour + 1, range(2) r(o) GROUP BY ALL""")
def w9_absent_convolution(spark, d):
    kernel = build.array_literal(spark, [[[-1, 1, 3]], [[0, 2, 4]]], ["o", "c", "j"])
    x = S.expand_dims(kind(spark, d, "click"), 1, "c")
    return rounded(W.convolve(x, kernel, padding=1, bias=build.array_literal(spark, [5, 10], ["o"])).dense())


@query(f'WITH {CELLS} SELECT "user", hour, CASE WHEN a > 0 AND b = 0 THEN a ELSE a * b END AS value FROM x WHERE "user" % 2 = 0')
def e7_absent_half(spark, d):
    """Tensors whose absent cells are missing (only even users) against ones whose absent cells count."""
    a, b = both(spark, d)
    a = a.dense()
    even = a.with_df(a.df.filter("user % 2 = 0"), fill=None)
    lone = B.binary(B.binary(even, 0, "greater"), B.binary(b, 0, "equal"), expression=BINARY["logical_and"])
    return B.where(lone, even, B.binary(even, b, "multiply")).df
