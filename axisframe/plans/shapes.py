"""Queries on shape transforms, slicing, joining and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import broadcast as B
from ..operators import index as I
from ..operators import reduce as R
from ..operators import reshape as S
from ..operators import split as P
from ..operators import window as W
from ..sources import build
from ..tensor import Tensor
from .common import ACT, DAILY, EMB, QTY, act, daily, emb, plain, price, qty, query, rounded, size, table


def by_month(spark, d) -> Tensor:
    return R.reduce(qty(spark, d), "sum", "nation").dense()


MONTH = f"WITH {QTY}, m AS (SELECT month, sum(value) AS value FROM dense GROUP BY month), n AS (SELECT count(*) AS n FROM m)"
FULL = f"WITH {QTY}, n AS (SELECT count(*) AS n FROM months)"


@query(f"{MONTH} SELECT nation, month, value FROM nations CROSS JOIN m")
def b2_broadcast_to(spark, d):
    t = by_month(spark, d)
    return B.broadcast_to(t, {"nation": 25, "month": -1}).df


@query(f"{MONTH}, k AS (SELECT nation, sum(value) AS v FROM dense GROUP BY nation) SELECT nation, month, v - value AS value FROM m CROSS JOIN k")
def b3_broadcast_arrays(spark, d):
    a = R.reduce(qty(spark, d), "sum", "month").dense()
    x, y = B.broadcast_arrays(Tensor(a.df, a.dims, a.sizes, None), by_month(spark, d))
    return B.binary(x, y, "subtract", outer=False).df.select("nation", "month", "value")


@query(f"{MONTH} SELECT 0::BIGINT AS d0, month, 0::BIGINT AS d2, value FROM m")
def b4_atleast_3d(spark, d):
    return S.atleast(by_month(spark, d), 3).df


@query(f"WITH {DAILY}, t AS (SELECT max(day) AS last FROM daily), g AS (SELECT unnest(range((last // 7 + 1) * 7)) AS day FROM t) SELECT day // 7 AS week, day % 7 AS weekday, coalesce(value, 0) AS value FROM g LEFT JOIN daily USING (day)")
def b5_reshape_weeks(spark, d):
    t = daily(spark, d)
    n = -(-t.length("day") // 7) * 7
    return S.reshape(t.with_sizes(day=n), {"week": -1, "weekday": 7}).dense().df


@query(f"{MONTH} SELECT i // 40 AS a, i % 40 AS b, value FROM range(200) r(i), n JOIN m ON i % n = month")
def b6_resize(spark, d):
    return S.resize(by_month(spark, d), {"a": 5, "b": 40}).df


@query(f"{FULL} SELECT nation * n + month AS flat, value FROM dense, n")
def b7_flatten(spark, d):
    return S.flatten(qty(spark, d).dense()).df


@query(f"WITH {EMB} SELECT vec, k // 8 AS a, k % 8 AS b, value FROM emb")
def b7_unflatten(spark, d):
    return S.unflatten(emb(spark, d), "k", {"a": 8, "b": -1}).df


@query(f"WITH {QTY} SELECT month, nation, value FROM qty")
def b8_transpose(spark, d):
    return S.transpose(qty(spark, d)).df


@query(f"WITH {EMB} SELECT k % 8 AS b, vec, k // 8 AS a, value FROM emb")
def b9_moveaxis(spark, d):
    return S.moveaxis(S.unflatten(emb(spark, d), "k", {"a": 8, "b": 8}), "b", 0).df


@query(f"{MONTH} SELECT 0::BIGINT AS extra, month, value FROM m")
def b10_expand_dims(spark, d):
    t = S.expand_dims(by_month(spark, d), 0, "extra")
    return S.expand_dims(S.squeeze(t), 0, "extra").df


@query(f"{FULL} SELECT nation, n - 1 - month AS month, value FROM dense, n")
def b11_flip(spark, d):
    return S.flip(qty(spark, d).dense(), "month").df


@query(f"{FULL} SELECT nation, (month + 5) % n AS month, value FROM dense, n")
def b11_roll(spark, d):
    return S.roll(qty(spark, d).dense(), 5, "month").df


@query(f"{FULL} SELECT n - 1 - month AS nation, nation AS month, value FROM dense, n")
def b11_rot90(spark, d):
    return S.rot90(qty(spark, d).dense()).df


@query(f"""{FULL}, g AS (SELECT i AS nation, j AS month FROM n, range(25) a(i), range(-2, n + 3) b(j))
SELECT g.nation, g.month + 2 AS month, value FROM g, n JOIN dense x ON x.nation = g.nation AND x.month = CASE WHEN g.month < 0 THEN -g.month WHEN g.month >= n THEN 2 * n - 2 - g.month ELSE g.month END""")
def b12_pad_reflect(spark, d):
    return S.pad(qty(spark, d), {"month": (2, 3)}, "reflect").df


@query(f"{FULL} SELECT nation, month * 2 + 1 AS month, value FROM qty WHERE value <> 0")
def b12_pad_interior(spark, d):
    return S.pad(qty(spark, d), {"month": (1, 0)}, interior={"month": 1}).df.filter("value <> 0")


@query(f"{MONTH} SELECT CASE WHEN month >= 6 THEN month + 6 ELSE month END AS month, value FROM m UNION ALL SELECT month + 6, -value FROM m WHERE month < 6")
def b13_insert(spark, d):
    t = by_month(spark, d)
    new = I.slice_dim(t, "month", 0, 6).map(lambda v: -v)
    return S.insert(t, 6, new, "month").df


@query(f"{MONTH} SELECT row_number() OVER (ORDER BY month) - 1 AS month, value FROM m, n WHERE month NOT IN (0, 3, n - 1)")
def b13_delete(spark, d):
    return S.delete(by_month(spark, d), [0, 3, -1], "month").df


@query(f"{MONTH} SELECT month + n * r AS month, value FROM m, n, range(3) x(r)")
def b14_tile(spark, d):
    return S.tile(by_month(spark, d), {"month": 3}).df


@query(f"{MONTH} SELECT month * 2 + r AS month, value FROM m, range(2) x(r)")
def b15_repeat(spark, d):
    return S.repeat(by_month(spark, d), 2, "month").df


@query(f"WITH {EMB} SELECT vec * 4 + k // 16 AS vec_g, k % 16 AS j, value FROM emb")
def b16_rearrange(spark, d):
    t = emb(spark, d)
    return S.rearrange(t, "vec (g j) -> (vec g) j", g=4).df


@query(f"WITH {EMB} SELECT k // 16 AS g, round(avg(value), 9) AS value FROM emb GROUP BY ALL")
def b17_einops_reduce(spark, d):
    return rounded(S.einops_reduce(emb(spark, d), "vec (g j) -> g", "mean", g=4), 9)


@query(f"{MONTH} SELECT month, c, value FROM m, range(3) x(c)")
def b18_einops_repeat(spark, d):
    return S.einops_repeat(by_month(spark, d), "month -> month c", c=3).df


@query(f"WITH {EMB}, x AS (SELECT vec, k // 4 AS c, (k // 2) % 2 AS h, k % 2 AS w, value FROM emb) SELECT vec, c // 4 AS c, h * 2 + (c % 4) // 2 AS h, w * 2 + c % 2 AS w, value FROM x")
def b19_pixel_shuffle(spark, d):
    return S.pixel_shuffle(S.unflatten(emb(spark, d), "k", {"c": 16, "h": 2, "w": 2}), 2).df


@query(f"{MONTH} SELECT i AS month, value FROM n, range(100) x(i) JOIN m ON month = (i * n) // 100")
def b20_interpolate(spark, d):
    return S.interpolate(by_month(spark, d), {"month": 100}).df


@query(f"{MONTH} SELECT (month - 2) // 3 AS month, value FROM m WHERE month >= 2 AND (month - 2) % 3 = 0")
def k2_slice(spark, d):
    return I.slice_dim(by_month(spark, d), "month", 2, None, 3).df


@query(f"{MONTH} SELECT month - (n - 4) AS month, value FROM m, n WHERE month >= n - 4")
def k3_open_slice(spark, d):
    return I.slice_dim(by_month(spark, d), "month", -4).df


@query(f"{FULL} SELECT 0::BIGINT AS new, month, value FROM dense WHERE nation = 24")
def k4_integer_index(spark, d):
    return I.getitem(qty(spark, d).dense(), -1, None).df.select("new", "month", "value")


@query(f"{FULL} SELECT CASE nation WHEN 7 THEN 0 WHEN 2 THEN 1 ELSE 2 END::BIGINT AS nation, month, value FROM dense WHERE nation IN (7, 2, 24)")
def k5_list_index(spark, d):
    return I.getitem(qty(spark, d).dense(), [7, 2, -1]).df


@query(f"{FULL} SELECT nation - 5 AS nation, month - 3 AS month, value FROM dense WHERE nation BETWEEN 5 AND 9 AND month BETWEEN 3 AND 8")
def k6_narrow_and_dynamic_slice(spark, d):
    return I.dynamic_slice(I.narrow(qty(spark, d).dense(), "nation", 5, 5), {"month": 3}, {"month": 6}).df


@query(f"{MONTH}, o AS (SELECT row_number() OVER (ORDER BY value DESC, month) - 1 AS month, value, month AS \"at\" FROM m) SELECT month, value, \"at\" FROM o WHERE month < 10")
def k1_top_k_months(spark, d):
    values, at = W.top_k(by_month(spark, d), 10)
    return values.df.join(at.df.withColumnRenamed("value", "at"), "month")


@query(f"WITH {ACT}, r AS (SELECT \"user\", hour, value, row_number() OVER (PARTITION BY \"user\" ORDER BY value DESC, hour) AS r FROM (SELECT u.\"user\", h.hour, coalesce(value, 0) AS value FROM (SELECT unnest(range(max(\"user\") + 1)) AS \"user\" FROM act) u CROSS JOIN (SELECT unnest(range(24)) AS hour) h LEFT JOIN act USING (\"user\", hour))) SELECT \"user\", r - 1 AS hour, value FROM r WHERE r <= 3")
def k1_top_hours_of_users(spark, d):
    return W.top_k(act(spark, d), 3, "hour")[0].df


@query(f"{FULL} SELECT nation, month, value FROM dense UNION ALL SELECT nation + 25, month, -value FROM dense")
def u1_concatenate(spark, d):
    t = qty(spark, d).dense()
    return P.concatenate([t, t.map(lambda v: -v)], "nation").df


@query(f"{FULL} SELECT nation, 0::BIGINT AS stack, month, value FROM dense UNION ALL SELECT nation, 1, month, value * 2 FROM dense")
def u2_stack(spark, d):
    t = qty(spark, d).dense()
    return P.stack([t, t.map(lambda v: v * 2)], 1).df


@query(f"{MONTH} SELECT 0::BIGINT AS d0, month, value FROM m UNION ALL SELECT 1, month, value / 2 FROM m")
def u3_vstack(spark, d):
    t = by_month(spark, d)
    return P.vstack([t, t.map(lambda v: v / 2)]).df


@query(f"{FULL} SELECT nation AS packed, month, value FROM dense UNION ALL SELECT 25 + nation // 5 * 5 + nation % 5, month, value FROM dense")
def u4_einops_pack(spark, d):
    t = qty(spark, d).dense()
    packed, _ = P.pack([t, S.unflatten(t, "nation", {"p": 5, "q": 5})], ["month"])
    return packed.df


@query(f"{MONTH}, e AS (SELECT month, value, n // 3 AS s, n % 3 AS r FROM m, n) SELECT CASE WHEN month < r * (s + 1) THEN month // (s + 1) ELSE r + (month - r * (s + 1)) // s END AS piece, CASE WHEN month < r * (s + 1) THEN month % (s + 1) ELSE (month - r * (s + 1)) % s END AS month, value FROM e")
def u5_array_split(spark, d):
    return P.pieces(by_month(spark, d), 3, "month").df


@query(f"{MONTH} SELECT month - 12 AS month, value FROM m WHERE month >= 12 AND month < 24")
def u6_split_sizes(spark, d):
    return P.split_sizes(by_month(spark, d), 12, "month")[1].df


@query(f"{FULL} SELECT month, value FROM dense WHERE nation = 3")
def u6_unbind(spark, d):
    return P.unbind(qty(spark, d).dense(), "nation")[3].df


@query("""WITH c AS (SELECT conv_id AS conv, turn, max(length(text)) AS value FROM conversations GROUP BY ALL), t AS (SELECT max(turn) AS last FROM c)
SELECT k.conv, g.turn, coalesce(c.value, 0)::DOUBLE AS value FROM (SELECT DISTINCT conv FROM c) k CROSS JOIN (SELECT unnest(range(last + 1)) AS turn FROM t) g LEFT JOIN c ON c.conv = k.conv AND c.turn = g.turn""")
def u7_pad_conversations(spark, d):
    t = build.tensor_from_table(table(spark, d, "conversations"), {"conv": F.col("conv_id"), "turn": F.col("turn")}, F.length("text"), "max", fill=None)
    return plain(P.pad_sequence(t, "turn"))


@query(f"{FULL} SELECT nation, month, value FROM qty WHERE nation % 2 = 0 AND month % 3 <> 0")
def u8_cell_algebra(spark, d):
    t = qty(spark, d)
    even = t.with_df(t.df.filter(F.col("nation") % 2 == 0))
    third = t.with_df(t.df.filter(F.col("month") % 3 == 0))
    return P.cell_difference(t.with_df(P.cell_intersection(t, even)), third)


@query("""WITH pr AS (SELECT p_partkey AS part, max(p_retailprice) AS price, max(p_size)::DOUBLE AS size FROM part GROUP BY ALL)
SELECT part, round(price, 2) AS value FROM pr WHERE price > size * 30""")
def e14_compress_by_other_table(spark, d):
    p, s = price(spark, d), size(spark, d)
    mask = B.binary(p, B.binary(s, 30, "multiply"), "greater", outer=False)
    pair = B.align(p, mask)
    return pair.df.filter("right").select("part", F.round("left", 2).alias("value"))
