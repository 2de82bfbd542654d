"""Queries whose groups may hold most of the rows: scans over ranges, wide windows, stored sketches, large draws."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import segments as G
from ..operators import sketches as K
from ..operators import window as W
from ..sources import build
from ..sources.scratch import scratch_folder
from .common import ACT, DAILY, act, daily, query, rounded, table

EVENT_ORDER = ["ts", "event_id"]


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id), 4) + 0.0 AS total FROM events")
def w1_running_total_of_few_groups(spark, d):
    """Five groups hold all events; each is spread over the ranges."""
    return G.running_total(table(spark, d, "events"), ["event_type"], EVENT_ORDER, "value", "total", small=False).select("event_id", (F.round("total", 4) + 0.0).alias("total"))


@query("SELECT event_id, round(sqrt(sum(value * value) OVER (PARTITION BY event_type ORDER BY ts, event_id)), 6) AS length FROM events")
def w2_scan_of_the_user(spark, d):
    """The length of the vector of all values so far, by an operation that the user gives."""
    rows = table(spark, d, "events").select("event_id", "event_type", "ts", F.abs("value").alias("length"))
    out = G.associative_scan(rows, ["event_type"], EVENT_ORDER, ["length"], lambda a, b: [np.hypot(a[0], b[0])])
    return out.select("event_id", F.round("length", 6).alias("length"))


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS rows FROM events")
def w3_places_in_few_groups(spark, d):
    return G.placed(table(spark, d, "events"), ["event_type"], ["value", "event_id"], small=False).select("event_id", F.col("r_").alias("place"), F.col("n_").alias("rows"))


FULL_DAYS = f"WITH {DAILY}, t AS (SELECT max(day) AS last FROM daily), g AS (SELECT unnest(range(last + 1)) AS day FROM t), x AS (SELECT day, coalesce(value, 0) AS v, last + 1 AS n FROM g LEFT JOIN daily USING (day), t)"


@query(f"{FULL_DAYS} SELECT day, max(v) OVER w AS most, round(avg(v) OVER w, 6) AS mean FROM x WINDOW w AS (ORDER BY day ROWS BETWEEN CURRENT ROW AND 364 FOLLOWING) QUALIFY day <= n - 365")
def w4_windows_of_a_year(spark, d):
    t = daily(spark, d)
    most, mean = (W.reduce_window(t, {"day": 365}, {"day": 1}, "VALID", how) for how in ("max", "mean"))
    return most.df.withColumnRenamed("value", "most").join(rounded(mean).withColumnRenamed("value", "mean"), "day")


@query(f"{FULL_DAYS} SELECT o::BIGINT AS day, sum(v) AS value FROM range(100000) r(o), x WHERE o * 30 < n AND day BETWEEN o * 30 - 45 AND o * 30 + 44 AND o * 30 + 44 < n + 45 GROUP BY o")
def w5_padded_windows(spark, d):
    """Sums over 90 days around every thirtieth day."""
    return W.reduce_window(daily(spark, d), {"day": 90}, {"day": 30}, {"day": (45, 44)}, "sum").df


@query("SELECT event_type, count(value) AS n, min(value) AS least, max(value) AS most, true AS near, true AS counted FROM events GROUP BY event_type")
def a8_a17_sketches(spark, d):
    """Sketches by kind, user and hour, stored in two batches, rolled up to kinds, against exact ranks and counts."""
    events = table(spark, d, "events")
    dims = {"event_type": "event_type", "user": F.col("user_id"), "hour": F.hour("ts")}
    path = f"{scratch_folder(spark, 'sketches')}/cells"
    for half in (0, 1):
        K.add_to_store(path, K.sketched(events.filter(F.col("event_id") % 2 == half), dims, "value", F.col("user_id")))
    shares = [0.05, 0.5, 0.95]
    kinds = K.distinct_items(K.quantiles(K.rolled_up(spark.read.parquet(path), ["event_type"]), shares))
    below = [F.sum((F.col("value") < F.col("q")[i]).cast("double")) / F.count("value") for i in range(3)]
    upto = [F.sum((F.col("value") <= F.col("q")[i]).cast("double")) / F.count("value") for i in range(3)]
    error = 3 * K.rank_error() + 0.001
    near = [(lo <= s + error) & (hi >= s - error) for lo, hi, s in zip(below, upto, shares, strict=True)]
    exact = events.join(kinds, "event_type").groupBy("event_type", "n", "least", "most", "distinct_items")
    users = F.count_distinct("user_id")
    told = exact.agg((near[0] & near[1] & near[2]).alias("near"), (F.abs(F.col("distinct_items") - users) <= F.greatest(0.07 * users, F.lit(2))).alias("counted"))
    return told.select("event_type", "n", "least", "most", "near", "counted")


@query(f"WITH {ACT} SELECT \"user\", 1000000000000::DOUBLE AS draws, true AS near FROM act GROUP BY \"user\"")
def s14_very_many_draws(spark, d):
    """10 ** 12 draws for each user over hours, by the user's events: totals, and every count within seven standard errors."""
    n = 10**12
    t = act(spark, d)
    drawn = build.sample_multinomial(t, n, seed=3).df.withColumnRenamed("value", "drawn")
    share = F.col("value") / F.sum("value").over(Window.partitionBy("user"))
    both = t.df.withColumn("p", share).join(drawn, ["user", "hour"], "full")
    far = F.abs(F.coalesce("drawn", F.lit(0.0)) - n * F.col("p")) > 7 * F.sqrt(n * F.col("p") * (1 - F.col("p"))) + 1
    return both.groupBy("user").agg(F.sum("drawn").alias("draws"), (~F.bool_or(F.coalesce(far, F.lit(True)))).alias("near"))
