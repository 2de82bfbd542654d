"""Keyed lookups: as of a time, in the innermost interval, over agreeing paths, along a hierarchy, in connected groups."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import durable, forget
from ..tensor import fail_unless
from .segments import fits

ROWS = 1 << 21  # edges of a task that makes them distinct


def asof_lookup(probes: DataFrame, bindings: DataFrame, keys: list[str], at: str, value: str, since: str | None = None, out: str | None = None) -> DataFrame:
    """probes with the last value bound at or before each one's time: a union and a running last, no range join.

    Bindings at the same time: the larger value. A null time or key finds nothing. All rows are sorted by ranges of keys
    and times, the running last is taken within each range, and a range takes what it lacks from those before, so a key
    with any share of the rows is spread over many tasks.
    """
    since, out = since or at, out or value
    ready = bindings.groupBy(*keys, F.col(since).alias("t_")).agg(F.max(value).alias("b_"))
    side = ready.select(*keys, "t_", F.lit(0).alias("side_"), F.struct("b_").alias("b_"), F.lit(None).cast(probes.select(F.struct("*").alias("p")).schema["p"].dataType).alias("p_"))
    asked = probes.select(*keys, F.col(at).alias("t_"), F.lit(1).alias("side_"), F.lit(None).cast(side.schema["b_"].dataType).alias("b_"), F.struct(*probes.columns).alias("p_"))
    complete = F.col("t_").isNotNull()
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    if keys and fits(bindings.select(*keys).unionByName(probes.select(*keys)), keys):  # every key fits a task: one window
        whole = Window.partitionBy(*keys).orderBy("t_", "side_").rowsBetween(Window.unboundedPreceding, 0)
        found = side.unionByName(asked).withColumn("found_", F.last("b_", ignorenulls=True).over(whole)).filter("side_ = 1")
        return found.select("p_.*", F.when(complete, F.col("found_")["b_"]).alias(out))
    rows = durable(side.unionByName(asked).orderBy(*keys, "t_", "side_").withColumn("row_", F.monotonically_increasing_id())).withColumn("range_", F.shiftright("row_", 33))
    w = Window.partitionBy("range_", *keys).orderBy("row_").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("found_", F.last("b_", ignorenulls=True).over(w))
    ends = rows.groupBy("range_").agg(F.max_by(F.struct(*keys), "row_").alias("k_"))  # a row for each range: its last key
    of_key = rows.groupBy("range_", *keys).agg(F.max_by("b_", F.when(F.col("b_").isNotNull(), F.col("row_"))).alias("l_"))
    last = of_key.join(F.broadcast(ends), "range_").filter(F.struct(*keys) == F.col("k_")).select("range_", "k_", "l_")
    before = Window.partitionBy("k_").orderBy("range_").rowsBetween(Window.unboundedPreceding, 0)
    carried = last.withColumn("l_", F.last("l_", ignorenulls=True).over(before)).withColumn("until_", F.lead("range_").over(Window.orderBy("range_")))
    carried = F.broadcast(carried.select(F.col("until_").alias("to_"), F.col("k_").alias("of_"), F.col("l_").alias("carried_")))  # what the next range starts with
    both = run.filter("side_ = 1").join(carried, (F.col("range_") == F.col("to_")) & (F.struct(*keys) == F.col("of_")), "left")
    return both.select("p_.*", F.when(complete, F.coalesce("found_", "carried_")["b_"]).alias(out))


def innermost_interval(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, row: list[str], width: float = 1, id_: str = "scope_id") -> DataFrame:
    """points with the narrowest half-open interval [start, end) of their key that holds them: the later start, then the
    smaller id on ties; null where none does.

    Positions fall into cells of `width`. An interval is cut into aligned blocks of 1, 4, 16, … cells that it covers
    whole, at most six a level, and each block keeps its narrowest interval alone; a point then asks for one block of
    each level. So the work is intervals and points times levels, however much intervals overlap. Cells that an interval
    covers in part, its two ends where these are no multiples of the width, are compared one by one. `row` names the
    columns that tell points apart.
    """
    fail_unless(width > 0, "width is not positive")
    good = intervals.filter("start < end").select(*keys, "start", "end", F.struct((F.col("end") - F.col("start")).alias("w"), (-F.col("start")).alias("s"), F.col(id_).alias("i")).alias("best_"))
    cell = lambda x: F.floor(x / F.lit(width)).cast("long")
    first, last = F.ceil(F.col("start") / F.lit(width)).cast("long"), cell(F.col("end"))
    good = good.withColumns({"a_": first, "b_": last})
    longest = good.agg(F.max(F.col("b_") - F.col("a_")).alias("n")).first()["n"] or 1
    levels = 1 + max(0, ceil(log(max(longest, 1), 4)))
    none = F.array().cast("array<struct<level:int,block:bigint>>")

    def run(low: Column, high: Column, level: int) -> Column:
        """Blocks low to high - 1 of a level."""
        return F.when(low < high, F.transform(F.sequence(low, high - 1), lambda x: F.struct(F.lit(level).alias("level"), x.alias("block")))).otherwise(none)

    parts = []
    for k in range(levels):
        size, wider = 4**k, 4 ** (k + 1)
        low, high = F.ceil(F.col("a_") / F.lit(size)).cast("long"), F.floor(F.col("b_") / F.lit(size)).cast("long")
        if k == levels - 1:
            parts.append(run(low, high, k))
        else:
            middle = F.least(high, 4 * F.ceil(F.col("a_") / F.lit(wider)).cast("long"))
            parts += [run(low, middle, k), run(F.greatest(middle, 4 * F.floor(F.col("b_") / F.lit(wider)).cast("long")), high, k)]
    placed = good.withColumn("o_", F.explode(F.concat(*parts))).select(*keys, F.col("o_.level").alias("level_"), F.col("o_.block").alias("block_"), "best_")
    narrowest = placed.groupBy(*keys, "level_", "block_").agg(F.min("best_").alias("best_"))
    place = F.array(*(F.struct(F.lit(k).alias("level"), F.floor(cell(F.col("at_")) / F.lit(4**k)).cast("long").alias("block")) for k in range(levels)))
    asked = points.select(*row, *(c for c in keys if c not in row), F.col(at).alias("at_"))
    whole = asked.withColumn("o_", F.explode(place)).select("*", F.col("o_.level").alias("level_"), F.col("o_.block").alias("block_")).join(narrowest, [*keys, "level_", "block_"]).select(*row, "best_")
    ends = F.array_distinct(F.filter(F.array(F.when(first * width != F.col("start"), cell(F.col("start"))), F.when(last * width != F.col("end"), last)), lambda x: x.isNotNull()))
    cut = good.withColumn("cell_", F.explode(ends)).select(*keys, "cell_", "start", "end", "best_")
    partly = asked.withColumn("cell_", cell(F.col("at_"))).join(cut, [*keys, "cell_"]).filter("start <= at_ AND at_ < end").select(*row, "best_")
    best = whole.unionByName(partly).groupBy(*row).agg(F.min("best_").alias("best_"))
    return points.join(best, row, "left").withColumn(id_, F.col("best_.i")).drop("best_")


def reconcile_paths(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A key's value where all rows agree on it, else null; a row without a value agrees with nothing."""
    agree = (F.min(value) == F.max(value)) & (F.count(value) == F.count("*"))
    return values.groupBy(*keys).agg(F.when(agree, F.min(value)).alias(value))


def references(sites: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """All sites of the wanted symbols."""
    return sites.join(wanted.select(*on).distinct(), on, "left_semi")


def refused(sites: DataFrame, renames: DataFrame, scope: str, name: str, new: str) -> DataFrame:
    """(scope, name, new) of the renames that cannot be done together.

    All are done at once, so a name may go to one that is itself renamed away, and two names may change places. Refused are names
    that go to the same new one, and those whose new name stays in use; what a refused rename keeps in use may refuse others,
    round by round, until nothing changes. Where a name has several new ones, the first counts.
    """
    used = durable(sites.select(scope, name).distinct(), "names")
    asked = renames.groupBy(scope, name).agg(F.min(new).alias(new)).filter(F.col(new) != F.col(name)).join(used, [scope, name], "left_semi")
    asked = durable(asked, "renames")
    twins = asked.groupBy(scope, new).count().filter("count > 1").select(scope, new)
    live, out = durable(asked.join(twins, [scope, new], "left_anti").select(scope, name, new), "live"), asked.join(twins, [scope, new], "left_semi").select(scope, name, new)
    while True:
        staying = used.join(live.select(scope, name), [scope, name], "left_anti").withColumnRenamed(name, new)
        bad = durable(live.join(staying, [scope, new], "left_semi").select(scope, name, new), "refused")
        if bad.isEmpty():
            return out
        out = out.unionByName(bad)
        left = durable(live.join(bad.select(scope, name), [scope, name], "left_anti").select(scope, name, new), "live")
        forget(live)
        live = left


def rename_clashes(sites: DataFrame, renames: DataFrame, scope: str = "scope_id", name: str = "name", new: str = "new_name") -> DataFrame:
    """The renames that cannot be done together with the others; see `refused`."""
    bad = refused(sites, renames, scope, name, new)
    return renames.join(bad, [scope, name, new], "left_semi")


def rename(sites: DataFrame, renames: DataFrame, scope: str = "scope_id", name: str = "name", new: str = "new_name") -> DataFrame:
    """sites with new names, all at once; renames that would clash are left out, and the first new name counts where one has several."""
    bad = refused(sites, renames, scope, name, new)
    one = renames.groupBy(scope, name).agg(F.min(new).alias("new_")).join(bad.select(scope, name), [scope, name], "left_anti")
    return sites.join(one, [scope, name], "left").withColumn(name, F.coalesce("new_", name)).select(*sites.columns)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by the keys in so many tasks that each has about ROWS rows, however many there are."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS)), *keys)


def connected_groups(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, group): the smallest node that edges reach. Labels spread to neighbours and jump to their label's label,
    so long chains take few rounds; every round is a written table, and rounds end when no label changes.

    Edges need not be distinct: they are made so in tasks cut by their number, so that what a task holds does not grow with them.
    Jumps are looked up for distinct labels, few where a group is large.
    """
    given = durable(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).dropna())
    all_ = given.unionByName(given.select(F.col("other").alias("node"), F.col("node").alias("other")))
    both = durable(spread(all_, 2 * given.count(), "node", "other").distinct())
    forget(given)
    labels = durable(spread(both, both.count(), "node").groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("group")))
    written = labels
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("group").alias("g_")), "other").groupBy("node").agg(F.min("g_").alias("g_"))
        met = labels.join(near, "node").select("node", F.least("group", "g_").alias("new_"), "group")
        jump = labels.select(F.col("node").alias("new_"), F.col("group").alias("far_"))
        jump = labels.select(F.col("group").alias("new_")).distinct().join(jump, "new_").filter("far_ < new_")
        after = durable(met.join(jump, "new_", "left").select("node", F.least("new_", F.coalesce("far_", "new_")).alias("new_"), "group"))
        forget(written)
        written, labels = after, after.select("node", F.col("new_").alias("group"))
        if after.filter(F.col("new_") != F.col("group")).isEmpty():
            forget(both)
            return labels


def method_resolution(parents: DataFrame, values: DataFrame, node: str = "node", parent: str = "parent", value: str = "value") -> DataFrame:
    """(node, value, depth): each node's own value or that of its nearest ancestor, however far; smaller values on ties.

    Values go down one step a round to nodes that have none yet, so each node is settled once, cycles end, and the work
    is one pass over the edges of the nodes settled last. Nodes without a value above them give no row.
    """
    down = durable(parents.select(F.col(parent).alias("up_"), F.col(node).alias("n_")).dropna().distinct())
    last = durable(values.select(F.col(node).alias("n_"), F.col(value).alias("v_")).filter("n_ IS NOT NULL").groupBy("n_").agg(F.min("v_").alias("v_"), F.lit(0).alias("d_")))
    settled, rounds = last, [last]
    while not last.isEmpty():
        heirs = last.select(F.col("n_").alias("up_"), "v_", "d_").join(down, "up_").groupBy("n_").agg(F.min("v_").alias("v_"), (F.first("d_") + 1).alias("d_"))
        last = durable(heirs.join(settled.select("n_"), "n_", "left_anti").select("n_", "v_", "d_"))
        rounds.append(last)
        settled = settled.unionByName(last)
        if len(rounds) > 16:  # many small tables become one
            settled = durable(settled)
            forget(*rounds[:-1])
            rounds = [settled, last]
    forget(down)
    return settled.select(F.col("n_").alias(node), F.col("v_").alias(value), F.col("d_").alias("depth"))
