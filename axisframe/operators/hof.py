"""Higher-order operators: maps over a batch dim, ordered folds, loops, branches, pipes and user functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as fold
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import durable
from ..tensor import Tensor, fail_unless
from .segments import fits
from .split import stack


def vmap(f: Callable[..., pd.DataFrame], t: Tensor, batch, schema: str) -> DataFrame:
    """f of each batch slice as a pandas table, whole slices in one task each; operators here need no vmap, as a batch
    dim is one more key."""
    b = t.name(batch)
    return t.df.groupBy(b).applyInPandas(lambda key, pdf: f(pdf).assign(**{b: key[0]}), f"`{b}` {t.df.schema[b].dataType.simpleString()}, {schema}")


def scan(df: DataFrame, keys: list[str], order: list[str], value: str, init: Column, step: Callable[[Column, Column], Column], out: str = "carry") -> DataFrame:
    """(keys, carry): an ordered fold for each key by any step. A step may depend on all before it, so a key's history is
    one array in one task; `ema` needs no such array. See scan_all for each step's value."""
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("v_")))).alias("h_"))
    return packed.select(*keys, F.aggregate("h_", init, lambda c, x: step(c, x["v_"])).alias(out))


def scan_all(df: DataFrame, keys: list[str], order: list[str], value: str, init: float, step: Callable[[float, float], float], out: str = "carry") -> DataFrame:
    """df's keys, order and value with the carry after each row; rows of a key stream through one task in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        carry, seen = init, []
        for v in pdf.sort_values(order)[value]:
            carry = step(carry, v)
            seen.append(carry)
        return pdf.sort_values(order)[[*keys, *order, value]].assign(**{out: seen})

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (*keys, *order, value))
    return df.select(*keys, *order, value).groupBy(*keys).applyInPandas(run, f"{fields}, `{out}` double")


def averaged(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float, out: str, reset: str | None = None) -> DataFrame:
    """(keys, out): each key's last exponential average, starting from the first value and anew after a row where `reset`
    holds; rows without a value are passed over.

    Rows are sorted by ranges of keys and order. Within a range the average is folded in order, from nothing and as a map
    of an average before it; the few ranges of a key are then put together. So no task holds a key beyond one range.
    """
    clear = F.coalesce(F.col(reset), F.lit(False)) if reset else F.lit(False)
    used = df.select(*dict.fromkeys([*keys, *order]), F.col(value).cast("double").alias("x_"), clear.alias("clear_"))
    small = bool(keys) and fits(used, keys)
    if small:  # every key fits a task: its rows are one range, in the order of their struct
        rows, part = used.withColumn("at_", F.struct(*order)), F.lit(0)
    else:
        rows, part = durable(used.orderBy(*keys, *order).withColumn("at_", F.monotonically_increasing_id())), F.shiftright("at_", 33)
    steps = F.array_sort(F.collect_list(F.struct("at_", "x_", "clear_")))
    none = F.lit(None).cast("double")
    keep = 1 - alpha

    def step(s: Column, r: Column) -> Column:
        x = r["x_"]
        mixed = F.when(x.isNull(), s["v"]).when(s["v"].isNull(), x).otherwise(s["v"] * keep + x * alpha)
        open_ = ~s["clear"] & ~r["clear_"] & x.isNotNull()
        return F.struct(
            F.when(r["clear_"], none).otherwise(mixed).alias("v"), (s["clear"] | r["clear_"]).alias("clear"),
            F.when(open_, s["fade"] * keep).otherwise(s["fade"]).alias("fade"), F.when(open_, s["gain"] * keep + x * alpha).otherwise(s["gain"]).alias("gain"),
        )

    empty = F.struct(none.alias("v"), F.lit(False).alias("clear"), F.lit(1.0).alias("fade"), F.lit(0.0).alias("gain"))
    parts = rows.groupBy(*keys, part.alias("range_")).agg(F.aggregate(steps, empty, step).alias("s_"))
    join = lambda a, p: F.when(p["s_"]["clear"] | a.isNull(), p["s_"]["v"]).otherwise(a * p["s_"]["fade"] + p["s_"]["gain"])
    whole = F.aggregate(F.array_sort(F.collect_list(F.struct("range_", "s_"))), none, join)
    return parts.groupBy(*keys).agg(whole.alias(out))


def ema(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float, out: str = "ema") -> DataFrame:
    """(keys, ema): the last exponential average for each key, starting from the first value; rows without a value are
    passed over."""
    return averaged(df, keys, order, value, alpha, out)


def while_loop(state: DataFrame, body: Callable[[DataFrame], DataFrame], go_on: Callable[[DataFrame, DataFrame], bool], most: int | None = None) -> DataFrame:
    """body applied until go_on(before, after) says no; every state is a written table, so lost executors cost one round.

    Where `most` rounds are stated and reached, it raises: an unfinished state is no result.
    """
    for _ in count() if most is None else range(most):
        after = durable(body(state))
        fail_unless(after.columns == state.columns, "the state's columns changed")
        if not go_on(state, after):
            return after
        state = after
    raise RuntimeError(f"the loop did not end within {most} rounds")


def fori_loop(low: int, high: int, body: Callable[[int, DataFrame], DataFrame], state: DataFrame) -> DataFrame:
    for i in range(low, high):
        after = durable(body(i, state))
        fail_unless(after.columns == state.columns, "the state's columns changed")
        state = after
    return state


def cond(condition: Column, yes: Column, no: Column) -> Column:
    return F.when(condition, yes).otherwise(no)


def switch(index: Column, *branches: Column) -> Column:
    """The branch numbered by the index, which is clamped to those there are."""
    fail_unless(bool(branches), "no branches")
    out = branches[-1]
    for k in range(len(branches) - 2, -1, -1):
        out = F.when(index <= k, branches[k]).otherwise(out)
    return out


def sequential(t, *steps: Callable):
    """A pipe of operators."""
    return fold(lambda x, f: f(x), steps, t)


def map_stack(f: Callable[[Tensor], Tensor], tensors: list[Tensor]) -> Tensor:
    return stack([f(t) for t in tensors])


def vector_udf(f: Callable[[pd.Series], pd.Series], kind: str = "double"):
    """An elementwise user function on whole Arrow batches."""

    def run(x: pd.Series) -> pd.Series:
        return f(x)

    return F.pandas_udf(run, kind)


def reducer_udf(f: Callable[[pd.Series], float], kind: str = "double"):
    """A user reduction of a group's values."""

    def run(x: pd.Series) -> float:
        return f(x)

    return F.pandas_udf(run, kind)


def fan_out(df: DataFrame, make: type, returns: str, *columns: str) -> DataFrame:
    """df with the rows that a user's table function makes of each row."""
    table = F.udtf(make, returnType=returns)
    return df.lateralJoin(table(*(F.col(c).outer() for c in columns)))
