"""Change logs whose edits may come out of order, with typed state, timers and time-to-live.

The state of a key is a value (its version, text and whether it is in sync) and a map of the changes that came too early. A
change waits in the map until the versions before it have come; then the map is emptied in order. So the end of a log does not
depend on how it was cut into batches, nor on their order. A timer gives waiting changes up after a while: the key is then out
of sync until a full text comes. With a time-to-live, the state of keys without changes falls away.

Queries need the RocksDB state store: `use_state_store` sets it for the session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def caught_up(at: int, text: str | None, in_sync: bool, waiting: dict[int, tuple[str, str]]) -> tuple[int, str | None, bool]:
    """Apply what can be applied, taking it out of `waiting`: the next edit, or else the earliest full text."""
    while True:
        if in_sync and waiting.get(at + 1, ("", ""))[0] == "edit":
            at, text = at + 1, (text or "") + (waiting.pop(at + 1)[1] or "")
            continue
        full = min((v for v, (kind, _) in waiting.items() if kind == "full"), default=None)
        if full is None:
            return at, text, in_sync
        at, text, in_sync = full, waiting[full][1], True
        for v in [v for v in waiting if v <= at]:
            del waiting[v]


class ChangeLog(StatefulProcessor):
    def __init__(self, key: str, version: str, kind: str, payload: str, wait: int | None, keep: int | None):
        self.key, self.names, self.wait, self.keep = key, (version, kind, payload), wait, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "version long, text string, in_sync boolean", self.keep)
        self.early = handle.getMapState("early", "version long", "kind string, payload string", self.keep)

    def stored(self) -> tuple[int, str | None, bool]:
        return tuple(self.now.get()) if self.now.exists() else (-1, None, False)

    def told(self, key: tuple, at: int, text: str | None, in_sync: bool, waiting: int) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "version": [at], "text": [text], "in_sync": [in_sync and not waiting], "waiting": [waiting]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, text, in_sync = self.stored()
        before = {v[0]: tuple(x) for v, x in self.early.iterator()} if self.early.exists() else {}
        waiting = dict(before)
        for pdf in rows:
            for v, kind, payload in pdf[list(self.names)].itertuples(index=False):
                if v > at:
                    waiting[int(v)] = (kind, payload)
        at, text, in_sync = caught_up(at, text, in_sync, waiting)
        for v in before.keys() - waiting.keys():
            self.early.removeKey((v,))
        for v in waiting.keys() - before.keys():
            self.early.updateValue((v,), waiting[v])
        self.now.update((at, text, in_sync))
        if self.wait is not None:
            timers = list(self.handle.listTimers())
            if waiting and not timers:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
            elif not waiting:
                for t in timers:
                    self.handle.deleteTimer(t)
        yield self.told(key, at, text, in_sync, len(waiting))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, text, in_sync = self.stored()
        if self.early.exists():
            self.early.clear()
            in_sync = False
            self.now.update((at, text, in_sync))
        yield self.told(key, at, text, in_sync, 0)

    def close(self) -> None:
        pass


def change_log_in_any_order(events: DataFrame, key: str, version: str = "version", kind: str = "kind", payload: str = "payload", wait: int | None = None, keep: int | None = None) -> DataFrame:
    """(key, version, text, in_sync, waiting) after each micro-batch: the text up to the last version without a gap, and how many
    changes wait behind one. `wait` and `keep` are milliseconds until waiting changes are given up, and until the state of a
    key without changes goes; without them neither ends."""
    use_state_store(events.sparkSession)
    kinds = f"`{key}` {events.schema[key].dataType.simpleString()}, version long, text string, in_sync boolean, waiting long"
    processor = ChangeLog(key, version, kind, payload, wait, keep)
    mode = "None" if wait is None and keep is None else "ProcessingTime"
    return events.groupBy(key).transformWithStateInPandas(processor, kinds, "Update", mode)
