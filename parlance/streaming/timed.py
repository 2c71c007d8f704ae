"""State machines over streams, with deadlines in event time.

A machine has on(event) and end(), as in `fold`, and may have due(), the next time in ms at which something happens without an
event, and on_time(ms), which does that. Spark keeps the machine of each key between micro-batches. Deadlines are timers in
event time: they fire when the watermark has passed them, in order, with their own time, so rows don't depend on how events
fall into batches. A key without events for idle_ms, by the watermark, ends, and its state is dropped.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def memory(x: object) -> tuple:
    """What a machine remembers, with that of the machines in it, as plain values. Functions that it was made with are its maker's."""
    if isinstance(x, dict):
        return "table", {k: memory(v) for k, v in x.items()}
    if hasattr(x, "__dict__") and not callable(x):
        return "machine", {k: memory(v) for k, v in vars(x).items() if not callable(v)}
    return "value", x


def recalled(fresh: object, held: tuple) -> object:
    """A machine as it was, from one newly made."""
    kind, found = held
    if kind == "table":
        return {k: recalled(fresh.get(k) if isinstance(fresh, dict) else None, v) for k, v in found.items()}
    if kind == "machine":
        for k, v in found.items():
            setattr(fresh, k, recalled(getattr(fresh, k, None), v))
        return fresh
    return found


class Timed(StatefulProcessor):
    def __init__(self, order: list[str], time: str, machine: Callable, names: list[str], idle_ms: int) -> None:
        self.order, self.time, self.machine, self.names, self.idle_ms = order, time, machine, names, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "machine binary, last long")

    def restored(self) -> tuple[object, int]:
        m, found = self.machine(), self.held.get()
        if found is not None:
            recalled(m, pickle.loads(found[0]))
        return m, -1 if found is None else found[1]

    def kept(self, m: object, last: int) -> None:
        """Put the machine away, with a timer for what comes first: its deadline, or its end."""
        self.held.update((pickle.dumps(memory(m)), last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = m.due() if hasattr(m, "due") else None
        ends = last + self.idle_ms
        self.handle.registerTimer(int(ends if due is None else min(due, ends)) + 1)  # when no event before it can come

    def rows(self, key: tuple, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *row) for row in found], columns=self.names)

    def passed(self, m: object, now: int) -> list[tuple]:
        """Deadlines before an event: they come first, whether or not the watermark got there."""
        found: list[tuple] = []
        while hasattr(m, "due") and (due := m.due()) is not None and due <= now:
            found += m.on_time(due)
        return found

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        m, last = self.restored()
        found: list[tuple] = []
        for event in pd.concat(list(rows)).sort_values(self.order).to_dict("records"):
            found += self.passed(m, event[self.time]) + m.on(event)
            last = max(last, event[self.time])
        self.kept(m, last)
        yield self.rows(key, found)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        m, last = self.restored()
        now = expiredTimerInfo.getExpiryTimeInMs() - 1
        found = self.passed(m, now)
        if now >= last + self.idle_ms:
            found += m.end()
            self.held.clear()
        else:
            self.kept(m, last)
        yield self.rows(key, found)


def timed(events: DataFrame, keys: list[str], order: list[str], time: str, machine: Callable, schema: str, idle_ms: int, late_ms: int = 0) -> DataFrame:
    """A stream of events (keys, order and time in ms since 1970 among their columns) through a machine a key; schema as in fold.folded.

    Events may come late_ms after others; what comes later still is left out by Spark, as its time is over.
    """
    spark = events.sparkSession
    if spark.conf.get(PROVIDER, None) != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)  # timers need it
    names = [part.split()[0] for part in schema.split(", ")]
    # Spark leaves out what isn't after the watermark, which starts at 0; so events at 0, and those just late_ms late, stay
    marked = events.withColumn("event_time", F.timestamp_millis(F.col(time) + 2)).withWatermark("event_time", f"{late_ms + 1} milliseconds")
    return marked.groupBy(*keys).transformWithStateInPandas(Timed(order, time, machine, names, idle_ms), schema, "append", "eventtime")
