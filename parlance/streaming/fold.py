"""State machines over ordered events, in batch and as a stream with the same results.

A machine has on(event) and end(), which return rows as tuples. One key, such as a meeting's channel, is one machine; its
events must come in order, within a micro-batch in any order. State is the machine itself, kept by Spark between batches.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _rows(key: tuple, found: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame([(*key, *row) for row in found], columns=names)


def folded(events: DataFrame, keys: list[str], order: list[str], machine: Callable, schema: str) -> DataFrame:
    """All events of a key in order, and then the end."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m, found = machine(), []
        for event in rows.sort_values(order).to_dict("records"):
            found += m.on(event)
        return _rows(key, found + m.end(), names)

    return events.groupBy(*keys).applyInPandas(run, schema)


def streamed(events: DataFrame, keys: list[str], order: list[str], machine: Callable, schema: str) -> DataFrame:
    """The same over a stream. A row whose `last` is true, if the events have that column, ends its key."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = machine()
        if state.exists:
            vars(m).update(pickle.loads(state.get[0]))
        rows, found = pd.concat(list(batches)).sort_values(order), []
        for event in rows.to_dict("records"):
            found += m.on(event)
        if "last" in rows and bool(rows["last"].any()):
            found += m.end()
            state.remove()
        else:
            state.update((pickle.dumps(vars(m)),))
        yield _rows(key, found, names)

    return events.groupBy(*keys).applyInPandasWithState(run, schema, "machine binary", "append", GroupStateTimeout.NoTimeout)
