"""A calendar that is looked at again and again, as a stream.

The source is the clock of the polls: its offsets are their times, so a stream that is started again goes on with the poll after its last. A reading is
what the calendar's entries, a table, show at that time: those that end no longer than the lookback before it. What a reading changes against what
was announced is told by `streaming.machines.CalendarReadings`.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from parlance.streaming import machines, timed

#: A poll each so many ms, and how far back a reading reaches.
POLL_MS, LOOKBACK_MS = 30_000, 12 * 60 * 60 * 1000


class Ticks(InputPartition):
    def __init__(self, start: int, stop: int, step: int) -> None:
        self.start, self.stop, self.step = start, stop, step


class Clock(DataSourceStreamReader):
    """Times of polls; an offset is the time up to which they have been given out."""

    def __init__(self, options: dict) -> None:
        self.step = int(options.get("poll_ms", POLL_MS))
        self.first = int(options.get("from_ms", 0))
        self.until = options.get("until_ms")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at_ms": self.first}

    def latestOffset(self) -> dict:  # noqa: N802
        now = int(time.time() * 1000) if self.until is None else int(self.until)
        return {"at_ms": self.first + max(now - self.first + self.step, 0) // self.step * self.step}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Ticks(start["at_ms"], end["at_ms"], self.step)]

    def read(self, partition: Ticks) -> Iterator[tuple]:
        for at in range(partition.start, partition.stop, partition.step):
            yield (at,)

    def commit(self, end: dict) -> None:
        pass


class Polls(DataSource):
    """Format `polls` with options poll_ms, from_ms, and until_ms for a replay; without that it follows the clock of the machine."""

    @classmethod
    def name(cls) -> str:
        return "polls"

    def schema(self) -> str:
        return "at_ms long"

    def streamReader(self, schema: object) -> Clock:  # noqa: N802
        return Clock(self.options)


def polls(spark: SparkSession, **options: int) -> DataFrame:
    """A stream of the times at which to look."""
    spark.dataSource.register(Polls)
    return spark.readStream.format("polls").options(**{k: str(v) for k, v in options.items()}).load()


READING = ("id", "title", "attendees", "starts_ms", "ends_ms", "all_day", "declined")


def readings(ticks: DataFrame, entries: DataFrame, lookback_ms: int = LOOKBACK_MS) -> DataFrame:
    """(calendar, at_ms, readings): what each calendar of entries (calendar and READING) shows at each time of ticks.

    A calendar's entries are one row, so that a poll of it is one row too. Every calendar is looked at at every time, which is what polling is.
    """
    shelves = entries.groupBy("calendar").agg(F.collect_list(F.struct(*READING)).alias("entries"))
    seen = ticks.crossJoin(shelves)
    return seen.select("calendar", "at_ms", F.filter("entries", lambda e: (e["starts_ms"] <= F.col("at_ms")) & (e["ends_ms"] > F.col("at_ms") - lookback_ms)).alias("readings"))


CHANGES = "calendar long, at_ms long, kind string, event_id string, title string, scheduled_end_ms long"


def changes(ticks: DataFrame, entries: DataFrame, idle_ms: int = LOOKBACK_MS) -> DataFrame:
    """A stream of CHANGES: meetings that start or end between one poll and the next."""
    return timed.timed(readings(ticks, entries), ["calendar"], ["at_ms"], "at_ms", machines.CalendarReadings, CHANGES, idle_ms)
