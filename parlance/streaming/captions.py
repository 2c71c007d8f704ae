"""Live captions: one subscriber's bounded queue, the rolling context of decoding, and subscribing without a gap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Subscriber:
    """A queue of a fixed length. Captions that don't fit are dropped and counted; the next that does brings one notice.

    Events have at_ms and kind, `caption` or `read` (one caption taken off). Rows: at_ms, what, n.
    """

    def __init__(self, room: int = 3):
        self.room, self.waiting, self.dropped = room, 0, 0

    def on(self, event: dict) -> list[tuple]:
        if event["kind"] == "read":
            self.waiting = max(self.waiting - 1, 0)
            return []
        if self.waiting >= self.room:
            self.dropped += 1
            return []
        notice = [(event["at_ms"], "missed", self.dropped)] if self.dropped else []
        self.waiting, self.dropped = self.waiting + 1, 0
        return [*notice, (event["at_ms"], "caption", 1)]

    def end(self) -> list[tuple]:
        return []


class Context:
    """The last words of a channel as context of the next decode, dropped when the language changes.

    Events have at_ms, text and language. Rows: at_ms, context, again (whether to decode once more without context).
    """

    def __init__(self, words: int = 30):
        self.words, self.held, self.language = words, [], None

    def on(self, event: dict) -> list[tuple]:
        switched = self.language is not None and event["language"] != self.language
        row = (event["at_ms"], "" if switched else " ".join(self.held), switched)
        self.held = ([] if switched else self.held) + (event["text"] or "").split()
        self.held, self.language = self.held[-self.words :], event["language"]
        return [row]

    def end(self) -> list[tuple]:
        return []


def subscribed(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """What a table holds now, and a stream of all its files. A consumer keeps rows by key, so none is missed or shown twice."""
    return spark.read.schema(schema).parquet(path), spark.readStream.schema(schema).parquet(path)


#: How long a burst of changes is gathered, and after how long the record is looked at even without one.
DEBOUNCE, FALLBACK_SECONDS = "250 milliseconds", 5


def rebuilt_on_change(changes: DataFrame, rebuild: Callable[[DataFrame], None], checkpoint: str, most: int = 64, dirty: Callable[[], DataFrame] | None = None, fallback: int = FALLBACK_SECONDS):
    """Q4: a stream of changed meetings, gathered every 250 ms and rebuilt `most` at once, ids in order.

    With dirty, what it returns (meeting) is due as well whenever there was a change, and every `fallback` seconds without one; so a
    change that nobody told of, or whose rebuilding failed, is made up for.
    """

    def each(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        due = batch.select("meeting").where("meeting IS NOT NULL").distinct()
        if dirty is not None:
            due = due.union(dirty().select("meeting")).distinct()
        done = due.limit(0)
        while not (part := due.join(done, "meeting", "left_anti").orderBy("meeting").limit(most)).isEmpty():
            part = part.sparkSession.createDataFrame(part.collect(), due.schema)  # at most `most` ids
            rebuild(part)
            done = done.union(part)

    changes = changes.select("meeting")
    if dirty is not None:
        seconds = changes.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load().where(F.col("value") % fallback == fallback - 1)
        changes = changes.union(seconds.select(F.lit(None).cast(changes.schema["meeting"].dataType).alias("meeting")))
    return changes.writeStream.foreachBatch(each).trigger(processingTime=DEBOUNCE).option("checkpointLocation", checkpoint)
