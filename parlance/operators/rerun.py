"""Re-runs over the whole history: which meetings, what is left, and when to hold back. Driver state, and tables of any size."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rerun:
    """The accounts of one re-run; no number goes below 0."""

    model: str
    version: str
    total: int
    remaining: int
    abandoned: int = 0
    cancelled: bool = False

    @property
    def done(self) -> int:
        return max(self.total - self.remaining - self.abandoned, 0)

    @property
    def running(self) -> bool:
        return not self.cancelled and self.remaining > 0

    def finished(self, n: int = 1) -> Rerun:
        return replace(self, remaining=max(self.remaining - n, 0))

    def given_up(self, n: int = 1) -> Rerun:
        """Meetings that can't be run again: no longer waited for, and not done."""
        return replace(self, remaining=max(self.remaining - n, 0), abandoned=self.abandoned + min(n, self.remaining))

    def deleted(self, n: int = 1) -> Rerun:
        """Meetings that are no more: neither wanted nor done."""
        return replace(self, remaining=max(self.remaining - n, 0), total=max(self.total - n, 0))

    def cancel(self) -> Rerun:
        return replace(self, cancelled=True)


def wanted(stored: tuple[str, str] | None, current: tuple[str, str]) -> bool:
    """Q8: a re-run is due if the model changed; without a stored identity nothing has changed."""
    return stored is not None and stored != current


def may_work(recording: bool, front: bool) -> bool:
    """Q9: work in bulk gives way to a recording; what someone waits for doesn't."""
    return front or not recording


def backlog(fresh: DataFrame, old: DataFrame, present: DataFrame) -> DataFrame:
    """(meeting): the fresh ones, and of the old ones those that are still queued."""
    return fresh.select("meeting").union(old.select("meeting").join(present.select("meeting").distinct(), "meeting", "left_semi")).distinct()


def outran(meetings: DataFrame, reruns: DataFrame, *keys: str) -> DataFrame:
    """The re-runs to take up again: not cancelled, and a meeting with audio was never diarized, or last before the re-run began.

    meetings: keys, audio_path, diarized_at; reruns: keys, started_at, cancelled. Instants are compared, whatever the offsets.
    """
    instant = lambda c: F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    with_audio = meetings.where(F.col("audio_path").isNotNull())
    oldest = with_audio.groupBy(*keys).agg(F.bool_or(F.col("diarized_at").isNull()).alias("never"), F.min(instant("diarized_at")).alias("oldest"))
    found = reruns.where(~F.col("cancelled")).join(oldest, list(keys))
    return found.where(F.col("never") | (F.col("oldest") < instant("started_at"))).select(reruns.columns)


def progress(backlog: DataFrame, waiting: DataFrame, abandoned: DataFrame, *keys: str) -> DataFrame:
    """(keys, total, remaining, abandoned, done) of backlog (keys, meeting): what still waits, what was given up, and what is done, never below 0."""
    mark = lambda df, name: df.select("meeting").distinct().withColumn(name, F.lit(1))
    rows = backlog.join(mark(waiting, "w"), "meeting", "left").join(mark(abandoned, "a"), "meeting", "left")
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count("w").alias("remaining"), F.count_if(F.col("a").isNotNull() & F.col("w").isNull()).alias("abandoned"))
    return sums.withColumn("done", F.greatest(F.lit(0).cast("long"), F.col("total") - F.col("remaining") - F.col("abandoned")))


def rename_preview(speakers: DataFrame, appearances: DataFrame, speaker_id: int, name: str) -> DataFrame:
    """(id, meetings) of the speaker to be renamed and of those who hold the name already, letters' case aside."""
    held = speakers.where((F.col("id") == speaker_id) | (F.lower("display_name") == name.lower())).select("id")
    return appearances.join(held, "id", "left_semi").select("id", "meetings")


def sample_sources(exemplars: DataFrame, most_ms: int = 8_000) -> DataFrame:
    """K2, K6: (speaker_id, id, ms): each speaker's first positive exemplar, and how much of it is played."""
    first = exemplars.where(~F.col("is_negative")).groupBy("speaker_id").agg(F.min_by(F.struct("id", "voiced_ms"), "id").alias("e"))
    return first.select("speaker_id", "e.id", F.least("e.voiced_ms", F.lit(most_ms)).alias("ms"))
