"""Q5 to Q10: the queue and the re-run of a whole history, as commits of `Versions`.

Whatever changes together is one commit: what a meeting's run found and its place in the queue, a re-run's members and its account. A commit is
made from one version and fails if another came between; it is then made anew from that one. So a meeting is never marked as done while it still
waits, nor counted as given up once it is done. All of these take sets of meetings, of any size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.sources.versions import Versions, logged

#: Work that someone waits for goes before work in bulk.
FRONT, BACK = 0, 1
QUEUE = "meeting long, priority int, enqueued_at timestamp, started_at string"
ACCOUNT = "model string, model_version string, total long, abandoned long, cancelled boolean"
MEMBERS, RUNS = "meeting long", "meeting long, model string, model_version string, finished_at timestamp"


@dataclass(frozen=True)
class Account:
    """A re-run's account; nothing goes below 0."""

    model: str
    model_version: str
    total: int
    remaining: int
    abandoned: int
    cancelled: bool

    @property
    def done(self) -> int:
        return max(self.total - self.remaining - self.abandoned, 0)


class Work:
    def __init__(self, tables: Versions) -> None:
        self.tables, self.spark = tables, tables.spark

    def queue(self, at: int | None = None) -> DataFrame:
        return self.tables.current("queue", QUEUE, "meeting", at=at).drop("version")

    def members(self, at: int | None = None) -> DataFrame:
        """Meetings of the re-run that still wait: leaving the queue ends membership, and lining up again doesn't renew it."""
        return self.tables.current("members", MEMBERS, "meeting", at=at).drop("version")

    def runs(self, at: int | None = None) -> DataFrame:
        """The newest run of each meeting."""
        return self.tables.current("runs", RUNS, "meeting", at=at).drop("version")

    def account(self, at: int | None = None) -> Account | None:
        """None if there was no re-run."""
        at = self.tables.latest() if at is None else at
        row = self.tables.table("account", ACCOUNT, at).first()
        return row and Account(row["model"], row["model_version"], row["total"], self.members(at).count(), row["abandoned"], row["cancelled"])

    def accounted(self, model: str, version: str, total: int, abandoned: int = 0, cancelled: bool = False) -> DataFrame:
        return self.spark.createDataFrame([(model, version, total, abandoned, cancelled)], ACCOUNT)

    def enqueue(self, asked: DataFrame, priority: int, now: str) -> int:
        """Q5: put meetings (meeting, started_at) in line. Those in line at the back move up if they are asked for at the front; others keep their place."""

        def change(seen: int) -> dict:
            return {"added": {"queue": logged(self.joining(asked, self.queue(seen), priority, now))}}

        return self.tables.changed(change)

    @staticmethod
    def joining(asked: DataFrame, queue: DataFrame, priority: int, now: str) -> DataFrame:
        ahead = queue.where(F.col("priority") <= priority).select("meeting")
        fresh = asked.select("meeting", "started_at").join(ahead, "meeting", "left_anti")
        return fresh.select("meeting", F.lit(priority).alias("priority"), F.lit(now).cast("timestamp").alias("enqueued_at"), "started_at")

    def next(self, n: int, recording: bool = False) -> DataFrame:
        """Q6, Q9: the next meetings, left in line. While a recording runs, only those that someone waits for."""
        rows = self.queue().where(F.col("priority") == FRONT) if recording else self.queue()
        return rows.orderBy("priority", "enqueued_at", "started_at", "meeting").limit(n)

    def finish(self, found: DataFrame, now: str) -> int:
        """Q6: meetings (meeting, model, model_version) are done: their runs and their leaving of the queue are one commit."""
        runs = found.select("meeting", "model", "model_version", F.lit(now).cast("timestamp").alias("finished_at"))
        return self.tables.changed(lambda seen: {"added": {"runs": logged(runs), **self.leaving(found)}})

    def leaving(self, meetings: DataFrame) -> dict[str, DataFrame]:
        """What is added when meetings leave the queue."""
        gone = meetings.select("meeting").distinct()
        return {"queue": logged(gone.unionByName(self.spark.createDataFrame([], QUEUE), allowMissingColumns=True), gone=True), "members": logged(gone, gone=True)}

    def delete(self, meetings: DataFrame) -> int:
        """Meetings that are no more leave the queue, and count neither as done nor as given up if they were waiting."""

        def change(seen: int) -> dict:
            account, waiting = self.account(seen), self.members(seen).join(meetings.select("meeting").distinct(), "meeting", "left_semi").count()
            out = {"added": self.leaving(meetings)}
            return out if account is None else out | {"replaced": {"account": self.accounted(account.model, account.model_version, account.total - waiting, account.abandoned, account.cancelled)}}

        return self.tables.changed(change)

    def give_up(self, meetings: DataFrame) -> int:
        """Q7: meetings that can't be run leave the queue; members among them are counted as abandoned in the same commit."""

        def change(seen: int) -> dict:
            account, mine = self.account(seen), self.members(seen).join(meetings.select("meeting").distinct(), "meeting", "left_semi").count()
            out = {"added": self.leaving(meetings)}
            return out if account is None else out | {"replaced": {"account": self.accounted(account.model, account.model_version, account.total, account.abandoned + mine, account.cancelled)}}

        return self.tables.changed(change)

    def begin(self, model: str, version: str, meetings: DataFrame, now: str) -> int:
        """Q7: a re-run of all meetings (meeting, started_at, audio_path) with audio, oldest first.

        What an earlier re-run still owns at the back lines up anew; what is at the front keeps its place; what others have put in line isn't the re-run's.
        """

        def change(seen: int) -> dict:
            owned, queue = self.members(seen), self.queue(seen)
            asked = meetings.where(F.col("audio_path").isNotNull())
            own_back = owned.join(queue.where(F.col("priority") == BACK).select("meeting"), "meeting", "left_semi")
            left = queue.join(own_back, "meeting", "left_anti")
            new = self.joining(asked.join(left.select("meeting"), "meeting", "left_anti"), left, BACK, now)
            mine = new.select("meeting").union(asked.select("meeting").join(owned, "meeting", "left_semi")).distinct()
            gone = own_back.join(new.select("meeting"), "meeting", "left_anti")
            return {"added": {"queue": logged(new).unionByName(self.leaving(gone)["queue"])}, "replaced": {"members": logged(mine), "account": self.accounted(model, version, mine.count())}}

        return self.tables.changed(change)

    def begin_if_changed(self, model: str, version: str, meetings: DataFrame, now: str) -> int | None:
        """Q8: begin if the last re-run was for another model. Without one, this model is only noted."""
        account = self.account()
        if account is None:
            self.tables.changed(lambda seen: {"replaced": {"account": self.accounted(model, version, 0)}})
            return None
        return None if (account.model, account.model_version) == (model, version) else self.begin(model, version, meetings, now)

    def cancel(self) -> int:
        """Q7: members at the back leave the queue and count as abandoned. Without a re-run nothing changes. Answers how many left."""
        account = self.account()
        if account is None or (account.total == 0 and account.abandoned == 0 and not account.cancelled):
            return 0
        dropped = 0

        def change(seen: int) -> dict:
            nonlocal dropped
            now, back = self.account(seen), self.members(seen).join(self.queue(seen).where(F.col("priority") == BACK).select("meeting"), "meeting", "left_semi")
            dropped = back.count()
            return {"added": self.leaving(back), "replaced": {"account": self.accounted(now.model, now.model_version, now.total, now.abandoned + dropped, True)}}

        self.tables.changed(change)
        return dropped

    def work_off(self, run, n: int, now: str, recording=lambda: False) -> int:
        """Q9, Q10: run batches of n until the line is empty, or a recording stands in the way; answers how many were done.

        run(batch) returns the rows for finish, or None if it stood down midway: then the batch stays in line, and is what a later
        call, or one after a crash, begins with.
        """
        done = 0
        while True:
            batch = self.next(n, recording())
            batch = self.spark.createDataFrame(batch.collect(), batch.schema)  # n rows
            size = batch.count()
            found = run(batch) if size else None
            if found is None:
                return done
            self.finish(found, now)
            done += size


#: What the notes of an interrupted meeting say.
RECOVERED = "interrupted: the Core stopped without ending this Meeting. Its audio survives up to the moment it stopped, minus at most the final frame; any transcript still in flight was lost."
LOST = "interrupted: the Core stopped without ending this Meeting, and no audio reached disk before it did."


def reconciled(meetings: DataFrame, orphans: DataFrame, end) -> DataFrame:
    """Q10: meetings (id, started_at, ended_at, touched_at, audio_path, audio_notes: array) as they are after a restart.

    orphans: (id, path, audio_seconds) of audio that reached the disk. The newest open meeting is closed: it gets the audio that is there, a note, and
    an end by the rule end(started_at, touched_at, audio_seconds).
    """
    newest = meetings.where("ended_at IS NULL").agg(F.max_by("id", F.struct("started_at", "id")).alias("open"))
    rows = meetings.join(F.broadcast(newest), F.col("id") == F.col("open"), "left").join(orphans.select("id", "path", "audio_seconds"), "id", "left")
    hit, found = F.col("open").isNotNull(), F.col("path").isNotNull()
    ended = F.when(hit, end(F.col("started_at"), F.col("touched_at"), F.col("audio_seconds"))).otherwise(F.col("ended_at"))
    notes = F.when(hit, F.array_append(F.coalesce("audio_notes", F.array().cast("array<string>")), F.when(found, RECOVERED).otherwise(LOST))).otherwise(F.col("audio_notes"))
    return rows.withColumn("ended_at", ended).withColumn("audio_notes", notes).withColumn("audio_path", F.when(hit, F.coalesce("path", "audio_path")).otherwise(F.col("audio_path"))).select(*meetings.columns)
