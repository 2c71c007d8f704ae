"""Joins and merges of half-open intervals.

Every join has an equality on the group and on a time bucket: intervals are listed once in each bucket they touch, so a
long meeting is many small keys rather than one large one. BUCKET_MS bounds how many intervals meet in a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_MS = 30_000
#: Turns of one voice on one channel up to this far apart are one turn.
MERGE_GAP_MS = 400


def buckets(start: Column, end: Column, width: int = BUCKET_MS) -> Column:
    """Buckets that [start, end) touches; that of start if it is empty."""
    first = F.floor(start / width).cast("long")
    return F.sequence(first, F.greatest(F.floor((end - 1) / width).cast("long"), first))


def merged(frame: DataFrame, *keys: str, gap_ms: int = MERGE_GAP_MS) -> DataFrame:
    """(keys, start_ms, end_ms): intervals of a key joined where they are at most gap_ms apart, touching included. Empty ones are left out."""
    order = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col("start_ms") > reach + gap_ms), 1).otherwise(0)
    island = F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = frame.where("end_ms > start_ms").select(*keys, "start_ms", "end_ms", begins.alias("begins")).withColumn("island", island)
    return numbered.groupBy(*keys, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


def regions(spans: DataFrame, *keys: str) -> DataFrame:
    """(keys, start_ms, end_ms): what lies between neighbouring bounds of a key's spans."""
    points = spans.select(*keys, F.explode(F.array("start_ms", "end_ms")).alias("start_ms")).distinct()
    after = F.lead("start_ms").over(Window.partitionBy(*keys).orderBy("start_ms"))
    return points.withColumn("end_ms", after).where("end_ms is not null")


def runs(frame: DataFrame, *keys: str, order: str, flag: str) -> DataFrame:
    """(keys, first, last, n): runs of neighbouring numbers in order whose flag is set."""
    place = F.col(order) - F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return frame.where(F.col(flag)).withColumn("run", place).groupBy(*keys, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("run")


def owners_at(points: DataFrame, turns: DataFrame, at: str, keys: tuple[str, ...] = ("meeting", "channel"), name: str = "cluster", width: int = BUCKET_MS) -> DataFrame:
    """points with the cluster of the first turn (by start, end, cluster) that holds the instant; null if none does."""
    listed = turns.select(*[F.col(k).alias(f"t_{k}") for k in keys], F.struct(F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), F.col("cluster").alias("cluster")).alias("turn"), F.explode(buckets(F.col("start_ms"), F.col("end_ms"), width)).alias("t_bucket"))
    bucket = F.floor(points[at] / width).cast("long")
    on = [points[k] == listed[f"t_{k}"] for k in keys] + [bucket == listed["t_bucket"], points[at] >= listed["turn.start"], points[at] < listed["turn.end"]]
    return points.join(listed, on, "left").groupBy(*points.columns).agg(F.min("turn").alias("turn")).select(*points.columns, F.col("turn.cluster").alias(name))


def reconciled(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """segments with the cluster at the midpoint, and whether the owners of both ends differ."""
    middle = F.col("start_ms") + F.expr("(greatest(end_ms, start_ms) - start_ms) div 2")
    rows = segments.select("meeting", "sequence", "channel", "start_ms", "end_ms", middle.alias("middle"), F.greatest(F.col("end_ms") - 1, F.col("start_ms")).alias("last"))
    rows = owners_at(owners_at(owners_at(rows, turns, "middle"), turns, "start_ms", name="first_owner"), turns, "last", name="last_owner")
    return rows.select("meeting", "sequence", "cluster", (~F.col("first_owner").eqNullSafe(F.col("last_owner"))).alias("straddles"))


def touching(frame: DataFrame, others: DataFrame, *keys: str, row: str = "id", width: int = BUCKET_MS) -> DataFrame:
    """The row ids of frame whose interval overlaps one of the others of the same keys."""
    listed = others.where("end_ms > start_ms").select(*keys, F.col("start_ms").alias("o_start"), F.col("end_ms").alias("o_end"), F.explode(buckets(F.col("start_ms"), F.col("end_ms"), width)).alias("bucket"))
    asked = frame.select(row, *keys, "start_ms", "end_ms", F.explode(buckets(F.col("start_ms"), F.col("end_ms"), width)).alias("bucket"))
    same = [asked[k] == listed[k] for k in (*keys, "bucket")]
    return asked.join(listed, [*same, asked["start_ms"] < listed["o_end"], asked["end_ms"] > listed["o_start"]], "left_semi").select(row).distinct()


def clear_of(frame: DataFrame, others: DataFrame, *keys: str, row: str = "id", width: int = BUCKET_MS) -> DataFrame:
    """Rows of frame that overlap none of the others of the same keys."""
    return frame.join(touching(frame, others, *keys, row=row, width=width), row, "left_anti")


def overlap(left: DataFrame, right: DataFrame, key: str = "meeting", width: int = BUCKET_MS) -> DataFrame:
    """(key, left_speaker, right_speaker, ms): the time that speakers of both sides share, each side's own merged."""
    mine = lambda df, side: merged(df, key, "speaker", gap_ms=0).select(key, F.col("speaker").alias(f"{side}_speaker"), F.col("start_ms").alias(f"{side}_start"), F.col("end_ms").alias(f"{side}_end"), F.explode(buckets(F.col("start_ms"), F.col("end_ms"), width)).alias("bucket"))
    a, b = mine(left, "left"), mine(right, "right")
    start = F.greatest("left_start", "right_start")
    # a pair is counted in the bucket where its common part starts
    met = a.join(b, [key, "bucket"]).where((F.col("left_start") < F.col("right_end")) & (F.col("right_start") < F.col("left_end")) & (F.floor(start / width) == F.col("bucket")))
    return met.groupBy(key, "left_speaker", "right_speaker").agg(F.sum(F.least("left_end", "right_end") - start).alias("ms"))


def covered(area: DataFrame, spans: DataFrame, key: str = "meeting", width: int = BUCKET_MS) -> DataFrame:
    """(key, start_ms, end_ms, speaker): who of the spans covers the start of each region."""
    listed = spans.select(key, "speaker", F.col("start_ms").alias("s_start"), F.col("end_ms").alias("s_end"), F.explode(buckets(F.col("start_ms"), F.col("end_ms"), width)).alias("bucket"))
    asked = area.withColumn("bucket", F.floor(F.col("start_ms") / width).cast("long"))
    return asked.join(listed, [key, "bucket"]).where("start_ms >= s_start and start_ms < s_end").select(key, "start_ms", "end_ms", "speaker")


def majority(votes: DataFrame, windows: DataFrame, key: str = "meeting", cell_ms: int = 10) -> DataFrame:
    """(key, voice, start_ms, end_ms): where at least half of the windows over an instant voted for a voice.

    votes: key, window, voice, start_ms, end_ms; windows: key, start_ms, end_ms. Bounds are rounded to cells; a window
    votes once for a voice at an instant. Votes are changes of a running sum, so cost does not depend on length.
    """
    cell = lambda c: F.floor((F.col(c) + cell_ms / 2) / cell_ms).cast("long")
    once = merged(votes.select(key, "window", "voice", cell("start_ms").alias("start_ms"), cell("end_ms").alias("end_ms")), key, "window", "voice", gap_ms=0)
    ends = lambda df, *keep: df.select(*keep, F.explode(F.array(F.struct(F.col("start_ms").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end_ms").alias("at"), F.lit(-1).alias("step")))).alias("e")).select(*keep, "e.at", "e.step")
    held = ends(once, key, "voice").groupBy(key, "voice", "at").agg(F.sum("step").alias("held"))
    over = ends(windows.select(key, cell("start_ms").alias("start_ms"), cell("end_ms").alias("end_ms")), key).groupBy(key, "at").agg(F.sum("step").alias("covers"))
    voices = held.select(key, "voice").distinct()
    steps = held.select(key, "voice", "at", "held", F.lit(0).alias("covers")).unionByName(over.join(voices, key).select(key, "voice", "at", F.lit(0).alias("held"), "covers"))
    steps = steps.groupBy(key, "voice", "at").agg(F.sum("held").alias("held"), F.sum("covers").alias("covers"))
    order = Window.partitionBy(key, "voice").orderBy("at")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select(key, "voice", F.col("at").alias("start_ms"), F.lead("at").over(order).alias("end_ms"), F.sum("held").over(running).alias("held"), F.sum("covers").over(running).alias("covers"))
    won = steps.where("end_ms is not null and held > 0 and 2 * held >= covers")
    return merged(won.select(key, "voice", "start_ms", "end_ms"), key, "voice", gap_ms=0).select(key, "voice", (F.col("start_ms") * cell_ms).alias("start_ms"), (F.col("end_ms") * cell_ms).alias("end_ms"))
