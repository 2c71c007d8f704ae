"""How well voiceprints know people again in other meetings of their series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import vectors as V

#: Floors and margins of the acceptance grid.
FLOORS, MARGINS = (0.45, 0.50, 0.55, 0.60, 0.62), (0.0, 0.05, 0.08, 0.10)


def scored(prints: DataFrame) -> DataFrame:
    """(series, meeting, person, candidate, score) of prints (series, meeting, person, vector), one a person and meeting.

    A probe, one print, is compared with every person of its series: the mean of that person's prints in all other meetings. Means leave
    a meeting out by taking its print off the person's sum, so a series costs its prints times its people, not its pairs of prints. A
    person with no other meeting isn't there, and a probe whose own person isn't there is no returning person: it has no rows.
    """
    unit = prints.select("series", "meeting", "person", V.normalised(F.col("vector")).alias("vector"))
    parts = unit.select("series", "person", F.posexplode("vector").alias("at", "x")).groupBy("series", "person", "at").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    sums = parts.groupBy("series", "person").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda i: i["x"]).alias("total"), F.max("n").alias("n"))
    meetings = unit.select("series", "meeting").distinct()
    own = unit.withColumnRenamed("vector", "own")
    others = meetings.join(sums, "series").join(own, ["series", "meeting", "person"], "left").where((F.col("own").isNull()) | (F.col("n") > 1))
    rest = F.when(F.col("own").isNull(), F.col("total")).otherwise(F.zip_with("total", "own", lambda t, x: t - x))
    gallery = others.select("series", "meeting", F.col("person").alias("candidate"), V.normalised(rest).alias("mean"))
    known = gallery.select("series", "meeting", F.col("candidate").alias("person"))
    probes = unit.join(known, ["series", "meeting", "person"], "left_semi")
    score = F.aggregate(F.zip_with("vector", "mean", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return probes.join(gallery, ["series", "meeting"]).select("series", "meeting", "person", "candidate", score.alias("score"))


def probes(scores: DataFrame) -> DataFrame:
    """(series, meeting, person, correct, others): each probe's score with its own person, and its best with another, -1 without one."""
    own = F.col("candidate") == F.col("person")
    best = scores.groupBy("series", "meeting", "person").agg(F.max(F.when(own, F.col("score"))).alias("correct"), F.max(F.when(~own, F.col("score"))).alias("others"))
    return best.withColumn("others", F.coalesce("others", F.lit(-1.0)))


def grid(scores: DataFrame, floors: tuple[float, ...] = FLOORS, margins: tuple[float, ...] = MARGINS) -> DataFrame:
    """(floor, margin, recognized, false_above): the share of returning people that each setting accepts, and of other people's scores over its floor.

    Both counts are made in one pass each, for all settings at once.
    """
    found, other = probes(scores), scores.where("candidate <> person")
    settings = [(f, m) for f in floors for m in margins]
    accepts = [F.avg(((F.col("correct") >= f) & (F.col("correct") - F.col("others") >= m)).cast("double")).alias(f"g{i}") for i, (f, m) in enumerate(settings)]
    above = [F.avg((F.col("score") >= f).cast("double")).alias(f"h{i}") for i, f in enumerate(floors)]
    both = found.agg(*accepts).crossJoin(other.agg(*above))  # one row each
    rows = [F.struct(F.lit(f).alias("floor"), F.lit(m).alias("margin"), F.col(f"g{i}").alias("recognized"), F.col(f"h{floors.index(f)}").alias("false_above")) for i, (f, m) in enumerate(settings)]
    return both.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
