"""From windows of segmentation to a meeting's turns, and the replay of a history in order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators import intervals, matching, upkeep

#: Which of three local speakers each class of the segmentation means.
POWERSET = ((), (0,), (1,), (2,), (0, 1), (0, 2), (1, 2))


def speakers_of(scores: Column) -> Column:
    """Local speakers of the class with the largest score, the last of equals; none for classes beyond the table."""
    best = F.size(scores) - F.array_position(F.reverse(scores), F.array_max(scores)).cast("int") + 1
    table = F.array(*[F.array(*[F.lit(i) for i in s]).cast("array<int>") for s in POWERSET])
    return F.coalesce(F.get(table, best - 1), F.array().cast("array<int>"))


def votes_of(observations: DataFrame) -> DataFrame:
    """(meeting, channel, window, voice, start_ms, end_ms) of observations whose runs are arrays of [start, end]."""
    return observations.select("meeting", "channel", "window", "voice", F.explode("runs").alias("r")).select("meeting", "channel", "window", "voice", F.col("r")[0].alias("start_ms"), F.col("r")[1].alias("end_ms"))


def assembled(observations: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, voices) of observations (meeting, channel, window, id, voice, runs, vector) and windows (meeting, channel, start_ms, end_ms).

    Turns are where half of the windows agree, silent ones included, joined over short gaps. A voice's vector is the mean
    of its observations by voiced time; an observation without a vector keeps its turns and lends none.
    """
    key = F.concat_ws("|", F.col("meeting").cast("string"), "channel")
    agreed = intervals.majority(votes_of(observations).withColumn("k", key), windows.withColumn("k", key), key="k")
    part = F.split("k", r"\|")
    turns = agreed.select(part[0].cast("long").alias("meeting"), part[1].alias("channel"), F.col("voice").alias("cluster"), "start_ms", "end_ms")
    turns = intervals.merged(turns, "meeting", "channel", "cluster")
    voiced = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r[1] - r[0])
    lending = observations.where("vector is not null").select("meeting", F.col("voice").alias("cluster"), "id", "vector", voiced.alias("voiced_ms"), F.lit(False).alias("is_negative"))
    time = turns.groupBy("meeting", "cluster").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("voiced_ms"))
    return turns, matching.means(lending, "meeting", "cluster").join(time, ["meeting", "cluster"])


def population(heard: DataFrame, meetings: DataFrame, least_ms: int = upkeep.LEAST_SPEAKER_MS) -> DataFrame:
    """(meeting, person, seen_before, enrolled_before): whether a person was heard in an earlier meeting of the history, and whether for long enough to be enrolled.

    heard: (meeting, person, ms); meetings: (id, started_at), whose order is the history. Firsts are found once a person, so a person with
    many meetings is one row to be joined, not a window.
    """
    at = heard.join(meetings.select(F.col("id").alias("meeting"), F.struct("started_at", "id").alias("place")), "meeting").groupBy("meeting", "person").agg(F.sum("ms").alias("ms"), F.min("place").alias("place"))
    first = at.groupBy("person").agg(F.min("place").alias("seen"), F.min(F.when(F.col("ms") >= least_ms, F.col("place"))).alias("enrolled"))
    return at.join(first, "person").select("meeting", "person", (F.col("seen") < F.col("place")).alias("seen_before"), F.coalesce(F.col("enrolled") < F.col("place"), F.lit(False)).alias("enrolled_before"))


def provisional(observations: DataFrame) -> DataFrame:
    """(meeting, id, vector): the mean of each observation's frame vectors."""
    width = F.size(F.col("frames")[0])
    mean = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.aggregate("frames", F.lit(0.0), lambda acc, f: acc + F.get(f, i)) / F.size("frames"))
    return observations.where(F.size("frames") > 0).select("meeting", "id", mean.alias("vector"))


#: Scores that are held at once.
SCORES = 1 << 21


def best_two(unit: np.ndarray, voices: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row its closest voice (the first of equals, -1 without voices), that score and the next (0 if there is none); for each voice the row that is closest to it, the last of equals.

    Scores are made and left in blocks, so memory is that of the rows and voices.
    """
    n, m = len(unit), len(voices)
    first, score, after = np.full(n, -1), np.zeros(n), np.zeros(n)
    favourite, liking = np.full(m, -1), np.full(m, -np.inf)
    for at in range(0, n if m else 0, step := max(1, SCORES // max(m, 1))):
        block = unit[at : at + step] @ voices.T
        rows = np.arange(len(block))
        most = block.max(0)
        better = np.flatnonzero(most >= liking)
        favourite[better], liking[better] = at + len(block) - 1 - block[::-1, better].argmax(0), most[better]
        place = block.argmax(1)
        first[at : at + step], score[at : at + step] = place, block[rows, place]
        if m > 1:
            block[rows, place] = -np.inf
            after[at : at + step] = block.max(1)
    return first, score, after, favourite


def replayed(chapters: DataFrame, floor: float = matching.MATCH_FLOOR, margin: float = matching.MATCH_MARGIN) -> DataFrame:
    """(series, chapter, cluster, person, outcome, seconds): what a history would have said, chapter after chapter.

    chapters: series, chapter (their order), cluster, person (who it is), vector, seconds. Each chapter is matched against
    the voices enrolled so far, then teaches them. A history is sequential, so one series is one group.
    """

    least_ms = upkeep.LEAST_SPEAKER_MS

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        series = rows["series"].iloc[0]
        names: list[int] = []  # who each enrolled voice first was
        sums: list[np.ndarray] = []
        out = []
        for chapter, part in rows.sort_values(["chapter", "cluster"]).groupby("chapter", sort=True):
            known = set(names)
            v = np.array(part["vector"].tolist(), float)
            unit = v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300)
            voices = np.array(sums)
            voices = voices / np.maximum(np.sqrt((voices * voices).sum(1, keepdims=True)), 1e-300) if sums else np.zeros((0, v.shape[1]))
            first, score, next_score, favourite = best_two(unit, voices)
            taught = []
            for i, (cluster, person, seconds) in enumerate(zip(part["cluster"], part["person"], part["seconds"], strict=True)):
                best = int(first[i])
                mutual = best >= 0 and favourite[best] == i
                if best >= 0 and score[i] >= floor and score[i] - next_score[i] >= margin and mutual:
                    what = "correct" if names[best] == person else "wrong" if person in known else "false-attach"
                    taught.append((best, v[i]))
                else:
                    what = "abstain-enrolled" if person in known else "correct-new"
                    if seconds * 1000 >= least_ms:
                        taught.append((-1, (person, v[i])))
                out.append((series, chapter, cluster, person, what, seconds))
            for place, what in taught:
                if place >= 0:
                    sums[place] = sums[place] + what
                else:
                    names.append(what[0])
                    sums.append(what[1])
        return pd.DataFrame(out, columns=["series", "chapter", "cluster", "person", "outcome", "seconds"])

    return chapters.groupBy("series").applyInPandas(run, "series long, chapter long, cluster long, person long, outcome string, seconds double")
