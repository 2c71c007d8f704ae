"""Voices: exemplars to voiceprints, voiceprints to meetings, and the clusters of one meeting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import vectors as V

#: Exemplars of a voiceprint, and the gates of a match, a merge and a split.
MOST_EXEMPLARS, MATCH_FLOOR, MATCH_MARGIN, MERGE_AT, BLOCK = 32, 0.62, 0.08, 0.60, 2_000
AGREEMENT_FLOOR, MINORITY_SHARE = 0.50, 0.25


def capped(exemplars: DataFrame, most: int = MOST_EXEMPLARS) -> DataFrame:
    """Up to so many exemplars a speaker, taken in turn from their meetings, newest meeting and newest exemplar first."""
    mine = Window.partitionBy("speaker_id", "meeting")
    rows = exemplars.withColumn("depth", F.row_number().over(mine.orderBy(F.col("id").desc()))).withColumn("newest", F.max("id").over(mine))
    turn = F.row_number().over(Window.partitionBy("speaker_id").orderBy("depth", F.col("newest").desc()))
    return rows.withColumn("turn", turn).where(F.col("turn") <= most).drop("depth", "newest")


def centroids(exemplars: DataFrame, *keys: str, most: int = MOST_EXEMPLARS) -> DataFrame:
    """(keys, vector, n): mean of the newest positives, weighted by voiced time. At most `most` vectors meet in a row."""
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("id").desc()))
    kept = exemplars.where(~F.col("is_negative") & (F.size("vector") > 0)).withColumn("newest", newest).where(F.col("newest") <= most)
    items = F.array_sort(F.collect_list(F.struct("newest", F.greatest("voiced_ms", F.lit(1)).cast("double").alias("weight"), "vector")))
    return kept.groupBy(*keys).agg(items.alias("items")).select(*keys, V.weighted_mean(F.col("items")).alias("vector"), F.size("items").cast("long").alias("n"))


def means(exemplars: DataFrame, *keys: str, weighted: bool = True) -> DataFrame:
    """(keys, vector, n): mean of all positives, weighted by voiced time or all alike (G19), normalised. Vectors of another width than the newest are left out.

    Coordinates are summed by position before the shuffle, so no row or task holds a key's vectors, however many they are.
    """
    weight = F.greatest("voiced_ms", F.lit(1)).cast("double") if weighted else F.lit(1.0)
    rows = exemplars.where(~F.col("is_negative") & (F.size("vector") > 0))
    parts = rows.select(*keys, F.col("id").alias("__id"), F.size("vector").alias("__width"), weight.alias("__weight"), F.posexplode("vector").alias("__at", "__x"))
    sums = parts.groupBy(*keys, "__width", "__at").agg(
        (F.sum(F.col("__x").cast("double") * F.col("__weight")) / F.sum("__weight")).alias("x"), F.count(F.lit(1)).alias("n"), F.max("__id").alias("newest")
    )
    wide = sums.groupBy(*keys, "__width").agg(F.array_sort(F.collect_list(F.struct("__at", "x"))).alias("xs"), F.max("n").alias("n"), F.max("newest").alias("newest"))
    whole = wide.groupBy(*keys).agg(F.max_by("xs", "newest").alias("xs"), F.sum("n").alias("n"))
    return whole.select(*keys, V.normalised(F.transform("xs", lambda i: i["x"])).alias("vector"), "n")


#: Pairs of one model identity are dealt over so many keys; a side small enough is broadcast by Spark, by its measured size.
SALTS = 64


def dealt(left: DataFrame, right: DataFrame, on: list[str], *keys: str) -> DataFrame:
    """left joined with right on columns that may have one value only: rows of left are salted by keys, those of right copied to each salt."""
    a = left.withColumn("__salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int"))
    b = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return a.join(b, [*on, "__salt"]).drop("__salt")


def scored(clusters: DataFrame, seeds: DataFrame) -> DataFrame:
    """(meeting, cluster, speaker_id, confirmed, score) of pairs of one model identity."""
    s = seeds.select("speaker_id", "confirmed", "model", "model_version", F.col("vector").alias("seed"))
    return dealt(clusters, s, ["model", "model_version"], "meeting", "cluster").select("meeting", "cluster", "speaker_id", "confirmed", V.cosine(F.col("vector"), F.col("seed")).alias("score"))


def resolved(scores: DataFrame, floor: float = MATCH_FLOOR, margin: float = MATCH_MARGIN) -> DataFrame:
    """(meeting, cluster, speaker_id, score, runner_up): clusters whose best seed clears floor and margin and likes them best.

    Confirmed seeds win ties with unconfirmed ones. With one seed the runner-up is 0.
    """
    rank = F.row_number().over(Window.partitionBy("meeting", "cluster").orderBy(F.col("score").desc(), F.col("confirmed").desc(), "speaker_id"))
    back = F.row_number().over(Window.partitionBy("meeting", "speaker_id").orderBy(F.col("score").desc(), F.col("cluster").desc()))
    rows = scores.withColumn("rank", rank).withColumn("back", back).where("rank <= 2")
    pick = lambda i, c: F.max(F.when(F.col("rank") == i, F.col(c)))
    two = rows.groupBy("meeting", "cluster").agg(
        pick(1, "speaker_id").alias("speaker_id"), pick(1, "score").alias("score"), pick(1, "confirmed").alias("vouched"), pick(1, "back").alias("back"),
        F.coalesce(pick(2, "score"), F.lit(0.0)).alias("runner_up"), F.coalesce(pick(2, "confirmed"), F.lit(True)).alias("runner_vouched"),
    )
    clear = (F.col("score") - F.col("runner_up") >= margin) | (F.col("vouched") & ~F.col("runner_vouched"))
    return two.where((F.col("score") >= floor) & clear & (F.col("back") == 1)).select("meeting", "cluster", "speaker_id", "score", "runner_up")


def nearest_elsewhere(voices: DataFrame) -> DataFrame:
    """(speaker_id, meeting, nearest, score): the closest voice of another meeting. voices: speaker_id, meeting, model, vector."""
    other = voices.select(F.col("speaker_id").alias("nearest"), F.col("meeting").alias("elsewhere"), "model", F.col("vector").alias("other"))
    pairs = dealt(voices, other, ["model"], "speaker_id", "meeting").where(F.col("meeting") != F.col("elsewhere"))
    best = pairs.groupBy("speaker_id", "meeting").agg(F.max(F.struct(V.cosine(F.col("vector"), F.col("other")).alias("score"), "nearest", "elsewhere")).alias("b"))
    return best.select("speaker_id", "meeting", "b.nearest", "b.score")


#: Scores that are held at once.
SCORES = 1 << 24


class Centres:
    """Centres of groups, and of each the closest one after it in order.

    `best` and `at` may be out of date after a merge: then best is an upper bound, and the row is scored again only when it would be chosen. So memory is
    the vectors, and time about one product of the vectors with one of them a merge.
    """

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, apart: list[set[int]]):
        self.centre, self.weight, self.apart = np.array(vectors, float), np.array(sizes, float), apart
        self.norm = np.sqrt((self.centre * self.centre).sum(1))
        self.centre = np.where((self.norm > 0)[:, None], self.centre, 0.0)
        self.unit = self.centre / np.maximum(self.norm, 1e-300)[:, None]
        self.alive = np.ones(len(self.norm), bool)
        self.best, self.at = np.full(len(self.norm), -np.inf), np.zeros(len(self.norm), np.int64)
        self.stale = np.zeros(len(self.norm), bool)
        for first in range(0, len(self.norm), step := max(1, SCORES // max(len(self.norm), 1))):
            self.rescore(np.arange(first, min(first + step, len(self.norm))))

    def rescore(self, rows: np.ndarray) -> None:
        score = self.unit[rows] @ self.unit.T
        score[:, ~self.alive] = -np.inf
        score[np.arange(score.shape[1]) <= rows[:, None]] = -np.inf
        for k, i in enumerate(rows.tolist()):
            if self.apart[i]:
                score[k, list(self.apart[i])] = -np.inf
        self.at[rows] = score.argmax(1)
        self.best[rows] = score[np.arange(len(rows)), self.at[rows]]
        self.stale[rows] = False

    def closest(self) -> tuple[int, int, float]:
        """The first of the closest pairs, and its score."""
        while self.stale[i := int(self.best.argmax())]:
            self.rescore(np.array([i]))
        return i, int(self.at[i]), self.best[i]

    def merge(self, i: int, j: int) -> None:
        """Group j goes into group i, which is before it."""
        centre = (self.centre[i] * self.weight[i] + self.centre[j] * self.weight[j]) / (self.weight[i] + self.weight[j])
        length = np.sqrt(centre @ centre)
        self.centre[i] = centre / length if length > 0 else centre
        self.norm[i] = np.sqrt((self.centre[i] * self.centre[i]).sum())
        self.unit[i] = self.centre[i] / max(self.norm[i], 1e-300)
        self.weight[i] += self.weight[j]
        self.alive[j], self.best[j], self.stale[j] = False, -np.inf, False
        for k in self.apart[j]:
            self.apart[k].discard(j)
            self.apart[k].add(i)
        self.apart[i] |= self.apart[j]
        now = self.centre @ self.centre[i] / np.maximum(self.norm, 1e-300)
        now[~self.alive] = -np.inf
        if self.apart[i]:
            now[list(self.apart[i])] = -np.inf
        now[i] = -np.inf
        # rows before i see it anew; those that were closest to i or j may have another closest
        n, lost = now[:i], (self.at == i) | (self.at == j)
        nearer = (n > self.best[:i]) | ((n == self.best[:i]) & (n > -np.inf) & (self.stale[:i] | lost[:i] | (i < self.at[:i])))
        fresh = nearer & ((n > self.best[:i]) | ~self.stale[:i])
        self.stale[:i] |= lost[:i] & self.alive[:i]
        self.stale[i + 1 : j] |= lost[i + 1 : j] & self.alive[i + 1 : j]
        self.best[:i][fresh], self.at[:i][fresh], self.stale[:i][fresh] = n[fresh], i, False
        self.at[i] = i + int(now[i:].argmax())
        self.best[i], self.stale[i] = now[self.at[i]], False


def merge_closest(vectors: np.ndarray, sizes: np.ndarray, threshold: float, blocked: list[set[int]] | None = None) -> list[list[int]]:
    """Groups of rows, the closest pair of centres merged first until none is closer than threshold.

    blocked[i]: rows that i must not join; merging hands them on. Of equally close pairs the first in order is merged.
    """
    groups: list[list[int]] = [[i] for i in range(len(vectors))]
    if not groups:
        return []
    apart: list[set[int]] = [set() for _ in groups]
    for i, b in enumerate(blocked or ()):
        for j in b:
            apart[i].add(j)
            apart[j].add(i)
    centres = Centres(vectors, sizes, apart)
    while True:
        i, j, score = centres.closest()
        if score < threshold or score == -np.inf:
            break
        centres.merge(i, j)
        groups[i] += groups[j]
        groups[j] = []
    return [sorted(g) for g in groups if g]


def grouped_ids(ids: list[int], vectors: np.ndarray, threshold: float, blocked: dict[int, set[int]] | None = None, block: int = BLOCK) -> dict[int, int]:
    """C4: id to the smallest id of its group; more than block ids are merged in blocks first, then the survivors."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = [ids[i] for i in order], vectors[order]
    place = {x: i for i, x in enumerate(ids)}
    bars = [{place[y] for y in (blocked or {}).get(x, ()) if y in place} for x in ids]
    groups: list[list[int]] = []
    for at in range(0, len(ids), block):
        part = range(at, min(at + block, len(ids)))
        local = merge_closest(vectors[list(part)], np.ones(len(part)), threshold, [{b - at for b in bars[i] if b in part} for i in part])
        groups += [[at + i for i in g] for g in local]
    if len(ids) > block:
        centre = np.array([vectors[g].mean(0) for g in groups])
        group_of = {i: k for k, g in enumerate(groups) for i in g}
        own = [{group_of[x] for i in g for x in bars[i]} for g in groups]
        groups = [sorted(i for k in g for i in groups[k]) for g in merge_closest(centre, np.array([len(g) for g in groups]), threshold, own)]
    return {ids[i]: ids[min(g)] for g in groups for i in g}


def agglomerated(observations: DataFrame, threshold: float = MERGE_AT, cannot_link: DataFrame | None = None) -> DataFrame:
    """(meeting, id, cluster) of observations (meeting, id, vector); cannot_link: (meeting, id, other), both ways.

    One meeting is one group: its vectors are bounded by its length, and blocks bound the matrix.
    """

    def run(rows: pd.DataFrame, bars: pd.DataFrame | None = None) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"meeting": [], "id": [], "cluster": []})
        blocked: dict[int, set[int]] = {}
        for a, b in zip(bars["id"], bars["other"], strict=True) if bars is not None else ():
            blocked.setdefault(a, set()).add(b)
        found = grouped_ids(rows["id"].tolist(), np.array(rows["vector"].tolist(), float), threshold, blocked)
        return pd.DataFrame({"meeting": rows["meeting"].iloc[0], "id": list(found), "cluster": list(found.values())})

    rows = observations.select("meeting", "id", "vector").groupBy("meeting")
    schema = "meeting long, id long, cluster long"
    if cannot_link is None:
        return rows.applyInPandas(lambda g: run(g), schema)
    return rows.cogroup(cannot_link.select("meeting", "id", "other").groupBy("meeting")).applyInPandas(run, schema)


def split_in_two(vectors: np.ndarray, weights: np.ndarray, passes: int = 16) -> tuple[float, int, int] | None:
    """(agreement of the two centres, size of the smaller half, size); None if there is one voice at most."""
    if len(vectors) < 2:
        return None
    unit = vectors / np.maximum(np.sqrt((vectors * vectors).sum(1, keepdims=True)), 1e-300)
    score = unit @ unit.T
    score[np.tril_indices(len(score))] = np.inf
    i, j = np.unravel_index(int(score.argmin()), score.shape)
    side = unit @ unit[j] > unit @ unit[i]
    out = None
    for _ in range(passes):
        if side.all() or not side.any():
            return None
        a, b = (np.average(vectors[s], axis=0, weights=np.maximum(weights[s], 1)) for s in (~side, side))
        a, b = a / np.sqrt(a @ a), b / np.sqrt(b @ b)
        out = float(a @ b), int(min(side.sum(), (~side).sum())), len(vectors)
        after = unit @ b > unit @ a
        if (after == side).all():
            break
        side = after
    return out


def two_voices(exemplars: DataFrame) -> DataFrame:
    """(speaker_id, agreement, minority, total, two_voices) of each speaker's capped exemplars."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        found = split_in_two(np.array(rows["vector"].tolist(), float), rows["voiced_ms"].to_numpy(float))
        if found is None:
            return pd.DataFrame({"speaker_id": [], "agreement": [], "minority": [], "total": [], "two_voices": []})
        agreement, minority, total = found
        return pd.DataFrame([(rows["speaker_id"].iloc[0], agreement, minority, total, agreement < AGREEMENT_FLOOR and minority >= 2 and minority >= total * MINORITY_SHARE)], columns=["speaker_id", "agreement", "minority", "total", "two_voices"])

    kept = capped(exemplars.where(~F.col("is_negative"))).select("speaker_id", "id", "vector", "voiced_ms")
    return kept.groupBy("speaker_id").applyInPandas(run, "speaker_id long, agreement double, minority long, total long, two_voices boolean")
