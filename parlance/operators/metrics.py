"""Evaluation: diarization, recognition and transcription errors. Every tally is exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from parlance.operators import intervals

#: Up to so many on the narrower side, the one-to-one mapping is exact; beyond it is greedy.
EXACT_SIDE = 18
SCORE_BUCKETS = 1024


def best_mapping(ms: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs, one to one, of the largest sum. Rows are added one by one over subsets of the narrower side."""
    flip = ms.shape[0] < ms.shape[1]
    m = ms.T if flip else ms  # columns are the narrower side
    rows, columns = m.shape
    if columns > EXACT_SIDE:
        out, taken = [], (set(), set())
        for i, j in sorted(((i, j) for i in range(ms.shape[0]) for j in range(ms.shape[1]) if ms[i, j] > 0), key=lambda p: (-ms[p], p)):
            if i not in taken[0] and j not in taken[1]:
                out.append((i, j))
                taken[0].add(i), taken[1].add(j)
        return out
    subsets = np.arange(1 << columns)
    best, pick = np.zeros(1 << columns, np.int64), np.full((rows, 1 << columns), -1, np.int8)
    for r in range(rows):
        now = best.copy()
        for c in range(columns):
            has = subsets[(subsets >> c) & 1 == 1]
            sums = best[has ^ (1 << c)] + m[r, c]
            more = (sums > now[has]) & (m[r, c] > 0)
            now[has[more]], pick[r, has[more]] = sums[more], c
        best = now
    at, out = (1 << columns) - 1, []
    for r in range(rows - 1, -1, -1):
        c = int(pick[r, at])
        if c >= 0:
            out.append((c, r) if flip else (r, c))
            at ^= 1 << c
    return sorted(out)


@pandas_udf(ArrayType(LongType()))
def mapped_pairs(pairs: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Of lists of left and right speakers and their common time, the places of the pairs of the best mapping."""

    def picked(lefts: np.ndarray, rights: np.ndarray, times: np.ndarray) -> list[int]:
        left, row = np.unique(np.asarray(lefts, object), return_inverse=True)
        right, column = np.unique(np.asarray(rights, object), return_inverse=True)
        ms, place = np.zeros((len(left), len(right)), np.int64), np.zeros((len(left), len(right)), np.int64)
        ms[row, column], place[row, column] = times, np.arange(len(times))
        return [int(place[p]) for p in best_mapping(ms)]

    for lefts, rights, times in pairs:
        yield pd.Series([picked(*x) for x in zip(lefts, rights, times, strict=True)], dtype=object)


def mapped(overlaps: DataFrame) -> DataFrame:
    """(meeting, left_speaker, right_speaker, ms) of the best one-to-one mapping of each meeting's overlaps.

    A row is a meeting's pairs of speakers, so many meetings go to Python in a batch.
    """
    rows = overlaps.groupBy("meeting").agg(F.array_sort(F.collect_list(F.struct("left_speaker", "right_speaker", "ms"))).alias("p"))
    found = rows.select("meeting", "p", mapped_pairs("p.left_speaker", "p.right_speaker", "p.ms").alias("chosen"))
    return found.select("meeting", "p", F.explode("chosen").alias("i")).select("meeting", F.get("p", F.col("i")).alias("b")).select("meeting", "b.*")


def der(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """(meeting, total_ms, missed_ms, false_alarm_ms, confusion_ms); no collar, overlaps count.

    The time that mapped speakers share is what is right, so confusion is what both sides cover less that.
    """
    ref, hyp = (intervals.merged(s, "meeting", "speaker", gap_ms=0) for s in (reference, hypothesis))
    # one on each side's count at a start, one off at an end, added up along the meeting
    bounds = lambda spans, r, h: spans.select("meeting", F.explode(F.array(*[F.struct(F.col(c).alias("start_ms"), F.lit(r * by).alias("r"), F.lit(h * by).alias("h")) for c, by in (("start_ms", 1), ("end_ms", -1))])).alias("b")).select("meeting", "b.*")
    steps = bounds(ref, 1, 0).unionByName(bounds(hyp, 0, 1)).groupBy("meeting", "start_ms").agg(F.sum("r").alias("r"), F.sum("h").alias("h"))
    along = Window.partitionBy("meeting").orderBy("start_ms")
    both = steps.select("meeting", "start_ms", F.lead("start_ms").over(along).alias("end_ms"), F.sum("r").over(along).alias("r"), F.sum("h").over(along).alias("h")).where("end_ms is not null")
    ms = F.col("end_ms") - F.col("start_ms")
    tally = both.groupBy("meeting").agg(
        F.sum(ms * F.col("r")).alias("total_ms"), F.sum(ms * F.greatest(F.col("r") - F.col("h"), F.lit(0))).alias("missed_ms"),
        F.sum(ms * F.greatest(F.col("h") - F.col("r"), F.lit(0))).alias("false_alarm_ms"), F.sum(ms * F.least("r", "h")).alias("common_ms"),
    )
    right = mapped(intervals.overlap(reference, hypothesis)).groupBy("meeting").agg(F.sum("ms").alias("right_ms"))
    return tally.join(right, "meeting", "left").select("meeting", "total_ms", "missed_ms", "false_alarm_ms", (F.col("common_ms") - F.coalesce("right_ms", F.lit(0))).alias("confusion_ms"))


def run_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """(person, meeting, gained_ms) of two runs' ledgers (person, meeting, outcome, ms); what only one covers is `uncovered`'s."""
    right = lambda run, name: run.groupBy("person", "meeting").agg(F.sum(F.when(F.col("outcome") == "correct", F.col("ms")).otherwise(0)).alias(name))
    return right(first, "a").join(right(second, "b"), ["person", "meeting"]).select("person", "meeting", (F.col("b") - F.col("a")).alias("gained_ms"))


def uncovered(first: DataFrame, second: DataFrame) -> DataFrame:
    """(person, meeting, run) that only that run has; a comparison holds if this is empty."""
    a, b = (run.select("person", "meeting").distinct() for run in (first, second))
    return a.exceptAll(b).withColumn("run", F.lit("first")).unionByName(b.exceptAll(a).withColumn("run", F.lit("second")))


def ledger_faults(ledger: DataFrame, spoken: DataFrame) -> DataFrame:
    """(person, meeting, fault, outcome): entries that are there more than once, and persons whose outcomes don't add up to what they spoke."""
    keys = ["person", "meeting"]
    twice = ledger.groupBy(*keys, "outcome").count().where("count > 1").select(*keys, F.lit("entry").alias("fault"), "outcome")
    sums = ledger.groupBy(*keys).agg(F.sum("ms").alias("entered")).join(spoken.select(*keys, "ms"), keys, "full")
    wrong = sums.where(~F.col("entered").eqNullSafe(F.col("ms")) & ((F.coalesce("entered", F.lit(0)) > 0) | (F.coalesce("ms", F.lit(0)) > 0)))
    return twice.unionByName(wrong.select(*keys, F.lit("total").alias("fault"), F.lit(None).cast("string").alias("outcome")))


def constraint_counts(pairs: DataFrame, clusters: DataFrame, who: DataFrame) -> DataFrame:
    """(merged, pairs, rejoins) over pairs (id, other) of one window, whose clusters (id, cluster) and reference speakers (id, speaker) are known.

    A pair of one speaker is a rejoin; of the others, those in one cluster were merged. A pair counts once.
    """
    once = pairs.where("id < other").select("id", "other").distinct()
    named = lambda df, column, key, name: df.select(F.col("id").alias(key), F.col(column).alias(name))
    rows = once.join(named(who, "speaker", "id", "a"), "id").join(named(who, "speaker", "other", "b"), "other")
    rows = rows.join(named(clusters, "cluster", "id", "c"), "id", "left").join(named(clusters, "cluster", "other", "d"), "other", "left")
    apart = F.col("a") != F.col("b")
    return rows.agg(F.count_if(apart & F.col("c").eqNullSafe(F.col("d"))).alias("merged"), F.count_if(apart).alias("pairs"), F.count_if(~apart).alias("rejoins"))


def pooled(tallies: DataFrame) -> DataFrame:
    """One rate of all meetings' sums."""
    parts = ("missed_ms", "false_alarm_ms", "confusion_ms")
    sums = tallies.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_ms", *parts)])
    return sums.withColumn("rate", F.when(F.col("total_ms") == 0, F.lit(0.0)).otherwise(sum((F.col(c) for c in parts), F.lit(0)) / F.col("total_ms")))


def relabelled(hypothesis: DataFrame, reference: DataFrame, row: str = "id") -> DataFrame:
    """(row, speaker): each span under the reference speaker it shares most with, ties to the smaller name; else its own."""
    spans = hypothesis.withColumn("speaker_own", F.col("speaker"))
    numbered = spans.select("meeting", F.col(row).cast("string").alias("speaker"), "start_ms", "end_ms")
    shared = intervals.overlap(numbered, reference)
    best = shared.groupBy("left_speaker").agg(F.min(F.struct((-F.col("ms")).alias("ms"), F.col("right_speaker").alias("name"))).alias("b"))
    return spans.join(best, spans[row].cast("string") == best["left_speaker"], "left").select(row, F.coalesce("b.name", "speaker_own").alias("speaker"))


def sweep(trials: DataFrame) -> DataFrame:
    """(score, false_accepts, false_rejects, positives, negatives) at each distinct score as threshold.

    Running sums go over buckets of score first, then within each, so no task holds all scores.
    """
    by = trials.groupBy("score").agg(F.count_if("same").alias("p"), F.count_if(~F.col("same")).alias("n"))
    by = by.withColumn("bucket", F.least(F.greatest(F.floor(F.col("score") * SCORE_BUCKETS), F.lit(-SCORE_BUCKETS)), F.lit(SCORE_BUCKETS)))
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    totals = by.groupBy("bucket").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))  # at most 2 * SCORE_BUCKETS + 1 rows
    totals = totals.select("bucket", F.coalesce(F.sum("bp").over(order), F.lit(0)).alias("p_before"), F.coalesce(F.sum("bn").over(order), F.lit(0)).alias("n_before"), F.sum("bp").over(whole).alias("positives"), F.sum("bn").over(whole).alias("negatives"))
    inner = Window.partitionBy("bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    rows = by.join(F.broadcast(totals), "bucket")
    rejects = F.col("p_before") + F.coalesce(F.sum("p").over(inner), F.lit(0))
    accepts = F.col("negatives") - F.col("n_before") - F.coalesce(F.sum("n").over(inner), F.lit(0))
    return rows.select("score", accepts.alias("false_accepts"), rejects.alias("false_rejects"), "positives", "negatives")


def equal_error(trials: DataFrame) -> DataFrame:
    """(rate, threshold) where both errors are closest, the first of equals; no row without both kinds."""
    far, frr = F.col("false_accepts") / F.col("negatives"), F.col("false_rejects") / F.col("positives")
    rows = sweep(trials).where("positives > 0 and negatives > 0").select(F.abs(far - frr).alias("gap"), "score", ((far + frr) / 2).alias("rate"))
    return rows.agg(F.min(F.struct("gap", "score", "rate")).alias("b")).where("b is not null").select("b.rate", F.col("b.score").alias("threshold"))


def false_accepts_at(trials: DataFrame, threshold: float) -> DataFrame:
    """Share of different-speaker trials at or over a threshold; no row without any."""
    return trials.where(~F.col("same")).agg(F.avg((F.col("score") >= threshold).cast("double")).alias("rate")).where("rate is not null")


def refusal(trials: DataFrame) -> DataFrame:
    """(above, refused): the score to be over to admit no wrong trial, and the share of right ones that refuses."""
    worst = trials.where(~F.col("same")).agg(F.max("score").alias("above"))
    right = trials.where("same").crossJoin(F.broadcast(worst))  # worst is one row
    share = right.agg(F.avg((F.col("score") <= F.col("above")).cast("double")).alias("refused"))
    return worst.crossJoin(F.broadcast(share)).where("above is not null").select("above", F.coalesce("refused", F.lit(0.0)).alias("refused"))


#: A cell holds its cost times this, plus its substitutions.
COST = 1 << 32


def edits(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) of a cheapest alignment; ties prefer substitutions, then deletions.

    The table is filled by anti-diagonals, each in a few array operations from the two before it; what isn't a substitution
    follows from cost and lengths.
    """
    code: dict[str, int] = {}
    r, h = (np.array([code.setdefault(w, len(code)) for w in words], np.int64) for words in (reference, hypothesis))
    n, m = len(r), len(h)
    backward = h[::-1]
    older, last = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)  # by place in the reference
    for k in range(1, n + m + 1):
        now = np.empty(n + 1, np.int64)
        low, high = max(1, k - m), min(n, k - 1)
        if low <= high:
            diagonal, up, left = older[low - 1 : high], last[low - 1 : high] + COST, last[low : high + 1] + COST
            swap = diagonal + COST + 1
            other = np.where(up // COST <= left // COST, up, left)
            best = np.where(swap // COST <= other // COST, swap, other)
            now[low : high + 1] = np.where(r[low - 1 : high] == backward[m - k + low : m - k + high + 1], diagonal, best)
        if k <= m:
            now[0] = k * COST
        if k <= n:
            now[k] = k * COST
        older, last = last, now
    cost, swaps = divmod(int(last[n]), COST)
    deleted = (cost - swaps - (m - n)) // 2
    return swaps, deleted, deleted + m - n


EDITS = StructType([StructField(c, LongType()) for c in ("words", "substitutions", "deletions", "insertions")])


@pandas_udf(EDITS)
def word_edits(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Edits from one list of words, or characters, to another."""
    for reference, hypothesis in pairs:
        rows = [(0 if r is None else len(r), *edits([] if r is None else list(r), [] if h is None else list(h))) for r, h in zip(reference, hypothesis, strict=True)]
        yield pd.DataFrame(rows, columns=EDITS.names)


def error_rate(e: Column) -> Column:
    """Edits a reference word, not clamped; of an empty reference 0 if nothing was said, else 1."""
    n = e["substitutions"] + e["deletions"] + e["insertions"]
    return F.when(e["words"] > 0, n / e["words"]).otherwise(F.when(n > 0, F.lit(1.0)).otherwise(F.lit(0.0)))


def outcome(f: dict[str, Column]) -> Column:
    """What became of a person's speech in a meeting, from facts: scorable, attributed, enrolled, match, minted, seen, why."""
    return (
        F.when(~f["scorable"], "unscorable")
        .when(~f["attributed"], F.concat(F.lit("unattributed:"), F.when(f["why"].isin("no-turn", "no-embedding", "mint-floor"), f["why"]).otherwise("unexpected")))
        .when(f["enrolled"] & f["match"], "correct")
        .when(f["enrolled"] & f["minted"], "abstain-enrolled")
        .when(f["enrolled"], "wrong")
        .when(f["minted"], F.when(f["seen"], "abstain-never-enrolled").otherwise("correct-new"))
        .otherwise("false-attach")
    )
