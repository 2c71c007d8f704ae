"""Queries on evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import intervals, metrics
from parlance.plans import speech  # noqa: F401  its SQL views are used here
from parlance.sources import project as P


def der_components(spark, d):
    """Each meeting's total, missed, false-alarm and confused time."""
    return metrics.der(P.reference_spans(spark, d), P.hypothesis_spans(spark, d))


def der_pooled(spark, d):
    """One error rate of all meetings."""
    return metrics.pooled(der_components(spark, d)).withColumn("rate", F.round("rate", 6))


def optimal_mapping(spark, d):
    """How much time the best one-to-one mapping of each meeting gets right."""
    return metrics.mapped(intervals.overlap(P.reference_spans(spark, d), P.hypothesis_spans(spark, d))).groupBy("meeting").agg(F.sum("ms").alias("right_ms"))


def oracle_relabel(spark, d):
    """Hypothesis spans under the reference speaker they share most with."""
    turns = P.turns(spark, d)
    own = turns.where("event_id % 7 <> 0").select(F.col("event_id").alias("id"), "meeting", F.lit("none").alias("speaker"), (F.col("start_ms") + 200).alias("start_ms"), (F.col("end_ms") + 200).alias("end_ms"))
    return metrics.relabelled(own, P.reference_spans(spark, d))


def eer_sweep(spark, d):
    """The equal error rate and its threshold."""
    return metrics.equal_error(P.trials(spark, d)).select(F.round("rate", 6).alias("rate"), "threshold")


def far_at_threshold(spark, d):
    """Share of wrong trials at 0.62 or more."""
    return metrics.false_accepts_at(P.trials(spark, d), 0.62).select(F.round("rate", 6).alias("rate"))


def refusal_point(spark, d):
    """What refusing every wrong trial costs."""
    return metrics.refusal(P.trials(spark, d)).select("above", F.round("refused", 6).alias("refused"))


def overlaps(spark, d):
    return intervals.overlap(P.reference_spans(spark, d), P.hypothesis_spans(spark, d))


def dominant_speaker(spark, d):
    """For each cluster the reference speaker with most of its time, ties to the larger name."""
    return overlaps(spark, d).groupBy("meeting", "right_speaker").agg(F.max_by("left_speaker", F.struct("ms", "left_speaker")).alias("speaker"))


def ownership(spark, d):
    """The share of each cluster's time that its largest owner has."""
    return overlaps(spark, d).groupBy("meeting", "right_speaker").agg(F.round(F.max("ms") / F.sum("ms"), 6).alias("purity"))


def facts(spark, d):
    e = F.col("event_id")
    turns = P.turns(spark, d).withColumn("ms", F.col("end_ms") - F.col("start_ms"))
    what = metrics.outcome({"scorable": e % 13 != 0, "attributed": e % 5 != 0, "enrolled": e % 3 == 0, "match": e % 2 == 0, "minted": e % 4 == 1, "seen": e % 7 < 3, "why": F.element_at(F.array(*[F.lit(x) for x in ("no-turn", "no-embedding", "mint-floor", "odd")]), (e % 4 + 1).cast("int"))})
    return turns.select("meeting", F.col("cluster").alias("person"), what.alias("outcome"), "ms", F.when(e % 3 == 0, "enrolled").otherwise("new").alias("population"))


def ledger(spark, d):
    """Time of each person, meeting and outcome."""
    return facts(spark, d).groupBy("person", "meeting", "outcome").agg(F.sum("ms").alias("ms"))


def population_report(spark, d):
    """Time by population and outcome, with subtotals, and what of each population is scored."""
    rows = facts(spark, d).rollup("population", "outcome").agg(F.sum("ms").alias("ms"), F.sum(F.when(F.col("outcome") != "unscorable", F.col("ms")).otherwise(0)).alias("scored_ms"), F.grouping_id().cast("int").alias("level"))
    return rows


def two_runs(spark, d):
    """Two runs' ledgers (person, meeting, outcome, ms) on the same speech; the second saw nothing of some meetings."""
    rows = facts(spark, d).groupBy("person", "meeting", "outcome").agg(F.sum("ms").alias("ms"))
    return rows, rows.where("meeting % 50 <> 7").withColumn("outcome", F.when(F.col("outcome") == "correct-new", "correct").otherwise(F.col("outcome")))


def run_diff(spark, d):
    """Change in correct time between two runs, of each person and meeting that both cover."""
    return metrics.run_difference(*two_runs(spark, d))


def run_coverage(spark, d):
    """Persons and meetings that only one of two runs covers."""
    return metrics.uncovered(*two_runs(spark, d))


def ledger_faults(spark, d):
    """Of a ledger with rows entered twice and others left out, the entries that aren't unique and the persons whose time doesn't add up."""
    rows = facts(spark, d).groupBy("person", "meeting", "outcome").agg(F.sum("ms").alias("ms"))
    entered = rows.where("meeting % 40 <> 3").union(rows.where("meeting % 40 = 5"))
    return metrics.ledger_faults(entered, rows.groupBy("person", "meeting").agg(F.sum("ms").alias("ms")))


def recognition_report(spark, d):
    """Percentiles of turn lengths by voice."""
    rows = P.turns(spark, d).withColumn("ms", F.col("end_ms") - F.col("start_ms"))
    return rows.groupBy("cluster").agg(F.round(F.percentile("ms", 0.5), 4).alias("median"), F.round(F.percentile("ms", 0.9), 4).alias("p90"), F.count(F.lit(1)).alias("n"))


def word_errors(spark, d):
    """Word errors of texts read with every seventh word dropped and every fifth changed."""
    words = T.words(T.spaced(F.coalesce("text", F.lit(""))))
    kept = F.filter(words, lambda w, i: i % 7 != 6)
    heard = F.transform(kept, lambda w, i: F.when(i % 5 == 4, F.concat(w, F.lit("x"))).otherwise(w))
    e = F.col("e")
    rows = P.table(spark, d, "conversations").select("conv_id", "turn", metrics.word_edits(words, heard).alias("e"))
    return rows.select("conv_id", "turn", "e.*", F.round(metrics.error_rate(e), 6).alias("rate"))


S = P.sql
SPANS = ("turns", "reference", "hypothesis", "ref", "hyp", "area", "covers")
P.SQL["pairs"] = "pairs AS (SELECT r.meeting, r.speaker AS l, h.speaker AS r, CAST(sum(least(r.end_ms, h.end_ms) - greatest(r.start_ms, h.start_ms)) AS BIGINT) AS ms FROM ref r JOIN hyp h ON r.meeting = h.meeting AND r.start_ms < h.end_ms AND h.start_ms < r.end_ms GROUP BY 1, 2, 3)"
# every one-to-one mapping, one left speaker after the other
BEST = """left_of AS (SELECT meeting, l, row_number() OVER (PARTITION BY meeting ORDER BY l) AS i FROM (SELECT DISTINCT meeting, l FROM pairs)),
grown AS (SELECT DISTINCT meeting, 0::BIGINT AS i, []::VARCHAR[] AS used, 0::BIGINT AS ms FROM pairs
  UNION ALL SELECT * FROM (SELECT g.meeting, g.i + 1, g.used, g.ms FROM grown g JOIN left_of f ON f.meeting = g.meeting AND f.i = g.i + 1
    UNION ALL SELECT g.meeting, g.i + 1, list_append(g.used, p.r), g.ms + p.ms FROM grown g JOIN left_of f ON f.meeting = g.meeting AND f.i = g.i + 1 JOIN pairs p ON p.meeting = f.meeting AND p.l = f.l WHERE NOT list_contains(g.used, p.r))),
best AS (SELECT meeting, max(ms) AS right_ms FROM grown GROUP BY meeting)"""
P.SQL["best"] = BEST
TALLY = """tally AS (SELECT meeting, CAST(sum((end_ms - start_ms) * "references") AS BIGINT) AS total_ms, CAST(sum((end_ms - start_ms) * greatest("references" - hypotheses, 0)) AS BIGINT) AS missed_ms,
  CAST(sum((end_ms - start_ms) * greatest(hypotheses - "references", 0)) AS BIGINT) AS false_alarm_ms, CAST(sum((end_ms - start_ms) * least("references", hypotheses)) AS BIGINT) - coalesce(max(right_ms), 0) AS confusion_ms FROM covers LEFT JOIN best USING (meeting) GROUP BY meeting)"""
P.SQL["tally"] = TALLY
P.SQL["facts"] = """facts AS (SELECT meeting, cluster AS person, end_ms - start_ms AS ms, CASE WHEN event_id % 3 = 0 THEN 'enrolled' ELSE 'new' END AS population,
  CASE WHEN event_id % 13 = 0 THEN 'unscorable' WHEN event_id % 5 = 0 THEN 'unattributed:' || CASE event_id % 4 WHEN 0 THEN 'no-turn' WHEN 1 THEN 'no-embedding' WHEN 2 THEN 'mint-floor' ELSE 'unexpected' END
    WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'correct' WHEN event_id % 3 = 0 AND event_id % 4 = 1 THEN 'abstain-enrolled' WHEN event_id % 3 = 0 THEN 'wrong'
    WHEN event_id % 4 = 1 THEN CASE WHEN event_id % 7 < 3 THEN 'abstain-never-enrolled' ELSE 'correct-new' END ELSE 'false-attach' END AS outcome FROM turns)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


QUERIES = {
    "der_components": (der_components, recursive(S("SELECT * FROM tally", *SPANS, "pairs", "best", "tally"))),
    "der_pooled": (der_pooled, recursive(S("SELECT *, round((missed_ms + false_alarm_ms + confusion_ms) / total_ms, 6) AS rate FROM (SELECT CAST(sum(total_ms) AS BIGINT) AS total_ms, CAST(sum(missed_ms) AS BIGINT) AS missed_ms, CAST(sum(false_alarm_ms) AS BIGINT) AS false_alarm_ms, CAST(sum(confusion_ms) AS BIGINT) AS confusion_ms FROM tally)", *SPANS, "pairs", "best", "tally"))),
    "optimal_mapping": (optimal_mapping, recursive(S("SELECT * FROM best", "turns", "reference", "hypothesis", "ref", "hyp", "pairs", "best"))),
    "oracle_relabel": (oracle_relabel, S("""SELECT t.event_id AS id, coalesce((SELECT min_by(speaker, (-ms, speaker)) FROM (
  SELECT r.speaker, sum(least(r.end_ms, t.end_ms + 200) - greatest(r.start_ms, t.start_ms + 200)) AS ms FROM ref r WHERE r.meeting = t.meeting AND r.start_ms < t.end_ms + 200 AND t.start_ms + 200 < r.end_ms GROUP BY r.speaker)), 'none') AS speaker
  FROM turns t WHERE t.event_id % 7 <> 0""", "turns", "reference", "ref")),
    "eer_sweep": (eer_sweep, S("""SELECT round((far + frr) / 2, 6) AS rate, score AS threshold FROM (SELECT score, sum(n) OVER (ORDER BY score DESC) / sum(n) OVER () AS far, (sum(p) OVER (ORDER BY score) - p) / sum(p) OVER () AS frr
  FROM (SELECT score, count(*) FILTER (same) AS p, count(*) FILTER (NOT same) AS n FROM trials GROUP BY score)) ORDER BY abs(far - frr), score LIMIT 1""", "trials")),
    "far_at_threshold": (far_at_threshold, S("SELECT round(avg(CASE WHEN score >= 0.62 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS rate FROM trials WHERE NOT same", "trials")),
    "refusal_point": (refusal_point, S("SELECT above, round((SELECT avg(CASE WHEN score <= above THEN 1.0 ELSE 0.0 END)::DOUBLE FROM trials WHERE same), 6) AS refused FROM (SELECT max(score) AS above FROM trials WHERE NOT same)", "trials")),
    "dominant_speaker": (dominant_speaker, S("SELECT meeting, r AS right_speaker, max_by(l, (ms, l)) AS speaker FROM pairs GROUP BY 1, 2", "turns", "reference", "hypothesis", "ref", "hyp", "pairs")),
    "ownership": (ownership, S("SELECT meeting, r AS right_speaker, round(max(ms) / sum(ms), 6) AS purity FROM pairs GROUP BY 1, 2", "turns", "reference", "hypothesis", "ref", "hyp", "pairs")),
    "ledger": (ledger, S("SELECT person, meeting, outcome, CAST(sum(ms) AS BIGINT) AS ms FROM facts GROUP BY 1, 2, 3", "turns", "facts")),
    "population_report": (population_report, S("SELECT population, outcome, CAST(sum(ms) AS BIGINT) AS ms, CAST(sum(CASE WHEN outcome <> 'unscorable' THEN ms ELSE 0 END) AS BIGINT) AS scored_ms, CAST(grouping(population, outcome) AS INTEGER) AS level FROM facts GROUP BY ROLLUP (population, outcome)", "turns", "facts")),
    "run_diff": (run_diff, S("""SELECT person, meeting, CAST(coalesce(sum(ms) FILTER (outcome = 'correct-new'), 0) AS BIGINT) AS gained_ms FROM facts WHERE meeting % 50 <> 7 GROUP BY 1, 2""", "turns", "facts")),
    "run_coverage": (run_coverage, S("""SELECT DISTINCT person, meeting, 'first' AS run FROM facts WHERE meeting % 50 = 7""", "turns", "facts")),
    "ledger_faults": (ledger_faults, S("""SELECT person, meeting, 'entry' AS fault, outcome FROM facts WHERE meeting % 40 = 5 GROUP BY ALL UNION ALL SELECT DISTINCT person, meeting, 'total', NULL FROM facts WHERE meeting % 40 IN (3, 5)""", "turns", "facts")),
    "recognition_report": (recognition_report, S("SELECT cluster, round(quantile_cont(end_ms - start_ms, 0.5), 4) AS median, round(quantile_cont(end_ms - start_ms, 0.9), 4) AS p90, count(*) AS n FROM turns GROUP BY cluster", "turns")),
    "word_errors": (word_errors, None),
}
