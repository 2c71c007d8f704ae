"""Queries on vectors, matching and clustering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.functions import vectors as V
from parlance.operators import live, matching, metrics
from parlance.sources import project as P


def gallery(spark, d):
    """Voiceprints of even exemplars; even speakers are confirmed."""
    made = matching.means(P.exemplars(spark, d).where("id % 2 = 0"), "speaker_id")
    return made.select("speaker_id", (F.col("speaker_id") % 2 == 0).alias("confirmed"), F.lit("m").alias("model"), F.lit("1").alias("model_version"), "vector")


def probes(spark, d):
    found = P.exemplars(spark, d).where("id % 2 = 1 and meeting is not null")
    return found.select("meeting", F.col("id").alias("cluster"), F.lit("m").alias("model"), F.lit("1").alias("model_version"), "vector")


def gallery_scan(spark, d):
    """Exemplars of one model identity."""
    return P.exemplars(spark, d).where("model = 'model1' and model_version = '1'").select("id", "speaker_id")


def exemplar_cap(spark, d):
    """Which exemplars make a voiceprint, in turn."""
    return matching.capped(P.exemplars(spark, d)).select("speaker_id", "id", "turn")


def centroid(spark, d):
    """The first four coordinates of each voiceprint."""
    made = matching.centroids(P.exemplars(spark, d), "speaker_id")
    return made.select("speaker_id", "n", *[F.round(F.col("vector")[i], 6).alias(f"x{i}") for i in range(4)])


def oracle_centroids(spark, d):
    """The norm and first coordinate of each speaker's centre in each meeting."""
    made = matching.means(P.exemplars(spark, d).where("meeting is not null"), "speaker_id", "meeting", weighted=False)
    return made.select("speaker_id", "meeting", "n", F.round(F.col("vector")[0], 6).alias("x0"))


def pair_scores(spark, d):
    """Cosine of each probe with each voiceprint."""
    return matching.scored(probes(spark, d), gallery(spark, d)).select("meeting", "cluster", "speaker_id", F.round("score", 6).alias("score"))


def gated_match(spark, d):
    """The probes that floor, margin and mutual choice let through."""
    found = matching.resolved(matching.scored(probes(spark, d), gallery(spark, d)), floor=0.3, margin=0.02)
    return found.select("meeting", "cluster", "speaker_id", F.round("score", 6).alias("score"))


def match_grid(spark, d):
    """How many probes clear each of 8 floors and 4 margins."""
    scores = matching.scored(probes(spark, d), gallery(spark, d))
    grid = spark.range(32).select((F.col("id") % 8 / 10.0).alias("floor"), (F.floor(F.col("id") / 8) / 50.0).alias("margin"))  # 32 rows
    rank = F.row_number().over(Window.partitionBy("meeting", "cluster").orderBy(F.col("score").desc()))
    first = lambda n: F.max(F.when(F.col("rank") == n, F.col("score")))
    two = scores.withColumn("rank", rank).where("rank <= 2").groupBy("meeting", "cluster").agg(first(1).alias("best"), F.coalesce(first(2), F.lit(0.0)).alias("next"))
    cleared = F.count_if((F.col("best") >= F.col("floor")) & (F.col("best") - F.col("next") >= F.col("margin")))
    return two.crossJoin(F.broadcast(grid)).groupBy("floor", "margin").agg(cleared.alias("cleared"))


def nearest_is_right(spark, d):
    """How often the closest voice of another meeting is the same person."""
    voices = matching.means(P.exemplars(spark, d).where("meeting is not null"), "speaker_id", "meeting", weighted=False).withColumn("model", F.lit("m"))
    found = matching.nearest_elsewhere(voices)
    return found.agg(F.count(F.lit(1)).alias("asked"), F.round(F.avg((F.col("nearest") == F.col("speaker_id")).cast("double")), 6).alias("right"))


def same_window_pairs(spark, d):
    """Pairs of local voices of one window."""
    rows = P.exemplars(spark, d).where("meeting is not null").select("meeting", F.floor(F.col("id") / 20).alias("window"), "id")
    other = rows.withColumnRenamed("id", "other")
    return rows.join(other, ["meeting", "window"]).where("id <> other")


def agglomerate(spark, d):
    """The clusters of each meeting's observations, closest first."""
    return matching.agglomerated(P.exemplars(spark, d).where("meeting is not null"), 0.35)


def agglomerate_constrained(spark, d):
    """The same with pairs of a window kept apart."""
    rows = P.exemplars(spark, d).where("meeting is not null")
    return matching.agglomerated(rows, 0.35, same_window_pairs(spark, d))


def constraint_counts(spark, d):
    """How many pairs of a window a clustering by label and id merges, of how many, and how many are one speaker's."""
    rows = P.exemplars(spark, d).where("meeting is not null")
    return metrics.constraint_counts(same_window_pairs(spark, d), rows.select("id", (F.col("id") % 3).alias("cluster")), rows.select("id", F.col("speaker_id").alias("speaker")))


def two_voices(spark, d):
    """Speakers whose exemplars are those of two voices."""
    return matching.two_voices(P.exemplars(spark, d)).withColumn("agreement", F.round("agreement", 6))


def enrolment_windows(spark, d):
    """What of each turn may enrol a speaker."""
    found = P.turns(spark, d).select("event_id", V.enrolment_window(F.col("channel"), F.col("start_ms"), F.col("end_ms")).alias("w"))
    return found.where("w is not null").select("event_id", "w.start_ms", "w.end_ms")


def live_observations(spark, d):
    turns = P.turns(spark, d)
    at = F.floor(F.col("start_ms") / 10_000).cast("long")
    seen = turns.select("meeting", "channel", at.alias("window"), F.col("event_id").alias("id"), F.col("cluster").alias("voice"), F.array(F.array("start_ms", "end_ms")).alias("runs"), F.when(F.col("event_id") % 3 != 0, F.array(F.lit(1.0), (F.col("event_id") % 5).cast("double"))).alias("vector"))
    windows = turns.select("meeting", "channel", at.alias("window")).distinct().select("meeting", "channel", (F.col("window") * 10_000).alias("start_ms"), (F.col("window") * 10_000 + 15_000).alias("end_ms"))
    return seen, windows


def live_turns(spark, d):
    """The turns that windows of segmentation agree on."""
    return live.assembled(*live_observations(spark, d))[0]


def enrolment_replay(spark, d):
    """Outcomes of a history replayed meeting by meeting, counted."""
    rows = P.exemplars(spark, d).where("meeting is not null and not is_negative")
    chapters = rows.select(F.lit(0).cast("long").alias("series"), F.col("meeting").alias("chapter"), F.col("id").alias("cluster"), F.col("speaker_id").alias("person"), "vector", (F.col("voiced_ms") * 3 / 1000.0).alias("seconds"))
    return live.replayed(chapters, floor=0.3, margin=0.02).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


S = P.sql
P.SQL["means"] = """means AS (SELECT speaker_id, meeting, n, list(x ORDER BY i) AS v FROM (
  SELECT speaker_id, meeting, i, count(*) AS n, avg(vector[i]) AS x FROM exemplars, range(1, 65) AS r(i) WHERE NOT is_negative AND meeting IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2, 3)"""
P.SQL["gallery"] = """gallery AS (SELECT speaker_id, speaker_id % 2 = 0 AS confirmed, list(x ORDER BY i) AS v FROM (
  SELECT speaker_id, i, sum(vector[i] * voiced_ms) / sum(voiced_ms) AS x FROM exemplars, range(1, 65) AS r(i) WHERE NOT is_negative AND id % 2 = 0 GROUP BY 1, 2) GROUP BY 1)"""
P.SQL["scores"] = """scores AS (SELECT p.meeting, p.id AS cluster, g.speaker_id, g.confirmed, list_cosine_similarity(p.vector, g.v) AS score FROM exemplars p, gallery g WHERE p.id % 2 = 1 AND p.meeting IS NOT NULL)"""
CAP = """(SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY depth, newest DESC) AS turn FROM (
  SELECT *, row_number() OVER (PARTITION BY speaker_id, meeting ORDER BY id DESC) AS depth, max(id) OVER (PARTITION BY speaker_id, meeting) AS newest FROM exemplars))"""

QUERIES = {
    "gallery_scan": (gallery_scan, S("SELECT id, speaker_id FROM exemplars WHERE model = 'model1' AND model_version = '1'", "exemplars")),
    "exemplar_cap": (exemplar_cap, S(f"SELECT speaker_id, id, CAST(turn AS INTEGER) AS turn FROM {CAP} WHERE turn <= 32", "exemplars")),
    "centroid": (centroid, S("""SELECT speaker_id, n, round(v[1] / z, 6) AS x0, round(v[2] / z, 6) AS x1, round(v[3] / z, 6) AS x2, round(v[4] / z, 6) AS x3 FROM (
  SELECT speaker_id, n, v, sqrt(list_dot_product(v, v)) AS z FROM (SELECT speaker_id, n, list(x ORDER BY i) AS v FROM (
    SELECT speaker_id, i, count(*) AS n, sum(vector[i] * voiced_ms) / sum(voiced_ms) AS x FROM (SELECT * FROM exemplars WHERE NOT is_negative QUALIFY row_number() OVER (PARTITION BY speaker_id ORDER BY id DESC) <= 32), range(1, 65) AS r(i) GROUP BY 1, 2) GROUP BY 1, 2))""", "exemplars")),
    "oracle_centroids": (oracle_centroids, S("SELECT speaker_id, meeting, n, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS x0 FROM means", "exemplars", "means")),
    "pair_scores": (pair_scores, S("SELECT meeting, cluster, speaker_id, round(score, 6) AS score FROM scores", "exemplars", "gallery", "scores")),
    "gated_match": (gated_match, S("""SELECT a.meeting, a.cluster, a.speaker_id, round(a.score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY meeting, cluster ORDER BY score DESC, confirmed DESC, speaker_id) AS rank, row_number() OVER (PARTITION BY meeting, speaker_id ORDER BY score DESC, cluster DESC) AS back,
    lead(score) OVER (PARTITION BY meeting, cluster ORDER BY score DESC, confirmed DESC, speaker_id) AS next, lead(confirmed) OVER (PARTITION BY meeting, cluster ORDER BY score DESC, confirmed DESC, speaker_id) AS next_confirmed FROM scores) a
  WHERE rank = 1 AND back = 1 AND score >= 0.3 AND (score - coalesce(next, 0) >= 0.02 OR (confirmed AND NOT coalesce(next_confirmed, true)))""", "exemplars", "gallery", "scores")),
    "match_grid": (match_grid, S("""SELECT id % 8 / 10.0::DOUBLE AS floor, id // 8 / 50.0::DOUBLE AS margin, count(*) FILTER (best >= id % 8 / 10.0::DOUBLE AND best - next >= id // 8 / 50.0::DOUBLE) AS cleared
  FROM (SELECT meeting, cluster, max(score) AS best, coalesce(max(score, 2)[2], 0) AS next FROM scores GROUP BY 1, 2), range(32) AS g(id) GROUP BY id""", "exemplars", "gallery", "scores")),
    "nearest_is_right": (nearest_is_right, S("""SELECT count(*) AS asked, round(avg(CASE WHEN nearest = speaker_id THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS "right" FROM (
  SELECT a.speaker_id, b.speaker_id AS nearest FROM means a JOIN means b ON a.meeting <> b.meeting QUALIFY row_number() OVER (PARTITION BY a.speaker_id, a.meeting ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.speaker_id DESC) = 1)""", "exemplars", "means")),
    "same_window_pairs": (same_window_pairs, S('SELECT a.meeting, a.id // 20 AS "window", a.id, b.id AS other FROM exemplars a JOIN exemplars b ON a.meeting = b.meeting AND a.id // 20 = b.id // 20 AND a.id <> b.id', "exemplars")),
    "constraint_counts": (constraint_counts, S("""SELECT count(*) FILTER (a.speaker_id <> b.speaker_id AND a.id % 3 = b.id % 3) AS merged, count(*) FILTER (a.speaker_id <> b.speaker_id) AS pairs, count(*) FILTER (a.speaker_id = b.speaker_id) AS rejoins
  FROM exemplars a JOIN exemplars b ON a.meeting = b.meeting AND a.id // 20 = b.id // 20 AND a.id < b.id""", "exemplars")),
    "live_turns": (live_turns, None),
    "enrolment_replay": (enrolment_replay, None),
    "agglomerate": (agglomerate, None),
    "agglomerate_constrained": (agglomerate_constrained, None),
    "two_voices": (two_voices, None),
    "enrolment_windows": (enrolment_windows, S("SELECT event_id, start_ms, least(end_ms, start_ms + 10000) AS end_ms FROM turns WHERE channel = 'mic' AND end_ms - start_ms >= 1500", "turns")),
}
