"""Queries on turns, windows and spans of time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.functions import vectors as V
from parlance.operators import intervals, upkeep
from parlance.sources import project as P
from parlance.streaming import fold, machines


def merge_turns(spark, d):
    """Turns of one voice on one channel, joined over gaps of up to 400 ms."""
    return intervals.merged(P.turns(spark, d), "meeting", "channel", "cluster")


def merge_own(spark, d):
    """Each speaker's own overlaps joined."""
    return intervals.merged(P.reference_spans(spark, d), "meeting", "speaker", gap_ms=0)


def regions(spark, d):
    """The stretches of a meeting in which who speaks is constant."""
    both = P.reference_spans(spark, d).unionByName(P.hypothesis_spans(spark, d))
    return intervals.regions(both, "meeting")


def runs_of_frames(spark, d):
    """Runs of neighbouring turns longer than 3 seconds."""
    frames = P.turns(spark, d).select("meeting", (F.col("start_ms") / 1500).cast("long").alias("frame"), (F.col("end_ms") - F.col("start_ms") > 3000).alias("long"))
    return intervals.runs(frames, "meeting", order="frame", flag="long")


def overlap_matrix(spark, d):
    """Time that reference and hypothesis speakers share."""
    return intervals.overlap(P.reference_spans(spark, d), P.hypothesis_spans(spark, d))


def region_cover(spark, d):
    """How many of each side cover each region, in all."""
    ref, hyp = merge_own(spark, d), intervals.merged(P.hypothesis_spans(spark, d), "meeting", "speaker", gap_ms=0)
    area = intervals.regions(ref.unionByName(hyp), "meeting")
    n = lambda spans, name: intervals.covered(area, spans).groupBy("meeting", "start_ms", "end_ms").agg(F.count(F.lit(1)).alias(name))
    both = area.join(n(ref, "references"), ["meeting", "start_ms", "end_ms"], "left").join(n(hyp, "hypotheses"), ["meeting", "start_ms", "end_ms"], "left")
    return both.select("meeting", "start_ms", "end_ms", F.coalesce("references", F.lit(0)).cast("long").alias("references"), F.coalesce("hypotheses", F.lit(0)).cast("long").alias("hypotheses"))


def reconcile_midpoint(spark, d):
    """The turn at each segment's midpoint, and whether its ends belong to different turns."""
    return intervals.reconciled(P.turn_segments(spark, d), P.turns(spark, d))


def reconcile_summary(spark, d):
    """Segments attributed, straddling, and voices, by meeting."""
    rows = reconcile_midpoint(spark, d)
    return rows.groupBy("meeting").agg(F.count("cluster").alias("attributed"), F.count_if("straddles").alias("straddling"), F.countDistinct("cluster").alias("voices"))


def far_end_overlap(spark, d):
    """Microphone turns that no far-end turn overlaps."""
    turns = P.turns(spark, d)
    return intervals.clear_of(turns.where("channel = 'mic'"), turns.where("channel = 'system'"), "meeting", row="event_id").select("event_id", "meeting", "start_ms", "end_ms")


def cluster_voiced(spark, d):
    """Each voice's time and its longest turn, the first of equals."""
    turns = P.turns(spark, d).withColumn("ms", F.col("end_ms") - F.col("start_ms"))
    return turns.groupBy("meeting", "cluster").agg(F.sum("ms").alias("voiced_ms"), F.min_by("event_id", F.struct(-F.col("ms"), "start_ms", "event_id")).alias("longest"))


def voiced_share(spark, d):
    """On each microphone the leading voice, the runner-up and all, where the leader dominates."""
    mine = P.turns(spark, d).where("channel = 'mic'").groupBy("meeting", "cluster").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    order = Window.partitionBy("meeting").orderBy(F.col("ms").desc(), "cluster")
    ranked = mine.withColumn("place", F.row_number().over(order))
    found = ranked.groupBy("meeting").agg(F.max(F.when(F.col("place") == 1, F.col("cluster"))).alias("leader"), F.max(F.when(F.col("place") == 1, F.col("ms"))).alias("leader_ms"), F.max(F.when(F.col("place") == 2, F.col("ms"))).alias("second_ms"), F.sum("ms").alias("total_ms"))
    return found.withColumn("dominant", upkeep.dominates(F.col("leader_ms"), F.col("second_ms"), F.col("total_ms")))


def match_gate(spark, d):
    """Meetings with 30 seconds of speech and two voices."""
    found = P.turns(spark, d).groupBy("meeting").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"), F.countDistinct("cluster").alias("voices"))
    return found.withColumn("open", (F.col("ms") >= 30_000) & (F.col("voices") >= 2))


def unanimity(spark, d):
    """Voices whose segments all have one owner; no owner is dissent."""
    owned = P.turns(spark, d).select("meeting", "cluster", F.when(F.col("event_id") % 4 != 3, F.col("meeting") % 3).alias("owner"))
    found = owned.groupBy("meeting", "cluster").agg(F.collect_set(F.coalesce("owner", F.lit(-1))).alias("owners"))
    return found.where((F.size("owners") == 1) & (F.element_at("owners", 1) >= 0)).select("meeting", "cluster", F.element_at("owners", 1).alias("owner"))


def grid_vote(spark, d):
    """Where at least half of the windows over an instant voted for a voice."""
    turns = P.turns(spark, d)
    votes = turns.select("meeting", F.floor(F.col("start_ms") / 10_000).cast("long").alias("window"), F.col("cluster").alias("voice"), "start_ms", "end_ms")
    windows = turns.select("meeting", F.floor(F.col("start_ms") / 10_000).cast("long").alias("window")).distinct()
    windows = windows.select("meeting", (F.col("window") * 10_000).alias("start_ms"), (F.col("window") * 10_000 + 15_000).alias("end_ms"))
    return intervals.majority(votes, windows)


def turn_order(spark, d):
    """K4: the final order of turns, microphone first among equals."""
    order = Window.partitionBy("meeting").orderBy("start_ms", F.col("channel") == "system", "cluster")
    return P.turns(spark, d).select("event_id", "meeting", F.row_number().over(order).alias("place"))


def enrolled_before(spark, d):
    """In which of a speaker's meetings they had been heard before."""
    heard = P.turns(spark, d).select("cluster", "meeting").distinct()
    first = F.min("meeting").over(Window.partitionBy("cluster"))
    return heard.withColumn("seen_before", F.col("meeting") > first)


def windows_embeddable(spark, d):
    """M9: the part of each turn, made three times as long, that can be embedded."""
    turns = P.turns(spark, d).withColumn("end_ms", F.col("start_ms") + 3 * (F.col("end_ms") - F.col("start_ms")))
    return turns.select("event_id", V.embeddable_window(F.col("start_ms"), F.col("end_ms")).alias("w")).where("w is not null").select("event_id", "w.*")


S = P.sql
MERGED = """(SELECT {keys}, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (
  SELECT *, sum(begins) OVER (PARTITION BY {keys} ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start_ms > max(end_ms) OVER (PARTITION BY {keys} ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 1 ELSE 0 END AS begins FROM {table} WHERE end_ms > start_ms))
  GROUP BY {keys}, island)"""
REF = MERGED.format(keys="meeting, speaker", gap=0, table="reference")
HYP = MERGED.format(keys="meeting, speaker", gap=0, table="hypothesis")
P.SQL["ref"], P.SQL["hyp"] = f"ref AS {REF}", f"hyp AS {HYP}"
P.SQL["area"] = """area AS (SELECT * FROM (SELECT meeting, p AS start_ms, lead(p) OVER (PARTITION BY meeting ORDER BY p) AS end_ms FROM (
  SELECT meeting, start_ms AS p FROM ref UNION SELECT meeting, end_ms FROM ref UNION SELECT meeting, start_ms FROM hyp UNION SELECT meeting, end_ms FROM hyp)) WHERE end_ms IS NOT NULL)"""
P.SQL["covers"] = """covers AS (SELECT a.meeting, a.start_ms, a.end_ms, (SELECT count(*) FROM ref r WHERE r.meeting = a.meeting AND r.start_ms <= a.start_ms AND a.start_ms < r.end_ms) AS "references",
  (SELECT count(*) FROM hyp h WHERE h.meeting = a.meeting AND h.start_ms <= a.start_ms AND a.start_ms < h.end_ms) AS hypotheses FROM area a)"""
SPANS = ("turns", "reference", "hypothesis", "ref", "hyp")
OWNER = "(SELECT min_by(cluster, (t.start_ms, t.end_ms, t.cluster)) FROM turns t WHERE t.meeting = s.meeting AND t.channel = s.channel AND t.start_ms <= {at} AND {at} < t.end_ms)"
P.SQL["reconciled"] = f"""reconciled AS (SELECT meeting, sequence, {OWNER.format(at="s.start_ms + (s.end_ms - s.start_ms) // 2")} AS cluster,
  {OWNER.format(at="s.start_ms")} IS DISTINCT FROM {OWNER.format(at="greatest(s.end_ms - 1, s.start_ms)")} AS straddles FROM turn_segments s)"""

QUERIES = {
    "merge_turns": (merge_turns, S(f"SELECT * FROM {MERGED.format(keys='meeting, channel, cluster', gap=400, table='turns')}", "turns")),
    "merge_own": (merge_own, S("SELECT * FROM ref", "turns", "reference", "ref")),
    "regions": (regions, S("""SELECT * FROM (SELECT meeting, p AS start_ms, lead(p) OVER (PARTITION BY meeting ORDER BY p) AS end_ms FROM (
  SELECT meeting, start_ms AS p FROM reference UNION SELECT meeting, end_ms FROM reference UNION SELECT meeting, start_ms FROM hypothesis UNION SELECT meeting, end_ms FROM hypothesis)) WHERE end_ms IS NOT NULL""", "turns", "reference", "hypothesis")),
    "runs_of_frames": (runs_of_frames, S("""SELECT meeting, min(frame) AS first, max(frame) AS last, count(*) AS n FROM (
  SELECT *, frame - row_number() OVER (PARTITION BY meeting ORDER BY frame) AS run FROM (SELECT meeting, start_ms // 1500 AS frame FROM turns WHERE end_ms - start_ms > 3000)) GROUP BY meeting, run""", "turns")),
    "overlap_matrix": (overlap_matrix, S("""SELECT r.meeting, r.speaker AS left_speaker, h.speaker AS right_speaker, CAST(sum(least(r.end_ms, h.end_ms) - greatest(r.start_ms, h.start_ms)) AS BIGINT) AS ms
  FROM ref r JOIN hyp h ON r.meeting = h.meeting AND r.start_ms < h.end_ms AND h.start_ms < r.end_ms GROUP BY 1, 2, 3""", *SPANS)),
    "region_cover": (region_cover, S('SELECT * FROM covers', *SPANS, "area", "covers")),
    "reconcile_midpoint": (reconcile_midpoint, S("SELECT * FROM reconciled", "segments", "turn_segments", "turns", "reconciled")),
    "reconcile_summary": (reconcile_summary, S("SELECT meeting, count(cluster) AS attributed, count(*) FILTER (straddles) AS straddling, count(DISTINCT cluster) AS voices FROM reconciled GROUP BY meeting", "segments", "turn_segments", "turns", "reconciled")),
    "far_end_overlap": (far_end_overlap, S("""SELECT event_id, meeting, start_ms, end_ms FROM turns m WHERE channel = 'mic' AND NOT EXISTS (
  SELECT 1 FROM turns s WHERE s.channel = 'system' AND s.meeting = m.meeting AND s.end_ms > s.start_ms AND m.start_ms < s.end_ms AND m.end_ms > s.start_ms)""", "turns")),
    "cluster_voiced": (cluster_voiced, S("SELECT meeting, cluster, CAST(sum(end_ms - start_ms) AS BIGINT) AS voiced_ms, min_by(event_id, (start_ms - end_ms, start_ms, event_id)) AS longest FROM turns GROUP BY 1, 2", "turns")),
    "voiced_share": (voiced_share, S("""SELECT meeting, max(CASE WHEN place = 1 THEN cluster END) AS leader, CAST(max(CASE WHEN place = 1 THEN ms END) AS BIGINT) AS leader_ms, CAST(max(CASE WHEN place = 2 THEN ms END) AS BIGINT) AS second_ms, CAST(sum(ms) AS BIGINT) AS total_ms,
  max(CASE WHEN place = 1 THEN ms END) >= 20000 AND max(CASE WHEN place = 1 THEN ms END) / sum(ms) >= 0.8::DOUBLE AND (max(CASE WHEN place = 2 THEN ms END) IS NULL OR (max(CASE WHEN place = 1 THEN ms END) - max(CASE WHEN place = 2 THEN ms END)) / sum(ms) > 0.5::DOUBLE) AS dominant
  FROM (SELECT *, row_number() OVER (PARTITION BY meeting ORDER BY ms DESC, cluster) AS place FROM (SELECT meeting, cluster, sum(end_ms - start_ms) AS ms FROM turns WHERE channel = 'mic' GROUP BY 1, 2)) GROUP BY meeting""", "turns")),
    "match_gate": (match_gate, S('SELECT meeting, CAST(sum(end_ms - start_ms) AS BIGINT) AS ms, count(DISTINCT cluster) AS voices, sum(end_ms - start_ms) >= 30000 AND count(DISTINCT cluster) >= 2 AS "open" FROM turns GROUP BY meeting', "turns")),
    "unanimity": (unanimity, S("SELECT meeting, cluster, min(owner) AS owner FROM (SELECT meeting, cluster, CASE WHEN event_id % 4 <> 3 THEN meeting % 3 ELSE -1 END AS owner FROM turns) GROUP BY 1, 2 HAVING count(DISTINCT owner) = 1 AND min(owner) >= 0", "turns")),
    "grid_vote": (grid_vote, S("""SELECT meeting, voice, min(cell) * 10 AS start_ms, (max(cell) + 1) * 10 AS end_ms FROM (
  SELECT *, cell - row_number() OVER (PARTITION BY meeting, voice ORDER BY cell) AS island FROM (
    SELECT v.meeting, v.voice, v.cell, v.held, w.covers FROM
      (SELECT meeting, voice, cell, count(DISTINCT win) AS held FROM (SELECT meeting, cluster AS voice, start_ms // 10000 AS win, unnest(range(CAST((start_ms + 5) // 10 AS BIGINT), CAST((end_ms + 5) // 10 AS BIGINT))) AS cell FROM turns) GROUP BY 1, 2, 3) v
      LEFT JOIN (SELECT meeting, cell, count(*) AS covers FROM (SELECT meeting, unnest(range(win * 1000, win * 1000 + 1500)) AS cell FROM (SELECT DISTINCT meeting, start_ms // 10000 AS win FROM turns)) GROUP BY 1, 2) w USING (meeting, cell))
    WHERE 2 * held >= coalesce(covers, 0)) GROUP BY meeting, voice, island""", "turns")),
    "turn_order": (turn_order, S("SELECT event_id, meeting, CAST(row_number() OVER (PARTITION BY meeting ORDER BY start_ms, channel = 'system', cluster) AS INTEGER) AS place FROM turns", "turns")),
    "enrolled_before": (enrolled_before, S("SELECT cluster, meeting, meeting > min(meeting) OVER (PARTITION BY cluster) AS seen_before FROM (SELECT DISTINCT cluster, meeting FROM turns)", "turns")),
    "windows_embeddable": (windows_embeddable, S("""SELECT event_id, CASE WHEN n <= 10000 THEN start_ms ELSE start_ms + n // 2 - 5000 END AS start_ms, CASE WHEN n <= 10000 THEN start_ms + n ELSE start_ms + n // 2 + 5000 END AS end_ms
  FROM (SELECT event_id, start_ms, 3 * (end_ms - start_ms) AS n FROM turns) WHERE n >= 1500""", "turns")),
}


def vad_sessions(spark, d):
    """Chunks of speech from frames whose probability is a turn's value."""
    frames = P.table(spark, d, "events").select(F.col("user_id").alias("meeting"), "event_id", (F.col("value") % 10 / 10).alias("p"))
    return fold.folded(frames, ["meeting"], ["event_id"], machines.SpeechChunks, "meeting long, start_ms long, end_ms long, forced boolean")


def noise_floor(spark, d):
    """How many frames of each meeting are speech over an adaptive noise floor."""
    frames = P.turns(spark, d).select("meeting", F.col("start_ms").alias("at_ms"), ((F.col("end_ms") - F.col("start_ms")) / 100_000.0).alias("rms"), (F.col("event_id") % 5 / 10.0).alias("crossings"))
    rows = fold.folded(frames, ["meeting"], ["at_ms"], machines.NoiseFloor, "meeting long, at_ms long, p double")
    return rows.groupBy("meeting").agg(F.count_if(F.col("p") >= 0.5).alias("speech"), F.count(F.lit(1)).alias("frames"))


def policy_replay(spark, d):
    """What is recorded as microphones are held and let go of."""
    events = P.detections(spark, d).withColumn("event_id", F.col("event_id").cast("string"))
    return fold.folded(events, ["session"], ["at_ms"], machines.RecordingPolicy, "session long, at_ms long, action string, subject string")


def joined_channels(spark, d):
    """Both channels of each meeting joined on one clock, late frames trimmed or dropped."""
    frames = P.turns(spark, d).select("meeting", "channel", "start_ms", "end_ms", "event_id")
    return fold.folded(frames, ["meeting"], ["event_id"], machines.TwoChannels, "meeting long, start_ms long, end_ms long, mic_ms long, system_ms long")


def restarts(spark, d):
    """Restarts of a channel that fails, with waits, until its budget is used up."""
    events = P.turns(spark, d).select("meeting", "channel", F.col("start_ms").alias("at_ms"), (F.col("event_id") % 3 == 0).alias("healthy"))
    return fold.folded(events, ["meeting", "channel"], ["at_ms"], machines.Restarts, "meeting long, channel string, at_ms long, action string, wait_s long")


P.SQL["clocked"] = """came AS (SELECT *, row_number() OVER (PARTITION BY meeting ORDER BY event_id) AS i FROM turns),
clock AS (SELECT DISTINCT meeting, 0::BIGINT AS i, 0::BIGINT AS mic, 0::BIGINT AS far, 0::BIGINT AS sent FROM turns
  UNION ALL SELECT meeting, i, mic, far, greatest(sent, greatest(least(mic, far), greatest(mic, far) - 400)) FROM (
    SELECT k.meeting, c.i, CASE WHEN channel = 'mic' THEN greatest(k.mic, c.end_ms) ELSE k.mic END AS mic, CASE WHEN channel = 'system' THEN greatest(k.far, c.end_ms) ELSE k.far END AS far, k.sent FROM clock k JOIN came c ON c.meeting = k.meeting AND c.i = k.i + 1)),
blocks AS (SELECT meeting, i, lag(sent) OVER (PARTITION BY meeting ORDER BY i) AS begins, sent AS ends FROM clock QUALIFY begins < ends
  UNION ALL SELECT meeting, max(i) + 1, max(sent), greatest(max(mic), max(far)) FROM clock GROUP BY meeting HAVING max(sent) < greatest(max(mic), max(far))),
frames AS (SELECT c.meeting, c.i, c.channel, greatest(c.start_ms, k.sent) AS held_from, c.end_ms FROM came c JOIN clock k ON k.meeting = c.meeting AND k.i = c.i - 1)"""
P.SQL["levels"] = """loud AS (SELECT meeting, row_number() OVER (PARTITION BY meeting ORDER BY start_ms) AS n, (end_ms - start_ms) / 100000.0::DOUBLE AS rms, event_id % 5 / 10.0::DOUBLE AS crossings FROM turns),
levels AS (SELECT DISTINCT meeting, 0::BIGINT AS n, NULL::DOUBLE AS rms, NULL::DOUBLE AS crossings, 0.006::DOUBLE AS noise FROM turns
  UNION ALL SELECT l.meeting, f.n, f.rms, f.crossings, CASE WHEN f.rms < l.noise THEN l.noise * 0.9 + f.rms * 0.1 ELSE l.noise * 0.9995 + f.rms * 0.0005 END FROM levels l JOIN loud f ON f.meeting = l.meeting AND f.n = l.n + 1)"""

QUERIES |= {
    "vad_sessions": (vad_sessions, None),
    "noise_floor": (noise_floor, S("""SELECT meeting, count(*) FILTER (CASE WHEN rms < over THEN 0 WHEN crossings > 0.35 THEN 0.2 ELSE greatest(least((rms / over - 1) / 2, 1), 0.55) END >= 0.5) AS speech, count(*) AS frames
  FROM (SELECT *, greatest(0.006::DOUBLE, 2.5 * noise) AS over FROM levels WHERE n > 0) GROUP BY meeting""", "turns", "levels").replace("WITH ", "WITH RECURSIVE ", 1)),
    "policy_replay": (policy_replay, None),
    "joined_channels": (joined_channels, S("""SELECT b.meeting, b.begins AS start_ms, b.ends AS end_ms, CAST(coalesce(sum(greatest(0, least(f.end_ms, b.ends) - greatest(f.held_from, b.begins))) FILTER (f.channel = 'mic'), 0) AS BIGINT) AS mic_ms,
  CAST(coalesce(sum(greatest(0, least(f.end_ms, b.ends) - greatest(f.held_from, b.begins))) FILTER (f.channel = 'system'), 0) AS BIGINT) AS system_ms
  FROM blocks b LEFT JOIN frames f ON f.meeting = b.meeting AND f.i <= b.i AND f.end_ms > f.held_from GROUP BY b.meeting, b.i, b.begins, b.ends""", "turns", "clocked").replace("WITH ", "WITH RECURSIVE ", 1)),
    "restarts": (restarts, S("""SELECT meeting, channel, at_ms, CASE WHEN n > 3 THEN 'end' ELSE 'restart' END AS action, CASE WHEN n > 3 THEN 0 ELSE CAST(pow(2, n - 1) AS BIGINT) END AS wait_s FROM (
  SELECT *, count(*) FILTER (NOT healthy) OVER (PARTITION BY meeting, channel, spell ORDER BY at_ms) AS n FROM (
    SELECT meeting, channel, start_ms AS at_ms, event_id % 3 = 0 AS healthy, count(*) FILTER (event_id % 3 = 0) OVER (PARTITION BY meeting, channel ORDER BY start_ms) AS spell FROM turns)) WHERE NOT healthy""", "turns")),
}
