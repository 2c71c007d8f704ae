"""Queries on the upkeep of the record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.functions import vectors as V
from parlance.operators import registry, rerun, upkeep
from parlance.plans import record, voices
from parlance.sources import project as P
from parlance.streaming import captions, fold


def dominant_voice(spark, d):
    """The voice that has most of a microphone, with a share of 0.3 and a lead of 0.02 here."""
    return upkeep.dominant(P.turns(spark, d), share=0.3, margin=0.02)


def operator_cluster(spark, d):
    """Which voice of each meeting is the operator's, and how that is known."""
    turns = P.turns(spark, d)
    m = F.col("meeting")
    facts = turns.select("meeting").distinct().select("meeting", F.when(m % 3 != 0, m % 3 == 1).alias("mic_isolated"), (m % 7 == 0).alias("enrolled"))
    matches = turns.where("event_id % 40 = 3").select("meeting", "cluster").distinct()
    return upkeep.operator_cluster(turns, facts, matches, share=0.3, margin=0.02)


def assigned_speakers(spark, d):
    """Who each heard voice is, and whom a meeting adds."""
    clusters = P.exemplars(spark, d).where("id % 2 = 1 and meeting is not null").select("meeting", F.col("id").alias("cluster"), F.lit("m").alias("model"), F.lit("1").alias("model_version"), "vector", (F.col("voiced_ms") * 3).alias("voiced_ms"))
    heard = clusters.where("cluster % 5 <> 0").select("meeting", "cluster")
    claims = clusters.where("cluster % 11 = 0").select("meeting", "cluster", (F.col("cluster") % 4).alias("speaker_id"))
    return upkeep.assigned(clusters, heard, voices.gallery(spark, d), claims, floor=0.3, margin=0.02)


def voiceprint_refresh(spark, d):
    """Each speaker's voiceprint in the space of the newest exemplar."""
    made = upkeep.voiceprints(P.exemplars(spark, d))
    return made.select("speaker_id", "model", "model_version", "n", F.round(F.col("vector")[0], 6).alias("x0"))


def relearning_plan(spark, d):
    """C17: what the segments say for and against each speaker that may be learned again."""
    return upkeep.relearning(P.segments(spark, d), replaced_hints(spark, d), P.speakers(spark, d).where(registry.relearnable()))


def replaced_hints(spark, d):
    return P.hints(spark, d).withColumn("replaced_id", F.when(F.col("created_at") % 20 != 1, (F.col("meeting") * 7 + F.col("sequence") * 3) % P.SPEAKERS))


def relearning_owners(spark, d):
    """U4: whose exemplars of which meeting a relearning replaces."""
    return upkeep.relearning_owners(relearning_plan(spark, d), P.exemplars(spark, d), P.speakers(spark, d).where(registry.relearnable()))


def claims(spark, d):
    """Which pairs of segments are all one speaker's, or all taken from one."""
    newest = replaced_hints(spark, d).groupBy("meeting", "sequence").agg(F.max_by(F.struct("speaker_id", "replaced_id"), F.struct("created_at", "id")).alias("h"))
    rows = P.segments(spark, d).join(newest, ["meeting", "sequence"], "left")
    cluster = F.when(F.col("sequence") % 9 != 8, F.floor(F.col("sequence") / 2))
    assigned = rows.select("meeting", cluster.alias("cluster"), F.coalesce("h.speaker_id", "speaker_id").alias("owner"), F.col("h.replaced_id").alias("replaced"))
    return upkeep.claims(assigned, P.speakers(spark, d).where(registry.relearnable()))


def corrections(spark, d):
    """The exemplars that corrections of every sixth segment add."""
    asked = P.segments(spark, d).where("sequence % 6 = 2").select("meeting", "sequence", ((F.col("meeting") + F.col("sequence")) % P.SPEAKERS).alias("speaker_id"))
    return upkeep.corrected(P.segments(spark, d), P.exemplars(spark, d), asked)[1].select("meeting", "sequence", "id", "copy_of", "source", "speaker_id", "is_negative")


def speakers_joined(spark, d):
    """C14: what names each speaker after joins, of which those into nobody, oneself, from a name or of the operator are refused."""
    asked = spark.createDataFrame([(3, 4), (7, 2), (5, 5), (6, 8), (0, 2), (9, 99)], "source long, into long")
    people, segments, hints, exemplars = registry.speakers_joined(P.speakers(spark, d), P.segments(spark, d), replaced_hints(spark, d), P.exemplars(spark, d), asked)
    parts = [(people, "id", "speaker"), (segments, "speaker_id", "segment"), (hints, "speaker_id", "hint"), (hints, "replaced_id", "replaced"), (exemplars, "speaker_id", "exemplar")]
    rows = reduce(DataFrame.unionByName, [frame.select(F.col(c).alias("speaker_id"), F.lit(kind).alias("kind")) for frame, c, kind in parts])
    return rows.where("speaker_id is not null").groupBy("speaker_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def dirty_marking(spark, d):
    """Q1: generations of documents after changes of titles and of file names, new meetings and new segments."""
    now = P.meetings(spark, d)
    before = now.where("id % 8 <> 0")
    after = now.withColumn("title", F.when(F.col("id") % 3 == 1, F.concat(F.lit("New "), F.col("id").cast("string"))).otherwise(F.col("title"))).withColumn("mirror_filename", F.lit("x"))
    dirty = now.where("id % 2 = 0").select(F.col("id").alias("meeting"), (F.col("id") % 4 + 1).alias("generation"), (F.col("id") % 4).alias("acknowledged"))
    return upkeep.marked(dirty, upkeep.changed(before, after).unionByName(P.segments(spark, d).where("sequence % 5 = 0").select("meeting")))


def adopted_vectors(spark, d):
    """Exemplars after a rebuild that gave some a new vector and some none."""
    rows = P.exemplars(spark, d)
    rebuilt = rows.where("model = 'model0'").select("id", F.when(F.col("id") % 3 != 0, V.normalised(F.col("vector"))).alias("vector"), F.lit("model2").alias("model"), F.lit("1").alias("model_version"))
    return upkeep.adopted(rows, rebuilt).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


def forget_voice(spark, d):
    """Exemplars and marks once speaker 4's voice is deleted."""
    people, kept = upkeep.forgotten(P.speakers(spark, d), P.exemplars(spark, d), 4)
    return people.where("forgotten").select("id").join(kept.groupBy("speaker_id").agg(F.count(F.lit(1)).alias("exemplars")), F.col("id") == F.col("speaker_id"), "left").select("id", F.coalesce("exemplars", F.lit(0)).cast("long").alias("exemplars"))


def enrolment_verdicts(spark, d):
    """Which recordings may enrol a voice."""
    turns = P.turns(spark, d).where("cluster in ('click', 'view') and meeting % 2 = 0 or cluster = 'click'")
    peaks = P.turns(spark, d).groupBy("meeting").agg((F.max("event_id") % 3).alias("peak"))
    return upkeep.enrolment(turns, peaks)


def interrupted_ends(spark, d):
    """M3, M4, Q10: when interrupted meetings ended, as seconds after their start."""
    rows = P.meetings(spark, d).where("ended_at is null")
    start = record.seconds(F.col("started_at"))
    last = F.when(F.col("id") % 4 != 1, start + F.col("id") % 900)
    audio = F.when(F.col("audio_path").isNotNull(), F.col("id") * 3 % 700)
    return rows.select("id", (upkeep.interrupted_end(start, last, audio) - start).alias("seconds"))


def leg_verdicts(spark, d):
    """What a test of both channels shows."""
    u = F.col("user_id")
    legs = P.table(spark, d, "events").select("user_id").distinct().select("user_id", F.explode(F.array(F.lit("mic"), F.lit("system"))).alias("channel"))
    system = F.when(F.col("channel") == "system", 1).otherwise(0)
    state = upkeep.leg_state(F.col("channel"), (u + system) % 3, (u + 2 * system) % 4 - 1, F.when(u % 5 != 4, u % 2 == 0))
    dead = upkeep.silent_leg_is_dead(F.col("channel"), u % 4)
    return legs.select("user_id", state.alias("state"), dead.alias("dead")).groupBy("user_id").agg(upkeep.leg_verdict(F.col("state")).alias("verdict"), F.count_if("dead").alias("dead"))


def watchlist(spark):
    return spark.createDataFrame([("com.Meet", "process"), ("us.talk", "process"), ("com.blocked", "process"), ("us.zoom.xos", "process"), ("browsers", upkeep.BROWSER_MEETINGS)], "app string, kind string")


def watched_apps(spark, d):
    """Processes whose app is watched, by name or as a browser, and not blocked."""
    names = ("COM.meet.Helper", "com.meet", "us.talk.helperRenderer.x", "ZOOM.exe", "com.blocked", "com.apple.WebKit.GPU", "com.google.Chrome.helper.GPU", "com.microsoft.teams2.modulehost")
    process = F.element_at(F.array(*map(F.lit, names)), (F.col("user_id") % 8 + 1).cast("int"))
    apps = P.table(spark, d, "events").select("user_id").distinct().select("user_id", upkeep.responsible_app(process).alias("app"))
    listed = lambda *x: spark.createDataFrame([(a,) for a in x], "app string")
    return upkeep.watched(apps, watchlist(spark), listed("com.Blocked"), listed("com.apple.safari", "com.google.chrome"))


def watch_suggestions(spark, d):
    """Apps that users of the events have open and that aren't on the watchlist, which names them with other letters' case."""
    events = P.table(spark, d, "events")
    suggested = events.select(F.concat(F.lit("Com.App"), (F.col("user_id") % 40).cast("string")).alias("app"), F.lit("process").alias("kind")).distinct()
    listed = events.where("event_id % 97 = 0").select(F.concat(F.lit("COM.aPP"), (F.col("user_id") % 40).cast("string")).alias("app")).distinct()
    return upkeep.suggestions(suggested, listed)


def queue_promotion(spark, d):
    """Q5: the queue after requests, some for the front."""
    queue = P.queue(spark, d)
    requests = queue.where("meeting % 5 = 0").select("meeting", (F.col("meeting") % 2).cast("int").alias("priority"), F.expr("enqueued_at + interval 1 day").alias("enqueued_at"))
    return upkeep.enqueued(queue, requests)


def acknowledgement(spark, d):
    """Q3: what is still dirty after a rebuild of older generations."""
    dirty = P.meetings(spark, d).select(F.col("id").alias("meeting"), (F.col("id") % 5).alias("generation"), F.lit(0).cast("long").alias("acknowledged"))
    rebuilt = dirty.where("meeting % 2 = 0").select("meeting", F.least("generation", F.lit(2)).alias("generation"))
    return upkeep.acknowledged(dirty, rebuilt).where("generation > acknowledged")


def suggested_titles(spark, d):
    """Suggested titles, where there is none."""
    return P.meetings(spark, d).select("id", F.coalesce("title", F.concat(F.lit("Suggested "), F.col("id").cast("string"))).alias("title"))


def name_lookup(spark, d):
    """The first speaker of each name that someone types in capitals."""
    typed = P.table(spark, d, "nation").select(F.concat(F.lit("NAME "), F.col("n_nationkey").cast("string")).alias("typed"))
    people = P.speakers(spark, d)
    return typed.join(people, F.lower("typed") == F.lower("display_name")).groupBy("typed").agg(F.min("id").alias("id"))


def id_prefixes(spark, d):
    """Meetings whose id starts with what was typed."""
    rows = P.meetings(spark, d).select("id", F.md5(F.col("id").cast("string")).alias("name"))
    return rows.where(F.regexp_replace(F.lower("name"), "-", "").startswith("a"))


def meeting_by_id(spark, d):
    """One meeting by its id."""
    return P.meetings(spark, d).where("id = 7").select("id", "started_at", "title")


def rerun_backlog(spark, d):
    """A re-run's meetings when one before it was not done."""
    queue = P.queue(spark, d)
    return rerun.backlog(queue.where("meeting % 9 = 0"), queue.where("meeting % 4 = 0"), queue.where("meeting % 5 <> 0"))


def outran_rerun(spark, d):
    """Re-runs of five histories that were not stopped and that a meeting with audio has not seen since, by instant."""
    store = F.col("id") % 5
    seen = F.when(F.col("diarized"), F.col("ended_at")).when(store != 1, F.col("started_at"))
    rows = P.meetings(spark, d).select(store.alias("store"), "audio_path", seen.alias("diarized_at"))
    began = F.concat(F.lit("2024-01-0"), (F.col("id") + 1).cast("string"), F.lit("T00:30:00+05:30"))
    reruns = spark.range(5).select(F.col("id").alias("store"), began.alias("started_at"), (F.col("id") == 4).alias("cancelled"))
    return rerun.outran(rows, reruns, "store").select("store", "started_at")


def rename_preview(spark, d):
    """What renaming speaker 3 to a held name would join."""
    seen = registry.appearances(P.speakers(spark, d), record.heard(spark, d), P.meetings(spark, d))
    return rerun.rename_preview(P.speakers(spark, d), seen, 3, "NAME 4")


def sample_sources(spark, d):
    """K2, K6: what is played of each speaker."""
    return rerun.sample_sources(P.exemplars(spark, d))


def markdown_lines(spark, d):
    """kinds of lines in summaries."""
    line = F.element_at(F.array(*[F.lit(x) for x in ("# Head", "- item", "2. item", "| a | b |", "|---|:-:|", "plain", "  ")]), (F.col("doc_id") % 7 + 1).cast("int"))
    return P.table(spark, d, "documents").select("doc_id", T.block_kind(line).alias("kind"))


def dropped_captions(spark, d):
    """Captions that subscribers with short queues miss."""
    events = P.turns(spark, d).select("meeting", F.col("start_ms").alias("at_ms"), F.when(F.col("event_id") % 3 == 0, "read").otherwise("caption").alias("kind"))
    return fold.folded(events, ["meeting"], ["at_ms"], captions.Subscriber, "meeting long, at_ms long, what string, n long").groupBy("meeting", "what").agg(F.sum("n").alias("n"))


def decode_context(spark, d):
    """The words that each decode has as context, and which are done once more without, since the language changed."""
    rows = P.table(spark, d, "conversations").select(F.col("conv_id").alias("meeting"), F.col("turn").alias("at_ms"), "text", (F.col("turn") / 3).cast("int").cast("string").alias("language"))
    out = fold.folded(rows, ["meeting"], ["at_ms"], captions.Context, "meeting long, at_ms long, context string, again boolean")
    return out.select("meeting", "at_ms", F.md5("context").alias("context"), "again")


S = P.sql
TIME = "(SELECT meeting, cluster, sum(end_ms - start_ms) AS ms FROM turns WHERE channel = 'mic' GROUP BY 1, 2)"
P.SQL["leaders"] = f"""leaders AS (SELECT meeting, cluster FROM (SELECT *, row_number() OVER w AS place, lead(ms) OVER w AS second, sum(ms) OVER (PARTITION BY meeting) AS total FROM {TIME} WINDOW w AS (PARTITION BY meeting ORDER BY ms DESC, cluster))
  WHERE place = 1 AND ms >= 20000 AND ms / total >= 0.3 AND (second IS NULL OR (ms - second) / total > 0.02))"""
P.SQL["newest"] = """newest AS (SELECT *, CASE WHEN created_at % 20 <> 1 THEN (meeting * 7 + sequence * 3) % 11 END AS replaced_id FROM hints QUALIFY row_number() OVER (PARTITION BY meeting, sequence ORDER BY created_at DESC, id DESC) = 1)"""
P.SQL["able"] = "able AS (SELECT id FROM speakers WHERE NOT forgotten AND (display_name IS NOT NULL OR is_operator))"
P.SQL["plan"] = """plan AS (SELECT meeting, sequence, speaker_id, neg AS is_negative FROM (
  SELECT s.meeting, s.sequence, coalesce(h.speaker_id, s.speaker_id) AS speaker_id, false AS neg FROM segments s LEFT JOIN newest h USING (meeting, sequence) WHERE s.end_ms > s.start_ms AND NOT (s.channel = 'mic' AND EXISTS (
    SELECT 1 FROM segments f WHERE f.meeting = s.meeting AND f.channel = 'system' AND f.end_ms > f.start_ms AND f.start_ms < s.end_ms AND f.end_ms > s.start_ms))
  UNION ALL SELECT s.meeting, s.sequence, h.replaced_id, true FROM segments s JOIN newest h USING (meeting, sequence) WHERE s.end_ms > s.start_ms AND h.replaced_id IS NOT NULL AND h.replaced_id <> h.speaker_id)
  WHERE speaker_id IN (SELECT id FROM speakers WHERE NOT forgotten AND (display_name IS NOT NULL OR is_operator)))"""
MATCHED = """SELECT p.meeting, p.cluster, p.speaker_id FROM (
  SELECT *, row_number() OVER (PARTITION BY meeting, cluster ORDER BY score DESC, confirmed DESC, speaker_id) AS rank, row_number() OVER (PARTITION BY meeting, speaker_id ORDER BY score DESC, cluster DESC) AS back,
    lead(score) OVER (PARTITION BY meeting, cluster ORDER BY score DESC, confirmed DESC, speaker_id) AS next, lead(confirmed) OVER (PARTITION BY meeting, cluster ORDER BY score DESC, confirmed DESC, speaker_id) AS next_confirmed FROM scores WHERE cluster % 11 <> 0) p
  WHERE rank = 1 AND back = 1 AND score >= 0.3 AND (score - coalesce(next, 0) >= 0.02 OR (confirmed AND NOT coalesce(next_confirmed, true)))"""

P.SQL["queued"] = """told AS (SELECT meeting, row_number() OVER (PARTITION BY meeting ORDER BY start_ms) AS i, event_id % 3 = 0 AS reads FROM turns),
queued AS (SELECT DISTINCT meeting, 0::BIGINT AS i, 0 AS waiting, 0 AS dropped, 0 AS missed, false AS shown FROM turns
  UNION ALL SELECT q.meeting, t.i, CASE WHEN reads THEN greatest(q.waiting - 1, 0) WHEN q.waiting >= 3 THEN q.waiting ELSE q.waiting + 1 END, CASE WHEN reads THEN q.dropped WHEN q.waiting >= 3 THEN q.dropped + 1 ELSE 0 END,
    q.dropped, NOT reads AND q.waiting < 3 FROM queued q JOIN told t ON t.meeting = q.meeting AND t.i = q.i + 1)"""

QUERIES = {
    "dominant_voice": (dominant_voice, S("SELECT * FROM leaders", "turns", "leaders")),
    "operator_cluster": (operator_cluster, S("""SELECT meeting, CASE WHEN meeting % 7 = 0 THEN CASE WHEN matched IS NOT NULL THEN 'enrolled' ELSE 'nobody' END WHEN meeting % 3 = 1 AND lone IS NOT NULL THEN 'isolated' WHEN leader IS NOT NULL THEN 'dominant' WHEN matched IS NOT NULL AND gate THEN 'recognised' ELSE 'nobody' END AS how,
  CASE WHEN meeting % 7 = 0 THEN matched WHEN meeting % 3 = 1 AND lone IS NOT NULL THEN lone WHEN leader IS NOT NULL THEN leader WHEN gate THEN matched END AS cluster
  FROM (SELECT meeting, sum(end_ms - start_ms) >= 30000 AND count(DISTINCT cluster) >= 2 AS gate, CASE WHEN count(DISTINCT cluster) FILTER (channel = 'mic') = 1 THEN min(cluster) FILTER (channel = 'mic') END AS lone FROM turns GROUP BY meeting)
  LEFT JOIN (SELECT meeting, cluster AS leader FROM leaders) USING (meeting)
  LEFT JOIN (SELECT meeting, min(cluster) AS matched FROM turns t WHERE event_id % 40 = 3 AND EXISTS (SELECT 1 FROM turns o WHERE o.meeting = t.meeting AND o.cluster = t.cluster AND o.channel = 'mic') GROUP BY meeting) USING (meeting)""", "turns", "leaders")),
    "assigned_speakers": (assigned_speakers, S(f"""SELECT e.meeting, e.id AS cluster, m.speaker_id, m.speaker_id IS NULL AS minted FROM exemplars e LEFT JOIN ({MATCHED}) m ON m.meeting = e.meeting AND m.cluster = e.id
  WHERE e.id % 2 = 1 AND e.meeting IS NOT NULL AND e.id % 11 <> 0 AND e.id % 5 <> 0 AND (m.speaker_id IS NOT NULL OR e.voiced_ms * 3 >= 10000)
  UNION ALL SELECT meeting, id, id % 4, false FROM exemplars WHERE id % 2 = 1 AND meeting IS NOT NULL AND id % 11 = 0 AND id % 5 <> 0""", "exemplars", "gallery", "scores")),
    "voiceprint_refresh": (voiceprint_refresh, S("""SELECT speaker_id, model, model_version, n, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS x0 FROM (SELECT speaker_id, model, model_version, n, list(x ORDER BY i) AS v FROM (
  SELECT speaker_id, model, model_version, i, count(*) AS n, sum(vector[i] * voiced_ms) / sum(voiced_ms) AS x FROM (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY speaker_id, meeting ORDER BY id DESC) AS depth, max(id) OVER (PARTITION BY speaker_id, meeting) AS newest FROM (
      SELECT *, max_by((model, model_version), id) OVER (PARTITION BY speaker_id) AS space FROM exemplars) WHERE (model, model_version) = space AND NOT is_negative)
    QUALIFY row_number() OVER (PARTITION BY speaker_id ORDER BY depth, newest DESC) <= 32), range(1, 65) AS r(i) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3, 4)""", "exemplars")),
    "relearning_plan": (relearning_plan, S("SELECT * FROM plan", "segments", "hints", "speakers", "newest", "plan")),
    "relearning_owners": (relearning_owners, S("SELECT meeting, speaker_id FROM plan UNION SELECT meeting, speaker_id FROM exemplars WHERE meeting IS NOT NULL AND speaker_id IN (SELECT id FROM speakers WHERE NOT forgotten AND (display_name IS NOT NULL OR is_operator))", "segments", "hints", "speakers", "newest", "exemplars", "plan")),
    "claims": (claims, S("""SELECT meeting, cluster, claimed, CASE WHEN denied IS DISTINCT FROM claimed THEN denied END AS denied FROM (
  SELECT meeting, cluster, CASE WHEN count(o.id) = count(*) AND count(DISTINCT o.id) = 1 THEN min(o.id) END AS claimed, CASE WHEN count(r.id) = count(*) AND count(DISTINCT r.id) = 1 THEN min(r.id) END AS denied
  FROM (SELECT s.meeting, s.sequence // 2 AS cluster, coalesce(h.speaker_id, s.speaker_id) AS owner, h.replaced_id FROM segments s LEFT JOIN newest h USING (meeting, sequence) WHERE s.sequence % 9 <> 8)
  LEFT JOIN able o ON o.id = owner LEFT JOIN able r ON r.id = replaced_id GROUP BY 1, 2) WHERE claimed IS NOT NULL OR denied IS DISTINCT FROM claimed""", "segments", "hints", "speakers", "newest", "able")),
    "corrections": (corrections, S("""SELECT c.meeting, c.sequence, CAST('0x' || substr(md5(c.meeting || '-' || c.sequence || '-' || e.id || '-' || neg), 1, 15) AS BIGINT) AS id, e.id AS copy_of, 'operator' AS source, CASE WHEN neg THEN c.replaced ELSE c.who END AS speaker_id, neg AS is_negative
  FROM (SELECT meeting, sequence, (meeting + sequence) % 11 AS who, speaker_id AS replaced FROM segments WHERE sequence % 6 = 2) c
  JOIN exemplars e ON e.meeting = c.meeting AND e.speaker_id = c.replaced AND NOT e.is_negative, (VALUES (true), (false)) AS t(neg) WHERE c.replaced <> c.who""", "segments", "exemplars")),
    "speakers_joined": (speakers_joined, S("""SELECT CASE WHEN kind = 'speaker' THEN w WHEN w = 3 THEN 4 WHEN w = 7 THEN 2 ELSE w END AS speaker_id, kind, count(*) AS n FROM (
  SELECT id AS w, 'speaker' AS kind FROM speakers WHERE id NOT IN (3, 7) UNION ALL SELECT speaker_id, 'segment' FROM segments UNION ALL SELECT speaker_id, 'hint' FROM hints
  UNION ALL SELECT CASE WHEN created_at % 20 <> 1 THEN (meeting * 7 + sequence * 3) % 11 END, 'replaced' FROM hints UNION ALL SELECT speaker_id, 'exemplar' FROM exemplars) WHERE w IS NOT NULL GROUP BY 1, 2""", "segments", "hints", "speakers", "exemplars")),
    "dirty_marking": (dirty_marking, S("""SELECT id AS meeting, CASE WHEN id % 2 = 0 THEN id % 4 + 1 ELSE 0 END + CASE WHEN id % 8 = 0 OR id % 3 = 1 THEN 1 ELSE 0 END + coalesce(n, 0) AS generation, CASE WHEN id % 2 = 0 THEN id % 4 ELSE 0 END AS acknowledged FROM meetings
  LEFT JOIN (SELECT meeting, count(*) AS n FROM segments WHERE sequence % 5 = 0 GROUP BY 1) s ON s.meeting = id WHERE id % 2 = 0 OR id % 3 = 1 OR n > 0""", "meetings", "segments")),
    "adopted_vectors": (adopted_vectors, S("SELECT CASE WHEN model = 'model0' THEN 'model2' ELSE model END AS model, count(*) AS n, min(id) AS first FROM exemplars WHERE model <> 'model0' OR id % 3 <> 0 GROUP BY 1", "exemplars")),
    "forget_voice": (forget_voice, S("SELECT id, (SELECT count(*) FROM exemplars e WHERE e.speaker_id = p.id AND p.id <> 4) AS exemplars FROM speakers p WHERE forgotten OR id = 4", "exemplars", "speakers")),
    "enrolment_verdicts": (enrolment_verdicts, S("""SELECT meeting, CASE WHEN peak = 0 THEN 'silent' WHEN voices > 1 THEN 'several-voices' WHEN coalesce(ms, 0) < 20000 THEN 'too-little' ELSE 'accepted' END AS verdict
  FROM (SELECT meeting, max(event_id) % 3 AS peak FROM turns GROUP BY meeting) LEFT JOIN (SELECT meeting, sum(end_ms - start_ms) AS ms, count(DISTINCT cluster) AS voices FROM turns WHERE cluster IN ('click', 'view') AND meeting % 2 = 0 OR cluster = 'click' GROUP BY meeting) USING (meeting)""", "turns")),
    "interrupted_ends": (interrupted_ends, S("SELECT id, greatest(coalesce(audio, written, 0), coalesce(written, 0)) AS seconds FROM (SELECT id, CASE WHEN id % 4 <> 1 THEN id % 900 END AS written, CASE WHEN audio_path IS NOT NULL THEN id * 3 % 700 END AS audio FROM meetings WHERE ended_at IS NULL)", "meetings")),
    "leg_verdicts": (leg_verdicts, """SELECT user_id, CASE WHEN w = 2 THEN 'both-work' WHEN w = 1 AND n = 1 THEN 'microphone-works' WHEN w = 1 THEN 'one-works' WHEN n = 0 THEN 'nothing-captured' ELSE 'nothing-tested' END AS verdict, dead FROM (
  SELECT user_id, count(*) FILTER (state = 'working') AS w, count(*) FILTER (state = 'not-tested') AS n, count(*) FILTER (s = 0 OR user_id % 4 >= 2) AS dead FROM (
    SELECT user_id, s, CASE WHEN (user_id + 2 * s) % 4 - 1 > 0 THEN 'working' WHEN s = 1 AND user_id % 5 <> 4 AND user_id % 2 <> 0 THEN 'not-tested' WHEN (user_id + s) % 3 = 0 THEN 'nothing-captured' ELSE 'silent' END AS state
    FROM (SELECT DISTINCT user_id FROM events), (VALUES (0), (1)) AS t(s)) GROUP BY user_id)"""),
    "watched_apps": (watched_apps, "SELECT user_id, app FROM (SELECT DISTINCT user_id, CASE user_id % 8 WHEN 0 THEN 'COM.meet' WHEN 1 THEN 'com.meet' WHEN 2 THEN 'us.talk' WHEN 3 THEN 'us.zoom.xos' WHEN 5 THEN 'com.apple.Safari' WHEN 6 THEN 'com.google.Chrome' END AS app FROM events) WHERE app IS NOT NULL"),
    "watch_suggestions": (watch_suggestions, "SELECT DISTINCT 'Com.App' || user_id % 40 AS app, 'process' AS kind FROM events WHERE lower('Com.App' || user_id % 40) NOT IN (SELECT lower('COM.aPP' || user_id % 40) FROM events WHERE event_id % 97 = 0)"),
    "queue_promotion": (queue_promotion, S("""SELECT meeting, CAST(CASE WHEN meeting % 10 = 0 THEN 0 ELSE priority END AS INTEGER) AS priority, CASE WHEN meeting % 10 = 0 THEN enqueued_at + INTERVAL 1 DAY ELSE enqueued_at END AS enqueued_at FROM queue""", "queue")),
    "acknowledgement": (acknowledgement, S("SELECT id AS meeting, id % 5 AS generation, CASE WHEN id % 2 = 0 THEN least(id % 5, 2) ELSE 0 END AS acknowledged FROM meetings WHERE id % 5 > CASE WHEN id % 2 = 0 THEN least(id % 5, 2) ELSE 0 END", "meetings")),
    "suggested_titles": (suggested_titles, S("SELECT id, coalesce(title, 'Suggested ' || id) AS title FROM meetings", "meetings")),
    "name_lookup": (name_lookup, S("SELECT 'NAME ' || n_nationkey AS typed, min(id) AS id FROM nation JOIN speakers ON lower('NAME ' || n_nationkey) = lower(display_name) GROUP BY 1", "speakers")),
    "meeting_by_id": (meeting_by_id, S("SELECT id, started_at, title FROM meetings WHERE id = 7", "meetings")),
    "rerun_backlog": (rerun_backlog, S("SELECT meeting FROM queue WHERE meeting % 9 = 0 OR (meeting % 4 = 0 AND meeting % 5 <> 0)", "queue")),
    "outran_rerun": (outran_rerun, S("""SELECT store, started_at FROM (SELECT id AS store, '2024-01-0' || (id + 1) || 'T00:30:00+05:30' AS started_at, id = 4 AS cancelled FROM range(5) AS r(id)) r
  WHERE NOT cancelled AND EXISTS (SELECT 1 FROM (SELECT *, CASE WHEN diarized THEN ended_at WHEN id % 5 <> 1 THEN started_at END AS diarized_at FROM meetings) m
    WHERE m.id % 5 = r.store AND audio_path IS NOT NULL AND (diarized_at IS NULL OR CAST(diarized_at AS TIMESTAMPTZ) < CAST(r.started_at AS TIMESTAMPTZ)))""", "meetings")),
    "rename_preview": (rename_preview, S("SELECT p.id, count(DISTINCT h.meeting) AS meetings FROM speakers p LEFT JOIN heard h ON h.speaker_id = p.id WHERE p.id = 3 OR lower(p.display_name) = 'name 4' GROUP BY p.id", "segments", "hints", "heard", "speakers")),
    "sample_sources": (sample_sources, S("SELECT speaker_id, min(id) AS id, least(min_by(voiced_ms, id), 8000) AS ms FROM exemplars WHERE NOT is_negative GROUP BY speaker_id", "exemplars")),
    "markdown_lines": (markdown_lines, "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'heading' WHEN 1 THEN 'item' WHEN 2 THEN 'item' WHEN 3 THEN 'row' WHEN 4 THEN 'rule' WHEN 5 THEN 'text' END AS kind FROM documents"),
    "dropped_captions": (dropped_captions, S("""SELECT meeting, what, CAST(sum(n) AS BIGINT) AS n FROM (SELECT meeting, 'missed' AS what, missed AS n FROM queued WHERE shown AND missed > 0 UNION ALL SELECT meeting, 'caption', 1 FROM queued WHERE shown) GROUP BY meeting, what""", "turns", "queued").replace("WITH ", "WITH RECURSIVE ", 1)),
    "decode_context": (decode_context, """WITH said AS (SELECT conv_id AS meeting, turn AS at_ms, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '') AS w, turn // 3 AS language FROM conversations),
turned AS (SELECT *, coalesce(language <> lag(language) OVER (PARTITION BY meeting ORDER BY at_ms), false) AS again FROM said), spells AS (SELECT *, sum(CAST(again AS INTEGER)) OVER (PARTITION BY meeting ORDER BY at_ms) AS spell FROM turned)
SELECT meeting, at_ms, md5(CASE WHEN again OR before IS NULL THEN '' ELSE array_to_string(before[-30:], ' ') END) AS context, again
FROM (SELECT *, flatten(list(w) OVER (PARTITION BY meeting, spell ORDER BY at_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS before FROM spells)"""),
    "id_prefixes": (id_prefixes, S("SELECT id, md5(CAST(id AS VARCHAR)) AS name FROM meetings WHERE md5(CAST(id AS VARCHAR)) LIKE 'a%'", "meetings")),
}
