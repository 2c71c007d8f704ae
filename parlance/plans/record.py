"""Queries on meetings, transcripts, speakers and the work queue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.operators import ordering, registry, rerun, transcripts
from parlance.sources import project as P

seconds = lambda c: F.unix_timestamp(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))


def effective(spark, d):
    return transcripts.effective(P.segments(spark, d), P.hints(spark, d))


def labelled(spark, d):
    return transcripts.labelled(effective(spark, d), P.speakers(spark, d))


def meeting_view(spark, d):
    """Meetings with duration, local date, decoded attendees and the title to show."""
    length = seconds(F.col("ended_at")) - seconds(F.col("started_at"))
    date = F.substring("started_at", 1, 10)
    shown = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.when(F.col("detected_app").isNotNull(), F.concat_ws(", ", "detected_app", date)).otherwise(F.concat(F.lit("Meeting, "), date)))
    return P.meetings(spark, d).select("id", "started_at", date.alias("local_date"), F.when(length >= 0, length).alias("seconds"), shown.alias("shown_title"), F.size(registry.json_names("attendees")).cast("long").alias("n_attendees"))


def meeting_list(spark, d):
    """The second page of meetings, newest first by the text of their start."""
    return P.meetings(spark, d).select("id", "started_at").orderBy(F.col("started_at").desc(), F.col("id").desc()).offset(10).limit(50)


def in_progress(spark, d):
    """The newest meeting that has not ended."""
    return P.meetings(spark, d).where("ended_at is null").select("id", "started_at").orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(1)


def never_diarized(spark, d):
    """Ended meetings with audio that no diarization has seen, oldest first."""
    found = P.meetings(spark, d).where("ended_at is not null and audio_path is not null and not diarized")
    return ordering.numbered(found.select("id", "started_at"), "place", "started_at", "id")


def transcript_effective(spark, d):
    """Every segment with its effective speaker and label."""
    return labelled(spark, d).select("meeting", "sequence", "label", F.col("how").alias("attribution"), "start_ms", "text")


def meeting_body(spark, d):
    """The text of each meeting."""
    return transcripts.bodies(P.segments(spark, d))


def speaker_lists(spark, d):
    """The distinct labels of each meeting, by first appearance."""
    return transcripts.speaker_lists(labelled(spark, d))


def rendered_lines(spark, d):
    """F16: transcript lines as a model is shown them."""
    return transcripts.rendered(effective(spark, d), P.speakers(spark, d))


def heard(spark, d):
    return registry.heard_in(P.segments(spark, d), P.hints(spark, d))


def heard_in(spark, d):
    """Meetings of each speaker by any evidence."""
    return heard(spark, d)


def speaker_appearances(spark, d):
    """For all speakers at once, how many meetings they were heard in, the first and the last."""
    return registry.appearances(P.speakers(spark, d), heard(spark, d), P.meetings(spark, d))


def name_suggestions(spark, d):
    """Attendees without a speaker, in order of first sight."""
    return registry.name_suggestions(heard(spark, d), P.meetings(spark, d), P.speakers(spark, d))


def unreferenced_sweep(spark, d):
    """Anonymous speakers that no segment, hint or exemplar names."""
    return registry.unreferenced(P.speakers(spark, d), P.segments(spark, d).select("speaker_id"), P.hints(spark, d).select("speaker_id"), P.exemplars(spark, d).select("speaker_id")).select("id")


def relearnable(spark, d):
    """Speakers whose voice may be learned again."""
    return P.speakers(spark, d).where(registry.relearnable()).select("id")


def stale_identity(spark, d):
    """Exemplars of another model, with audio to make them anew from."""
    return registry.stale(P.exemplars(spark, d), P.meetings(spark, d), "model1", "1").select("id", "speaker_id", "audio_path")


def speaker_join(spark, d):
    """C14: how many segments and hints each speaker has once 3 is joined into 4 and 7 into 2."""
    rows = lambda df: registry.joined({3: 4, 7: 2}, df, "speaker_id").where("speaker_id is not null").groupBy("speaker_id")
    s, h = rows(P.segments(spark, d)).agg(F.count(F.lit(1)).alias("segments")), rows(P.hints(spark, d)).agg(F.count(F.lit(1)).alias("hints"))
    return s.join(h, "speaker_id", "full").select("speaker_id", F.coalesce("segments", F.lit(0)).cast("long").alias("segments"), F.coalesce("hints", F.lit(0)).cast("long").alias("hints"))


def queue_order(spark, d):
    """Each meeting's place in the queue."""
    return ordering.numbered(P.queue(spark, d), "place", "priority", "enqueued_at", "meeting")


def queue_head(spark, d):
    """The next 20 of the queue, left in place."""
    return P.queue(spark, d).orderBy("priority", "enqueued_at", "meeting").limit(20)


def backlog_progress(spark, d):
    """By priority a re-run's total, what is left of it in the queue, what was given up, and what is done."""
    backlog = P.queue(spark, d).where("meeting % 3 = 0").select("priority", "meeting")
    return rerun.progress(backlog, P.queue(spark, d).where("meeting % 4 <> 0"), P.queue(spark, d).where("meeting % 7 = 0"), "priority")


def dirty_batch(spark, d):
    """Q2, Q3, K5: meetings of renamed speakers not yet rebuilt, at most 64 at once."""
    renamed = heard(spark, d).where("speaker_id in (2, 5)").select("meeting").distinct()
    marked = renamed.select("meeting", (F.col("meeting") % 5 + 1).alias("generation"), (F.col("meeting") % 3 + 1).alias("acknowledged"))
    return marked.where("generation > acknowledged").orderBy("meeting").limit(64)


def sequence_append(spark, d):
    """New segments numbered on from each meeting's last."""
    rows = P.segments(spark, d)
    last = rows.groupBy("meeting").agg((F.max("sequence") + 1).alias("next"))
    fresh = rows.where("sequence % 2 = 0")
    number = F.row_number().over(Window.partitionBy("meeting").orderBy("start_ms", "sequence")) - 1
    return fresh.withColumn("n", number).join(last, "meeting").select("meeting", F.col("sequence").alias("source"), (F.col("next") + F.col("n")).alias("sequence"))


def cascade_delete(spark, d):
    """Segments and hints that are left once every fifth meeting is deleted."""
    gone = P.meetings(spark, d).where("id % 5 = 0").select(F.col("id").alias("meeting"))
    s = P.segments(spark, d).join(gone, "meeting", "left_anti").select("meeting", F.lit("segment").alias("kind"))
    h = P.hints(spark, d).join(gone, "meeting", "left_anti").select("meeting", F.lit("hint").alias("kind"))
    return s.unionByName(h).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("meeting").alias("meetings"))


def upsert(spark, d):
    """Enrolments where new rows replace old ones of the same speaker."""
    old = P.exemplars(spark, d).groupBy("speaker_id").agg(F.max("voiced_ms").alias("old_ms"))
    new = P.hints(spark, d).groupBy("speaker_id").agg(F.count(F.lit(1)).alias("new_ms"))
    return old.join(new, "speaker_id", "full").select("speaker_id", F.coalesce("new_ms", "old_ms").alias("duration_ms"), F.col("new_ms").isNotNull().alias("replaced"))


def correction_exemplars(spark, d):
    """What a correction of speaker 1 to 2 in meeting 3 adds: positives for the right one, negatives for the wrong one."""
    base = P.exemplars(spark, d).where("meeting = 3 and speaker_id = 1 and not is_negative")
    return base.select("id", F.lit(2).cast("long").alias("speaker_id"), F.lit(False).alias("is_negative")).unionByName(base.select("id", "speaker_id", F.lit(True).alias("is_negative")))


S = P.sql
LABELS = """named AS (SELECT e.*, p.display_name, coalesce(p.is_operator, false) AS op, e.who IS NOT NULL AND p.display_name IS NULL AND NOT coalesce(p.is_operator, false) AS unnamed,
  bool_or(e.who IS NOT NULL OR e.how IS NOT NULL) OVER (PARTITION BY e.meeting) AS diarized FROM effective e LEFT JOIN speakers p ON p.id = e.who),
numbered AS (SELECT meeting, who, row_number() OVER (PARTITION BY meeting ORDER BY min(sequence)) AS number FROM named WHERE unnamed GROUP BY meeting, who),
labelled AS (SELECT n.*, CASE WHEN n.who IS NULL AND diarized THEN 'Unattributed' WHEN n.who IS NULL THEN CASE WHEN channel = 'mic' THEN 'You' ELSE 'Participants' END
  WHEN display_name IS NOT NULL THEN display_name WHEN op THEN 'You' ELSE 'Speaker ' || number END AS label FROM named n LEFT JOIN numbered USING (meeting, who))"""
P.SQL["labelled"] = LABELS
RECORD = ("segments", "hints", "effective", "speakers", "labelled")
HEARD = ("segments", "hints", "heard")

QUERIES = {
    "meeting_view": (meeting_view, S("""SELECT id, started_at, substr(started_at, 1, 10) AS local_date, CASE WHEN n >= 0 THEN n END AS seconds,
  coalesce(nullif(trim(title), ''), coalesce(detected_app, 'Meeting') || ', ' || substr(started_at, 1, 10)) AS shown_title,
  CASE WHEN attendees LIKE '[%' THEN 2 ELSE 0 END::BIGINT AS n_attendees
  FROM (SELECT *, CAST(epoch(CAST(ended_at AS TIMESTAMPTZ)) - epoch(CAST(started_at AS TIMESTAMPTZ)) AS BIGINT) AS n FROM meetings)""", "meetings")),
    "meeting_list": (meeting_list, S("SELECT id, started_at FROM meetings ORDER BY started_at DESC, id DESC LIMIT 50 OFFSET 10", "meetings")),
    "in_progress": (in_progress, S("SELECT id, started_at FROM meetings WHERE ended_at IS NULL ORDER BY started_at DESC, id DESC LIMIT 1", "meetings")),
    "never_diarized": (never_diarized, S("SELECT id, started_at, row_number() OVER (ORDER BY started_at, id) AS place FROM meetings WHERE ended_at IS NOT NULL AND audio_path IS NOT NULL AND NOT diarized", "meetings")),
    "transcript_effective": (transcript_effective, S("SELECT meeting, sequence, label, how AS attribution, start_ms, text FROM labelled", *RECORD)),
    "meeting_body": (meeting_body, S("SELECT meeting, string_agg(text, chr(10) ORDER BY sequence) AS body FROM segments GROUP BY meeting", "segments")),
    "speaker_lists": (speaker_lists, S("SELECT meeting, string_agg(label, ', ' ORDER BY first, label) AS speakers FROM (SELECT meeting, label, min(sequence) AS first FROM labelled GROUP BY meeting, label) GROUP BY meeting", *RECORD)),
    "rendered_lines": (rendered_lines, S("""SELECT meeting, sequence, '[' || CASE WHEN t >= 3600 THEN (t // 3600) || ':' ELSE '' END || lpad(CAST(t % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') || '] '
  || coalesce(display_name, CASE WHEN channel = 'mic' THEN 'You' ELSE 'Participant' END) || ': ' || trim(coalesce(text, '')) AS line FROM (SELECT *, start_ms // 1000 AS t FROM labelled)""", *RECORD)),
    "heard_in": (heard_in, S("SELECT meeting, speaker_id FROM heard", *HEARD)),
    "speaker_appearances": (speaker_appearances, S("""SELECT p.id, count(DISTINCT h.meeting) AS meetings, min_by(h.meeting, (m.started_at, h.meeting)) AS first_meeting, min(m.started_at) AS first_at,
  max_by(h.meeting, (m.started_at, h.meeting)) AS last_meeting, max(m.started_at) AS last_at FROM speakers p LEFT JOIN heard h ON h.speaker_id = p.id LEFT JOIN meetings m ON m.id = h.meeting GROUP BY p.id""", *HEARD, "meetings", "speakers")),
    "name_suggestions": (name_suggestions, S("""SELECT speaker_id, name, CAST(row_number() OVER (PARTITION BY speaker_id ORDER BY started_at, meeting, position) AS INTEGER) AS place FROM (
  SELECT speaker_id, name, started_at, meeting, position FROM (
    SELECT h.speaker_id, m.started_at, m.id AS meeting, g.i AS position, json_extract_string(m.attendees, '$[' || g.i || ']') AS name FROM heard h JOIN meetings m ON m.id = h.meeting AND m.attendees LIKE '[%', range(2) AS g(i))
  WHERE lower(name) NOT IN (SELECT lower(display_name) FROM speakers WHERE display_name IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY speaker_id, name ORDER BY started_at, meeting, position) = 1)""", *HEARD, "meetings", "speakers")),
    "unreferenced_sweep": (unreferenced_sweep, S("""SELECT id FROM speakers WHERE display_name IS NULL AND NOT confirmed AND NOT is_operator AND NOT EXISTS (SELECT 1 FROM segments s WHERE s.speaker_id = speakers.id)
  AND NOT EXISTS (SELECT 1 FROM hints h WHERE h.speaker_id = speakers.id) AND NOT EXISTS (SELECT 1 FROM exemplars e WHERE e.speaker_id = speakers.id)""", "segments", "hints", "speakers", "exemplars")),
    "relearnable": (relearnable, S("SELECT id FROM speakers WHERE NOT forgotten AND (display_name IS NOT NULL OR is_operator)", "speakers")),
    "stale_identity": (stale_identity, S("SELECT e.id, e.speaker_id, m.audio_path FROM exemplars e LEFT JOIN meetings m ON m.id = e.meeting WHERE e.model IS DISTINCT FROM 'model1' OR e.model_version IS DISTINCT FROM '1'", "exemplars", "meetings")),
    "speaker_join": (speaker_join, S("""SELECT coalesce(s.w, h.w) AS speaker_id, coalesce(s.n, 0) AS segments, coalesce(h.n, 0) AS hints
  FROM (SELECT CASE speaker_id WHEN 3 THEN 4 WHEN 7 THEN 2 ELSE speaker_id END AS w, count(*) AS n FROM segments WHERE speaker_id IS NOT NULL GROUP BY 1) s
  FULL JOIN (SELECT CASE speaker_id WHEN 3 THEN 4 WHEN 7 THEN 2 ELSE speaker_id END AS w, count(*) AS n FROM hints GROUP BY 1) h ON s.w = h.w""", "segments", "hints")),
    "queue_order": (queue_order, S("SELECT meeting, priority, enqueued_at, row_number() OVER (ORDER BY priority, enqueued_at, meeting) AS place FROM queue", "queue")),
    "queue_head": (queue_head, S("SELECT meeting, priority, enqueued_at FROM queue ORDER BY priority, enqueued_at, meeting LIMIT 20", "queue")),
    "backlog_progress": (backlog_progress, S("""SELECT priority, count(*) AS total, count(*) FILTER (meeting % 4 <> 0) AS remaining, count(*) FILTER (meeting % 4 = 0 AND meeting % 7 = 0) AS abandoned, count(*) FILTER (meeting % 4 = 0 AND meeting % 7 <> 0) AS done
  FROM queue WHERE meeting % 3 = 0 GROUP BY priority""", "queue")),
    "dirty_batch": (dirty_batch, S("SELECT meeting, meeting % 5 + 1 AS generation, meeting % 3 + 1 AS acknowledged FROM (SELECT DISTINCT meeting FROM heard WHERE speaker_id IN (2, 5)) WHERE meeting % 5 > meeting % 3 ORDER BY meeting LIMIT 64", *HEARD)),
    "sequence_append": (sequence_append, S("""SELECT meeting, sequence AS source, last + row_number() OVER (PARTITION BY meeting ORDER BY start_ms, sequence) AS sequence
  FROM (SELECT *, max(sequence) OVER (PARTITION BY meeting) AS last FROM segments) WHERE sequence % 2 = 0""", "segments")),
    "cascade_delete": (cascade_delete, S("""SELECT kind, count(*) AS n, count(DISTINCT meeting) AS meetings FROM (SELECT meeting, 'segment' AS kind FROM segments UNION ALL SELECT meeting, 'hint' FROM hints) WHERE meeting % 5 <> 0 GROUP BY kind""", "segments", "hints")),
    "upsert": (upsert, S("""SELECT coalesce(o.speaker_id, n.speaker_id) AS speaker_id, coalesce(n.c, o.m) AS duration_ms, n.c IS NOT NULL AS replaced
  FROM (SELECT speaker_id, max(voiced_ms) AS m FROM exemplars GROUP BY 1) o FULL JOIN (SELECT speaker_id, count(*) AS c FROM hints GROUP BY 1) n ON o.speaker_id = n.speaker_id""", "exemplars", "hints")),
    "correction_exemplars": (correction_exemplars, S("SELECT id, CAST(CASE WHEN neg THEN 1 ELSE 2 END AS BIGINT) AS speaker_id, neg AS is_negative FROM exemplars, (VALUES (true), (false)) AS t(neg) WHERE meeting = 3 AND speaker_id = 1 AND NOT is_negative", "exemplars")),
}
