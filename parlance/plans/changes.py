"""Queries on tables that change: what streams write, what a history publishes, what diarized meetings leave, and a re-run's life.

Each query lays the changes out from the given tables, commits them in a scratch folder as a caller would, and returns what is there then.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import vectors as V
from parlance.operators import documents, lifecycle, live, matching, persisting, recognition, registry, transcripts, upkeep
from parlance.plans import record, voices
from parlance.plans import upkeep as upkeep_plans
from parlance.plans.speech import MERGED
from parlance.sources import calendar, files
from parlance.sources import project as P
from parlance.sources.history import History
from parlance.sources.versions import Versions, kept, scratch
from parlance.streaming import fold, machines, segments, sound, writer

PARTS = 3


def arriving(spark, d):
    return P.segments(spark, d).select("meeting", "channel", "start_ms", "end_ms", "text", F.col("sequence").alias("arrived"), (F.col("sequence") % PARTS).alias("part"))


def written(spark, d, between=lambda tables: None) -> Versions:
    """All segments in three lots, each of which the stream finds when it is started again; the last lot is then written once more."""
    tables, inbox, checkpoint = Versions(spark, scratch(spark, "record")), scratch(spark, "inbox"), scratch(spark, "offsets")
    rows = spark.createDataFrame([], arriving(spark, d).drop("part").schema)
    for part in range(PARTS):
        rows = arriving(spark, d).where(F.col("part") == part).drop("part")
        rows.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(rows.schema).parquet(inbox)
        writer.writing(stream, tables, checkpoint).trigger(availableNow=True).start().awaitTermination()
        if part == 0:
            between(tables)
    writer.write_batch(tables, rows, PARTS - 1)
    return tables


def transcript_written(spark, d):
    """Segments as the stream's writer numbers them, over restarts and a batch that comes twice."""
    return written(spark, d).table("segments", writer.SEGMENTS).select("meeting", "sequence", "start_ms", "channel", "batch")


def caption_subscription(spark, d):
    """What a subscriber has at once, and what it gets as the writer goes on."""
    found = {}
    tables = written(spark, d, lambda tables: found.update(zip(("now", "later", "cut"), tables.subscribed("segments", writer.SEGMENTS), strict=True)))
    out = scratch(spark, "heard")
    found["later"].writeStream.option("checkpointLocation", scratch(spark, "offsets")).trigger(availableNow=True).start(out, format="parquet").awaitTermination()
    later = spark.read.schema(found["later"].schema).parquet(out)
    part = lambda df, how: df.select("meeting", "sequence", "start_ms", F.lit(how).alias("how"))
    return part(found["now"], "snapshot").unionByName(part(later, "delta"))


RATE = 10


def sample_frames(spark, d):
    """Frames of up to 1.5 s at 10 samples a second, one each event."""
    n = (F.floor(F.col("value") * 100).cast("int") % 15) + 1
    turns = P.turns(spark, d).join(P.table(spark, d, "events").select("event_id", "value"), "event_id")
    return turns.select("meeting", "channel", "event_id", F.col("start_ms").alias("offset_ms"), F.array_repeat((F.col("event_id") % 7 + 1).cast("float"), n).alias("samples"))


def joined_samples(spark, d):
    """Both channels of each meeting as samples on one clock, silence where nothing was delivered."""
    rows = fold.folded(sample_frames(spark, d), ["meeting"], ["event_id"], lambda: machines.JoinedSamples(RATE), "meeting long, start_ms long, mic array<float>, system array<float>")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    silent = lambda c: F.size(F.filter(c, lambda x: x == 0))
    return rows.groupBy("meeting").agg(
        F.sum(F.size("mic")).alias("samples"), F.sum(total("mic")).alias("mic"), F.sum(total("system")).alias("system"),
        F.sum(silent("mic")).cast("long").alias("mic_silent"), F.sum(silent("system")).cast("long").alias("system_silent"),
    )


def by_meeting(turns: DataFrame) -> DataFrame:
    """Turns dealt and sorted by meeting before samples are made of them, so that no shuffle and no sort carries samples.

    By a number of partitions, since Spark would join those of a few bytes that are much work.
    """
    return turns.repartition(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), "meeting").sortWithinPartitions("meeting")


ECHO_RATE, SPOKEN_MS = 1_000, 300


def echoing_frames(spark, d):
    """300 ms a turn at 1000 samples a second: noise from the far end, and of it what a room gives back to the microphone, 3 and 7 ms later."""
    i = F.sequence(F.lit(0), F.lit(SPOKEN_MS - 1))
    noise = lambda k: F.when((k >= 8) & (k < SPOKEN_MS - 8), F.pmod(F.xxhash64("event_id", k), F.lit(2001)) / 1000.0 - 1).otherwise(0.0)
    rows = by_meeting(P.turns(spark, d).select("event_id", "meeting", "start_ms")).select("meeting", F.col("start_ms").alias("at_ms"), F.transform(i, noise).alias("far"))
    back = lambda k, ms: F.when(k >= ms, F.get("far", k - ms)).otherwise(0.0)
    return rows.select("meeting", "at_ms", F.transform(i, lambda k: 0.5 * back(k, 3) - 0.2 * back(k, 7)).alias("near"), "far")


class Removed(sound.EchoFilter):
    """The echo filter, with the samples measured and not handed on. Rows: at_ms, before, after, n."""

    def on(self, event: dict) -> list[tuple]:
        power = lambda x: float(np.sqrt((x * x).sum(dtype=np.float64)))
        return [(at, power(np.asarray(event["near"], np.float64)), power(np.asarray(samples, np.float32)), len(samples)) for at, samples in super().on(event)]


def echo_removed(spark, d):
    """Whether 30 dB of each meeting's echo go once the filter has learned the room, and whether a turn ever comes out louder.

    Samples are made after the turns are dealt by meeting and measured where they are filtered: no shuffle, join or row of a result holds them.
    """
    both = fold.folded(echoing_frames(spark, d), ["meeting"], ["at_ms"], lambda: Removed(ECHO_RATE), "meeting long, at_ms long, before double, after double, n int")
    learned = F.col("at_ms") >= 15_000
    return both.groupBy("meeting").agg(F.sum("n").alias("samples"), (V.echo_loss_db(F.when(learned, F.col("before")), F.when(learned, F.col("after"))) >= 30).alias("clean"), F.count_if(F.col("after") > F.col("before") * (1 + 1e-6)).alias("louder"))


def resampled_frames(spark, d):
    """Samples of each turn at 25 in place of 10 a second."""
    return sample_frames(spark, d).select("event_id", F.size(V.resampled_column(F.col("samples"), RATE, 25)).alias("n"), F.round(F.aggregate(V.resampled_column(F.transform("samples", lambda x, i: (x * (i + 1)).cast("double")), RATE, 25), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


SOUND_RATE = 250


def told_by_length(samples, context):
    """Stands in for a recogniser: what it hears is how long and how loud the sound is."""
    n = len(samples)
    return f"{n} samples {'after ' + context.split()[0] if context else 'first'}", 0.1 if n % 7 == 0 else 0.9, "en" if n % 2 else "fr"


def sounding_frames(spark, d):
    """A tone of each turn's first second, loud or soft, every fourth turn silent."""
    turns = by_meeting(P.turns(spark, d).select("event_id", "meeting", "channel", "start_ms"))
    loud = F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(0.05 + (F.col("event_id") % 5) / 20)
    samples = F.transform(F.sequence(F.lit(0), F.lit(SOUND_RATE - 1)), lambda i: (loud * F.sin(i * 0.35)).cast("float"))
    return turns.select("meeting", "channel", F.col("start_ms").alias("offset_ms"), samples.alias("samples"))


def segment_stream(spark, d):
    """What is kept of the speech in each meeting's sound, from one clock to cleaned text. Echo is another query's."""
    rows = fold.folded(sounding_frames(spark, d), ["meeting"], ["offset_ms", "channel"], lambda: segments.SegmentStream(told_by_length, SOUND_RATE, cancel=False), segments.DECODED)
    return transcripts.understood(rows)


def rttm_round_trip(spark, d):
    """Turns written as RTTM and read back: each speaker's turns merged over gaps of up to 400 ms, those without length left out."""
    path = scratch(spark, "rttm")
    files.write_rttm(P.reference_spans(spark, d).withColumn("end_ms", F.when(F.col("end_ms") % 11 == 0, F.col("start_ms")).otherwise(F.col("end_ms"))), path)
    return files.read_rttm(spark, path)


def observations_round_trip(spark, d):
    """Observations dumped as JSON lines and read back."""
    path = scratch(spark, "observations")
    turns = P.turns(spark, d)
    run = F.array(F.array("start_ms", "end_ms"))
    vector = F.when(F.col("event_id") % 3 != 0, F.array((F.col("event_id") % 5).cast("float"), F.lit(0.5).cast("float")))
    files.write_observations(turns.select("channel", run.alias("runs"), F.when(F.col("event_id") % 2 == 0, run).otherwise(F.array().cast("array<array<bigint>>")).alias("clean"), vector.alias("vector")), path)
    rows = files.read_observations(spark, path)
    length = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0])
    return rows.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.sum(length("runs")).alias("ms"), F.sum(length("clean")).alias("clean_ms"), F.count("vector").alias("vectors"), F.sum(F.col("vector")[0].cast("double")).alias("x0"))


def powerset_speakers(spark, d):
    """Which local speakers each frame's classes name, the last of equal scores deciding."""
    scores = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: ((F.col("event_id") * 31 + i * 17) % 5).cast("double"))
    return P.table(spark, d, "events").select("event_id", F.array_join(live.speakers_of(scores).cast("array<string>"), ",").alias("speakers"))


def silence_thresholds(spark, d):
    """The limit of silence at each turn's age."""
    return P.turns(spark, d).select("event_id", F.round(V.silence_threshold(F.col("end_ms") * 1.0 - F.col("start_ms") + F.col("event_id") % 20_000), 6).alias("threshold"))


def speaker_fragments(spark, d):
    """Up to two speakers that a piece of an id means, wherever it stands."""
    ids = P.exemplars(spark, d).select(F.concat_ws("-", F.substring(F.md5(F.col("id").cast("string")), 1, 8), F.substring(F.md5(F.col("id").cast("string")), 9, 24)).alias("id"))
    return registry.resolve(ids.orderBy("id"), "A-bCd", anywhere=True).agg(F.count(F.lit(1)).alias("hits"), F.bool_and(F.regexp_replace("id", "-", "").contains("abcd")).alias("fits"))


def live_voices(spark, d):
    """The voices of each meeting, with the mean of what their observations lend."""
    made = live.assembled(*voices.live_observations(spark, d))[1]
    return made.select("meeting", "cluster", "n", "voiced_ms", F.round(F.col("vector")[0], 6).alias("x0"))


def speakers_renamed(spark, d):
    """Names after the odd voices that were heard got new ones, some of which even ones hold, and some of these mean that both are one."""
    who = P.exemplars(spark, d).select(F.col("speaker_id").alias("id")).distinct().where("id % 2 = 1")
    name = F.when(F.col("id") % 4 == 1, F.concat(F.lit("Voice "), F.col("id").cast("string"))).otherwise(F.concat(F.lit("nAME "), (F.col("id") + 1).cast("string")))
    named, joins, refused = registry.renamed(P.speakers(spark, d), who.select("id", name.alias("name"), (F.col("id") % 8 == 3).alias("joining")))
    flat = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), F.col(a).alias("id"), F.col(b).cast("string").alias("what"))
    return flat(named.where("confirmed"), "named", "id", "display_name").unionByName(flat(joins, "join", "source", "into")).unionByName(flat(refused, "refused", "id", "held_by"))


def history_population(spark, d):
    """In which meetings a speaker had been heard, or enrolled, before, in the order of the history."""
    heard = P.segments(spark, d).where("speaker_id is not null").select("meeting", F.col("speaker_id").alias("person"), (F.col("end_ms") - F.col("start_ms")).alias("ms"))
    return live.population(heard, P.meetings(spark, d))


def speakers_by_id(spark, d):
    """S3: the speakers that evidence names, in order of their ids."""
    return P.speakers(spark, d).join(P.exemplars(spark, d).select(F.col("speaker_id").alias("id")).distinct(), "id", "left_semi").select("id", "display_name").orderBy("id")


def recognition_scores(spark, d):
    rows = P.exemplars(spark, d).where("meeting is not null")
    prints = matching.means(rows, "speaker_id", "meeting", weighted=False)
    return recognition.scored(prints.select((F.col("meeting") % 2).alias("series"), "meeting", F.col("speaker_id").alias("person"), "vector"))


def recognition_probes(spark, d):
    """Each returning person's score with themselves in other meetings of the series, and the best with somebody else."""
    return recognition.probes(recognition_scores(spark, d)).select("series", "meeting", "person", F.round("correct", 6).alias("correct"), F.round("others", 6).alias("others"))


def recognition_grid(spark, d):
    """What share of returning people, and of impostors' scores, each floor and margin lets through."""
    found = recognition.grid(recognition_scores(spark, d), floors=(0.0, 0.1, 0.2, 0.4), margins=(0.0, 0.05, 0.1))
    return found.select("floor", "margin", F.round("recognized", 6).alias("recognized"), F.round("false_above", 6).alias("false_above"))


def made_documents(spark, d):
    length = record.seconds(F.col("ended_at")) - record.seconds(F.col("started_at"))
    meetings = P.meetings(spark, d).withColumn("attendees", registry.json_names("attendees")).withColumn("seconds", F.when(length >= 0, length))
    return documents.documents(meetings, record.labelled(spark, d), F.md5(F.col("meeting").cast("string")))


def documents_rendered(spark, d):
    """The document of each meeting, by digest."""
    return made_documents(spark, d).select("meeting", "name", F.md5("markdown").alias("markdown"), "title")


def published(spark, d) -> History:
    """All documents; then every ninth meeting retitled, which moves its document, and every tenth deleted."""
    history = History(Versions(spark, scratch(spark, "history")))
    rows = made_documents(spark, d)
    history.publish(rows)
    new = rows.where("meeting % 9 = 4").withColumn("title", F.lit("Renamed plan")).withColumn("name", F.concat(F.lit("renamed-"), F.col("name")))
    history.publish(new, P.meetings(spark, d).where("id % 10 = 3").select(F.col("id").alias("meeting")))
    return history


def documents_published(spark, d):
    """Names and lengths of the documents there are, after some were retitled and some deleted."""
    return published(spark, d).documents().select("meeting", "name", "words")


def stored_search(spark, d):
    """A search of the stored index, by folders of its words."""
    history = published(spark, d)
    history.folded()
    return history.search("Plan THE")


FLOOR, MARGIN = 0.3, 0.02


def voices_of(spark, d):
    """The record before meetings 0 to 4 are diarized, with what was found in them."""
    rows = P.exemplars(spark, d).withColumn("source", F.when(F.col("id") % 3 == 0, "operator").otherwise("machine"))
    held = rows.where("id % 2 = 0")
    before = persisting.Record(P.speakers(spark, d).drop("model", "model_version"), held, kept(upkeep.voiceprints(held), "prints"))
    clusters = rows.where("id % 2 = 1 and meeting < 5").select("meeting", F.col("id").alias("cluster"), F.lit("model0").alias("model"), F.lit("1").alias("model_version"), "vector", (F.col("voiced_ms") * 3).alias("voiced_ms"))
    heard = clusters.where("cluster % 5 <> 0").select("meeting", "cluster")
    claims = clusters.where("cluster % 11 = 0").select("meeting", "cluster", (F.col("cluster") % 4).alias("speaker_id"))
    gates = clusters.select("meeting").distinct().select("meeting", (F.col("meeting") % 2 == 0).alias("gate"), (F.col("meeting") == 3).alias("enrolled"))
    reseeded = clusters.select("meeting").distinct().select("meeting", F.lit(4).cast("long").alias("speaker_id"))
    return before, (clusters, heard, claims, persisting.withheld(before.speakers, gates), reseeded)


def diarized(spark, d):
    before, found = voices_of(spark, d)
    return persisting.persisted(before, *found, run=1 << 41, floor=FLOOR, margin=MARGIN)


def diarized_meetings(spark, d):
    """Who is heard in five meetings, and speakers, evidence and prints after that."""
    after, assigned = diarized(spark, d)
    none = lambda kind: F.lit(None).cast(kind)
    parts = [
        assigned.select(F.lit("assigned").alias("kind"), "meeting", "cluster", "speaker_id", F.col("minted").cast("long").alias("n"), none("double").alias("x0")),
        after.exemplars.groupBy("meeting", "speaker_id", "source").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("evidence-"), "source").alias("kind"), "meeting", none("long").alias("cluster"), "speaker_id", "n", none("double").alias("x0")),
        after.prints.select(F.lit("print").alias("kind"), none("long").alias("meeting"), none("long").alias("cluster"), "speaker_id", "n", F.round(F.col("vector")[0], 5).alias("x0")),
        after.speakers.select(F.lit("speaker").alias("kind"), none("long").alias("meeting"), none("long").alias("cluster"), F.col("id").alias("speaker_id"), F.lit(1).cast("long").alias("n"), none("double").alias("x0")),
    ]
    return reduce(DataFrame.unionByName, parts)


def operator_attached(spark, d):
    """What names each speaker once every eighth voice is the operator's."""
    after, assigned = diarized(spark, d)
    found = assigned.where("cluster % 8 = 1").select("meeting", "cluster")
    after, segments, hints = persisting.attached(after, P.segments(spark, d), upkeep_plans.replaced_hints(spark, d), assigned, found)
    parts = [(after.speakers, "id", "speaker"), (after.speakers.where("is_operator"), "id", "operator"), (segments, "speaker_id", "segment"), (hints, "speaker_id", "hint"), (after.exemplars, "speaker_id", "exemplar"), (after.prints, "speaker_id", "print")]
    rows = reduce(DataFrame.unionByName, [frame.select(F.col(c).alias("speaker_id"), F.lit(kind).alias("kind")) for frame, c, kind in parts])
    return rows.where("speaker_id is not null").groupBy("speaker_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def model_wiped(spark, d):
    """Prints after a change of model, and once vectors have been made anew from the audio that is there."""
    before, _ = voices_of(spark, d)
    empty = persisting.wiped(before)
    rebuilt = before.exemplars.where("meeting % 5 <> 3").select("id", F.expr("reverse(vector)").alias("vector"), F.lit("model9").alias("model"), F.lit("1").alias("model_version"))
    gone = before.exemplars.where("meeting is null or meeting % 5 = 3").select("id", F.lit(None).cast("array<double>").alias("vector"), F.lit("model9").alias("model"), F.lit("1").alias("model_version"))
    again = persisting.adopted(persisting.Record(before.speakers, before.exemplars, empty.prints), rebuilt.unionByName(gone))
    step = lambda r, name: r.prints.select(F.lit(name).alias("step"), "speaker_id", "model", "n", F.round(F.col("vector")[0], 5).alias("x0"))
    return step(empty, "wiped").unionByName(step(again, "rebuilt"))


T0, T1, T2, T3 = ("2024-05-01 00:00:00", "2024-05-02 00:00:00", "2024-05-03 00:00:00", "2024-05-04 00:00:00")


def rerun_lifecycle(spark, d):
    """The queue and the account of a re-run over all orders, some done, given up, deleted or asked for at the front."""
    work = lifecycle.Work(Versions(spark, scratch(spark, "work")))
    rows = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("meeting"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("started_at"), F.when(F.col("o_custkey") % 3 != 0, "a").alias("audio_path"))
    work.enqueue(rows.where("meeting % 10 = 0"), lifecycle.BACK, T0)
    work.enqueue(rows.where("meeting % 25 = 0"), lifecycle.FRONT, T1)
    work.begin("m2", "1", rows, T2)
    work.finish(rows.where("meeting % 4 = 1").select("meeting", F.lit("m2").alias("model"), F.lit("1").alias("model_version")), T3)
    work.give_up(rows.where("meeting % 7 = 3"))
    work.delete(rows.where("meeting % 11 = 5"))
    work.enqueue(rows.where("meeting % 13 = 6"), lifecycle.FRONT, T3)
    a = work.account()
    counts = {"total": a.total, "remaining": a.remaining, "abandoned": a.abandoned, "done": a.done}
    return work.queue().select("meeting", "priority", "enqueued_at", *[F.lit(n).cast("long").alias(c) for c, n in counts.items()])


POLL_MS = 5_000


def calendar_changes(spark, d):
    """Meetings that polls of each user's calendar announce and end, by a stream that is stopped halfway and started again."""
    turns, e = P.turns(spark, d), F.col("event_id")
    entries = turns.select(
        F.col("meeting").alias("calendar"), e.cast("string").alias("id"), F.when(e % 4 == 0, " ").otherwise(F.col("cluster")).alias("title"), F.array("channel").alias("attendees"),
        F.col("start_ms").alias("starts_ms"), F.col("end_ms").alias("ends_ms"), (e % 29 == 0).alias("all_day"), (e % 13 == 0).alias("declined"),
    )
    last = entries.agg(F.max("ends_ms")).first()[0] or 0
    out, offsets = scratch(spark, "changes"), scratch(spark, "offsets")
    for until in (last // 2, last + POLL_MS):
        found = calendar.changes(calendar.polls(spark, poll_ms=POLL_MS, until_ms=until), entries)
        found.writeStream.option("checkpointLocation", offsets).trigger(availableNow=True).start(out, format="parquet").awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


S = P.sql
SPOKEN = ("segments", "hints", "effective", "speakers", "labelled")
P.SQL["told"] = """told AS (SELECT meeting, string_agg('**' || label || '** (' || CASE WHEN t >= 3600 THEN lpad(CAST(t // 3600 AS VARCHAR), 2, '0') || ':' ELSE '' END || lpad(CAST(t % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0')
    || ') ' || trim(coalesce(text, '')) || chr(10) || chr(10), '' ORDER BY sequence) AS spoken, string_agg(coalesce(text, ''), chr(10) ORDER BY sequence) AS body FROM (SELECT *, start_ms // 1000 AS t FROM labelled) GROUP BY meeting),
named_by AS (SELECT meeting, string_agg(label, ', ' ORDER BY first, label) AS speakers FROM (SELECT meeting, label, min(sequence) AS first FROM labelled GROUP BY meeting, label) GROUP BY meeting),
shown AS (SELECT *, coalesce(CASE WHEN trim(title) <> '' THEN title END, coalesce(detected_app, 'Meeting') || ', ' || substr(started_at, 1, 10)) AS heading,
  substr(started_at, 1, 10) || '-' || regexp_replace(regexp_replace(lower(coalesce(nullif(trim(title), ''), detected_app, 'meeting')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || right(md5(CAST(id AS VARCHAR)), 12) || '.md' AS name,
  CAST(epoch(CAST(ended_at AS TIMESTAMPTZ)) - epoch(CAST(started_at AS TIMESTAMPTZ)) AS BIGINT) AS n FROM meetings),
documents_of AS (SELECT id AS meeting, name, coalesce(title, coalesce(detected_app, 'Meeting') || ', ' || substr(started_at, 1, 10)) AS title, coalesce(body, '') AS body,
  '---' || chr(10) || 'id: ' || id || chr(10) || 'date: ' || started_at || chr(10) || coalesce('app: ' || detected_app || chr(10), '')
  || CASE WHEN n >= 3600 THEN 'duration: ' || (n // 3600) || 'h ' || (n % 3600 // 60) || 'm' || chr(10) WHEN n >= 60 THEN 'duration: ' || (n // 60) || 'm' || chr(10) WHEN n >= 0 THEN 'duration: ' || n || 's' || chr(10) ELSE '' END
  || 'speakers: [' || coalesce(speakers, '') || ']' || chr(10) || CASE WHEN attendees LIKE '[%' THEN 'invited: [' || json_extract_string(attendees, '$[0]') || ', ' || json_extract_string(attendees, '$[1]') || ']' || chr(10) ELSE '' END
  || coalesce('audio: ' || audio_path || chr(10), '') || '---' || chr(10) || chr(10) || '# ' || heading || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || '*Not generated yet.*' || chr(10) || chr(10)
  || '## Notes' || chr(10) || chr(10) || '*None yet.*' || chr(10) || chr(10) || '## Transcript' || chr(10) || chr(10) || coalesce(spoken, '*No transcript yet.*' || chr(10)) AS markdown
  FROM shown LEFT JOIN told ON told.meeting = id LEFT JOIN named_by ON named_by.meeting = id)"""
SPACED = r"trim(lower(regexp_replace({t}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')))"
P.SQL["there"] = """there AS (SELECT meeting, CASE WHEN meeting % 9 = 4 THEN 'renamed-' || name ELSE name END AS name, CASE WHEN meeting % 9 = 4 THEN 'Renamed plan' ELSE title END AS title, body FROM documents_of WHERE meeting % 10 <> 3)"""
P.SQL["listed"] = f"""listed AS (SELECT meeting, unnest(string_split(s, ' ')) AS term FROM (SELECT meeting, {SPACED.format(t="title")} AS s FROM there UNION ALL SELECT meeting, {SPACED.format(t="body")} FROM there) WHERE s <> '')"""
DOCUMENTS = ("meetings", *SPOKEN, "told")

PRINTS = """(SELECT speaker_id, model, model_version, n, list(x / norm ORDER BY i) AS v FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY speaker_id)) AS norm FROM (
  SELECT speaker_id, model, model_version, i, count(*) AS n, sum(vector[i] * voiced_ms) / sum(voiced_ms) AS x FROM (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY speaker_id, meeting ORDER BY id DESC) AS depth, max(id) OVER (PARTITION BY speaker_id, meeting) AS newest FROM (
      SELECT *, max_by((model, model_version), id) OVER (PARTITION BY speaker_id) AS space FROM {table}) WHERE (model, model_version) = space AND NOT is_negative)
    QUALIFY row_number() OVER (PARTITION BY speaker_id ORDER BY depth, newest DESC) <= 32), range(1, 65) AS r(i) GROUP BY 1, 2, 3, 4)) GROUP BY 1, 2, 3, 4)"""
P.SQL["held"] = "held AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'operator' ELSE 'machine' END AS source FROM exemplars WHERE id % 2 = 0)"
P.SQL["diarized"] = f"""unknown AS (SELECT id FROM speakers WHERE display_name IS NULL AND NOT confirmed AND NOT is_operator),
remaining AS (SELECT * FROM held WHERE NOT (source = 'machine' AND coalesce(meeting < 5, false) AND speaker_id IN (SELECT id FROM unknown))),
seeds AS (SELECT p.*, s.confirmed FROM {PRINTS.format(table="remaining")} p JOIN speakers s ON s.id = p.speaker_id WHERE p.model = 'model0' AND p.model_version = '1'),
likeness AS (SELECT c.meeting, c.id AS cluster, s.speaker_id, s.confirmed, list_cosine_similarity(c.vector, s.v) AS score FROM exemplars c, seeds s
  WHERE c.id % 2 = 1 AND c.meeting < 5 AND c.id % 11 <> 0 AND NOT (s.speaker_id = 0 AND c.meeting % 2 = 1 AND c.meeting <> 3)),
rated AS (SELECT *, row_number() OVER (PARTITION BY meeting, cluster ORDER BY score DESC, confirmed DESC, speaker_id) AS rank, row_number() OVER (PARTITION BY meeting, speaker_id ORDER BY score DESC, cluster DESC) AS back FROM likeness),
won AS (SELECT a.meeting, a.cluster, a.speaker_id FROM rated a LEFT JOIN rated b ON a.meeting = b.meeting AND a.cluster = b.cluster AND b.rank = 2
  WHERE a.rank = 1 AND a.back = 1 AND a.score >= {FLOOR} AND (a.score - coalesce(b.score, 0) >= {MARGIN} OR (a.confirmed AND NOT coalesce(b.confirmed, true)))),
heard_voices AS (SELECT c.meeting, c.id AS cluster, c.vector, c.voiced_ms * 3 AS voiced_ms, coalesce(w.speaker_id, CAST('0x' || substr(md5(c.meeting || '-' || c.id), 1, 15) AS BIGINT)) AS speaker_id, w.speaker_id IS NULL AS minted
  FROM exemplars c LEFT JOIN won w ON w.meeting = c.meeting AND w.cluster = c.id WHERE c.id % 2 = 1 AND c.meeting < 5 AND c.id % 11 <> 0 AND c.id % 5 <> 0 AND (w.speaker_id IS NOT NULL OR c.voiced_ms * 3 >= 10000)),
assigned AS (SELECT meeting, cluster, speaker_id, minted FROM heard_voices UNION ALL SELECT meeting, id, id % 4, false FROM exemplars WHERE id % 2 = 1 AND meeting < 5 AND id % 11 = 0 AND id % 5 <> 0),
taken AS (SELECT * FROM heard_voices WHERE speaker_id <> 4),
evidence AS (SELECT id, speaker_id, meeting, vector, model, model_version, voiced_ms, is_negative, source FROM remaining r WHERE NOT (source = 'machine' AND EXISTS (SELECT 1 FROM taken t WHERE t.meeting = r.meeting AND t.speaker_id = r.speaker_id))
  UNION ALL SELECT 2199023255552 + CAST('0x' || substr(md5(meeting || '-' || cluster), 1, 15) AS BIGINT) % 1099511627776, speaker_id, meeting, vector, 'model0', '1', voiced_ms, false, 'machine' FROM taken),
people AS (SELECT id, display_name, is_operator FROM speakers UNION ALL SELECT DISTINCT speaker_id, NULL, false FROM heard_voices WHERE minted)"""
P.SQL["anew"] = "anew AS (SELECT id, speaker_id, meeting, list_reverse(vector) AS vector, 'model9' AS model, '1' AS model_version, voiced_ms, is_negative FROM held WHERE meeting IS NOT NULL AND meeting % 5 <> 3)"
P.SQL["seen_at"] = "seen_at AS (SELECT * FROM (SELECT *, ceil(start_ms / 5000.0) * 5000 AS first FROM turns WHERE event_id % 29 <> 0 AND event_id % 13 <> 0) WHERE first < end_ms)"
P.SQL["shorter"] = "shorter AS (SELECT meeting, speaker, start_ms, CASE WHEN end_ms % 11 = 0 THEN start_ms ELSE end_ms END AS end_ms FROM reference)"
P.SQL["probed"] = """unit AS (SELECT meeting % 2 AS series, meeting, speaker_id AS person, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM means),
rest AS (SELECT series, meeting, candidate, list(x ORDER BY i) AS v FROM (SELECT m.series, m.meeting, u.person AS candidate, i, avg(u.v[i]) AS x
  FROM (SELECT DISTINCT series, meeting FROM unit) m JOIN unit u ON u.series = m.series AND u.meeting <> m.meeting, range(1, 65) AS r(i) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
compared AS (SELECT p.series, p.meeting, p.person, g.candidate, list_cosine_similarity(p.v, g.v) AS score FROM unit p JOIN rest g ON p.series = g.series AND p.meeting = g.meeting
  WHERE EXISTS (SELECT 1 FROM rest o WHERE o.series = p.series AND o.meeting = p.meeting AND o.candidate = p.person)),
probed AS (SELECT series, meeting, person, max(score) FILTER (candidate = person) AS correct, coalesce(max(score) FILTER (candidate <> person), -1) AS others FROM compared GROUP BY 1, 2, 3)"""
VOICES = ("exemplars", "speakers", "held", "diarized")
OURS = "(SELECT DISTINCT a.speaker_id FROM assigned a JOIN people p ON p.id = a.speaker_id WHERE a.cluster % 8 = 1 AND p.display_name IS NULL AND NOT p.is_operator)"
IN = f"CASE WHEN {{c}} IN {OURS} THEN 0 ELSE {{c}} END"

QUERIES = {
    "transcript_written": (transcript_written, S("""SELECT meeting, row_number() OVER (PARTITION BY meeting ORDER BY sequence % 3, sequence) - 1 AS sequence, start_ms, channel, CAST(sequence % 3 AS BIGINT) AS batch FROM segments""", "segments")),
    "caption_subscription": (caption_subscription, S("""SELECT meeting, row_number() OVER (PARTITION BY meeting ORDER BY sequence % 3, sequence) - 1 AS sequence, start_ms, CASE WHEN sequence % 3 = 0 THEN 'snapshot' ELSE 'delta' END AS how FROM segments""", "segments")),
    "joined_samples": (joined_samples, S("""SELECT meeting, max(start_ms // 100 + k) AS samples, CAST(coalesce(sum(k * v) FILTER (channel = 'mic'), 0) AS DOUBLE) AS mic, CAST(coalesce(sum(k * v) FILTER (channel = 'system'), 0) AS DOUBLE) AS system,
  CAST(max(start_ms // 100 + k) - coalesce(sum(k) FILTER (channel = 'mic'), 0) AS BIGINT) AS mic_silent, CAST(max(start_ms // 100 + k) - coalesce(sum(k) FILTER (channel = 'system'), 0) AS BIGINT) AS system_silent
  FROM (SELECT t.*, CAST(floor(e.value * 100) AS BIGINT) % 15 + 1 AS k, t.event_id % 7 + 1 AS v FROM turns t JOIN events e USING (event_id)) GROUP BY meeting""", "turns")),
    "echo_removed": (echo_removed, S("SELECT meeting, 300 * count(*) AS samples, CASE WHEN max(start_ms) >= 15000 THEN true END AS clean, 0 AS louder FROM turns GROUP BY meeting", "turns")),
    "resampled_frames": (resampled_frames, S("""SELECT event_id, CAST(floor(k * 2.5) AS INTEGER) AS n, round(list_sum(list_transform(range(CAST(floor(k * 2.5) AS BIGINT)), lambda i: v * (1 + least(i * 0.4::DOUBLE, k - 1)))), 6) AS total
  FROM (SELECT t.event_id, CAST(floor(e.value * 100) AS BIGINT) % 15 + 1 AS k, t.event_id % 7 + 1 AS v FROM turns t JOIN events e USING (event_id))""", "turns")),
    "segment_stream": (segment_stream, None),
    "rttm_round_trip": (rttm_round_trip, S(f"SELECT CAST(meeting AS VARCHAR) AS file, speaker, start_ms, end_ms FROM {MERGED.format(keys='meeting, speaker', gap=400, table='shorter')}", "turns", "reference", "shorter")),
    "observations_round_trip": (observations_round_trip, S("""SELECT channel, count(*) AS n, CAST(sum(end_ms - start_ms) AS BIGINT) AS ms, CAST(coalesce(sum(end_ms - start_ms) FILTER (event_id % 2 = 0), 0) AS BIGINT) AS clean_ms,
  count(*) FILTER (event_id % 3 <> 0) AS vectors, CAST(sum(event_id % 5) FILTER (event_id % 3 <> 0) AS DOUBLE) AS x0 FROM turns GROUP BY channel""", "turns")),
    "powerset_speakers": (powerset_speakers, """SELECT event_id, CASE max_by(i, ((event_id * 31 + i * 17) % 5, i)) WHEN 1 THEN '0' WHEN 2 THEN '1' WHEN 3 THEN '2' WHEN 4 THEN '0,1' WHEN 5 THEN '0,2' WHEN 6 THEN '1,2' ELSE '' END AS speakers FROM events, range(8) AS g(i) GROUP BY event_id"""),
    "silence_thresholds": (silence_thresholds, S("SELECT event_id, round(0.8::DOUBLE - least(greatest((age - 3000) / 17000.0::DOUBLE, 0), 1) * 0.45::DOUBLE, 6) AS threshold FROM (SELECT event_id, end_ms - start_ms + event_id % 20000 AS age FROM turns)", "turns")),
    "speaker_fragments": (speaker_fragments, "SELECT least(count(*), 2) AS hits, CASE WHEN count(*) > 0 THEN true END AS fits FROM embeddings WHERE contains(md5(CAST(vec_id AS VARCHAR)), 'abcd')"),
    "live_voices": (live_voices, None),
    "speakers_renamed": (speakers_renamed, S("""SELECT kind, id, what FROM (SELECT 'named' AS kind, id, CASE WHEN id % 4 = 1 AND id IN (SELECT speaker_id FROM exemplars) THEN 'Voice ' || id ELSE display_name END AS what FROM speakers
    WHERE confirmed OR (id % 4 = 1 AND id IN (SELECT speaker_id FROM exemplars)) OR (id % 4 = 3 AND id IN (SELECT speaker_id FROM exemplars) AND id + 1 NOT IN (SELECT id FROM speakers WHERE display_name IS NOT NULL))
  UNION ALL SELECT CASE WHEN o.id % 8 = 3 THEN 'join' ELSE 'refused' END, o.id, CAST(h.id AS VARCHAR) FROM (SELECT DISTINCT speaker_id AS id FROM exemplars WHERE speaker_id % 4 = 3) o JOIN speakers h ON h.display_name = 'Name ' || (o.id + 1))""", "exemplars", "speakers")),
    "history_population": (history_population, S("""SELECT meeting, person, count(*) OVER before > 0 AS seen_before, coalesce(count(*) FILTER (ms >= 10000) OVER before, 0) > 0 AS enrolled_before
  FROM (SELECT meeting, speaker_id AS person, sum(end_ms - start_ms) AS ms, any_value(started_at) AS started_at FROM segments JOIN meetings ON id = meeting WHERE speaker_id IS NOT NULL GROUP BY 1, 2)
  WINDOW before AS (PARTITION BY person ORDER BY started_at, meeting ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", "segments", "meetings")),
    "speakers_by_id": (speakers_by_id, S("SELECT id, display_name FROM speakers WHERE id IN (SELECT speaker_id FROM exemplars) ORDER BY id", "speakers", "exemplars")),
    "recognition_probes": (recognition_probes, S("SELECT series, meeting, person, round(correct, 6) AS correct, round(others, 6) AS others FROM probed", "exemplars", "means", "probed")),
    "recognition_grid": (recognition_grid, S("""SELECT floor, margin, round((SELECT avg(CASE WHEN correct >= floor AND correct - others >= margin THEN 1.0::DOUBLE ELSE 0 END) FROM probed), 6) AS recognized,
  round((SELECT avg(CASE WHEN score >= floor THEN 1.0::DOUBLE ELSE 0 END) FROM compared WHERE candidate <> person), 6) AS false_above
  FROM (VALUES (0.0::DOUBLE), (0.1), (0.2), (0.4)) AS f(floor), (VALUES (0.0::DOUBLE), (0.05), (0.1)) AS m(margin)""", "exemplars", "means", "probed")),
    "documents_rendered": (documents_rendered, S("SELECT meeting, name, md5(markdown) AS markdown, title FROM documents_of", *DOCUMENTS)),
    "documents_published": (documents_published, S("SELECT meeting, name, coalesce(words, 0) AS words FROM there LEFT JOIN (SELECT meeting, count(*) AS words FROM listed GROUP BY meeting) USING (meeting)", *DOCUMENTS, "there", "listed")),
    "stored_search": (stored_search, S("""SELECT meeting, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score, CAST(sum(tf) AS BIGINT) AS hits FROM (
    SELECT *, count(*) OVER (PARTITION BY term) AS df FROM (SELECT meeting, term, count(*) AS tf FROM listed WHERE term IN ('plan', 'the') GROUP BY ALL))
  JOIN (SELECT meeting, count(*) AS size FROM listed GROUP BY meeting) USING (meeting), (SELECT count(*) AS docs, avg(n) AS mean FROM (SELECT count(*) AS n FROM listed GROUP BY meeting))
  GROUP BY meeting HAVING count(*) = 2 ORDER BY score DESC, meeting LIMIT 25""", *DOCUMENTS, "there", "listed")),
    "diarized_meetings": (diarized_meetings, S(f"""SELECT 'assigned' AS kind, meeting, cluster, speaker_id, CAST(minted AS BIGINT) AS n, NULL::DOUBLE AS x0 FROM assigned
  UNION ALL SELECT 'evidence-' || source, meeting, NULL, speaker_id, count(*), NULL FROM evidence GROUP BY source, meeting, speaker_id
  UNION ALL SELECT 'print', NULL, NULL, speaker_id, n, round(v[1], 5) FROM {PRINTS.format(table="evidence")} UNION ALL SELECT 'speaker', NULL, NULL, id, 1, NULL FROM people""", *VOICES)),
    "operator_attached": (operator_attached, S(f"""SELECT speaker_id, kind, count(*) AS n FROM (SELECT id AS speaker_id, 'speaker' AS kind FROM people WHERE id NOT IN {OURS} UNION ALL SELECT 0, 'operator'
  UNION ALL SELECT {IN.format(c="speaker_id")}, 'segment' FROM segments UNION ALL SELECT {IN.format(c="speaker_id")}, 'hint' FROM hints UNION ALL SELECT {IN.format(c="speaker_id")}, 'exemplar' FROM evidence
  UNION ALL SELECT DISTINCT {IN.format(c="speaker_id")}, 'print' FROM evidence e WHERE NOT is_negative) WHERE speaker_id IS NOT NULL GROUP BY 1, 2""", *VOICES, "segments", "hints")),
    "model_wiped": (model_wiped, S(f"""SELECT 'wiped' AS step, speaker_id, model, 0 AS n, NULL::DOUBLE AS x0 FROM {PRINTS.format(table="held")}
  UNION ALL SELECT 'rebuilt', speaker_id, model, n, round(v[1], 5) FROM {PRINTS.format(table="anew")}""", "exemplars", "held", "anew")),
    "calendar_changes": (calendar_changes, S("""SELECT meeting AS calendar, CAST(first AS BIGINT) AS at_ms, 'CalendarEventStarted' AS kind, CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 4 = 0 THEN 'Untitled event' ELSE cluster END AS title, end_ms AS scheduled_end_ms FROM seen_at
  UNION ALL SELECT meeting, CAST(ceil(end_ms / 5000.0) * 5000 AS BIGINT), 'CalendarEventEnded', CAST(event_id AS VARCHAR), NULL, NULL FROM seen_at""", "turns", "seen_at")),
    "rerun_lifecycle": (rerun_lifecycle, f"""WITH o AS (SELECT o_orderkey AS m, o_orderkey % 25 = 0 AS front, o_orderkey % 10 = 0 AND o_orderkey % 25 <> 0 AS back, o_custkey % 3 <> 0 AND o_orderkey % 10 <> 0 AND o_orderkey % 25 <> 0 AS mine FROM orders),
s AS (SELECT *, m % 4 = 1 OR m % 7 = 3 OR m % 11 = 5 AS gone FROM o),
a AS (SELECT count(*) FILTER (mine) - count(*) FILTER (mine AND m % 4 <> 1 AND m % 7 <> 3 AND m % 11 = 5) AS total, count(*) FILTER (mine AND NOT gone) AS remaining,
  count(*) FILTER (mine AND m % 4 <> 1 AND m % 7 = 3) AS abandoned, count(*) FILTER (mine AND m % 4 = 1) AS done FROM s)
SELECT m AS meeting, CASE WHEN front AND NOT gone OR m % 13 = 6 THEN 0 ELSE 1 END AS priority,
  CAST(CASE WHEN front AND NOT gone THEN '{T1}' WHEN m % 13 = 6 THEN '{T3}' WHEN back THEN '{T0}' ELSE '{T2}' END AS TIMESTAMP) AS enqueued_at, total, remaining, abandoned, done
FROM s, a WHERE (NOT gone AND (front OR back OR mine)) OR m % 13 = 6"""),
}
