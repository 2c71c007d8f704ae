"""Speakers across meetings: where each was heard, whom to suggest, whom nothing refers to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def heard_in(segments: DataFrame, hints: DataFrame) -> DataFrame:
    """(meeting, speaker_id) of machine evidence or any hint, newest or not."""
    both = segments.select("meeting", "speaker_id").unionByName(hints.select("meeting", "speaker_id"))
    return both.where(F.col("speaker_id").isNotNull()).distinct()


def appearances(speakers: DataFrame, heard: DataFrame, meetings: DataFrame) -> DataFrame:
    """For every speaker: meetings heard in, and the first and last of them by the text of started_at."""
    at = heard.join(meetings.select(F.col("id").alias("meeting"), "started_at", "title"), "meeting")
    key = F.struct("started_at", "meeting")
    seen = at.groupBy("speaker_id").agg(F.countDistinct("meeting").alias("meetings"), F.min_by("meeting", key).alias("first_meeting"), F.min("started_at").alias("first_at"), F.max_by("meeting", key).alias("last_meeting"), F.max("started_at").alias("last_at"))
    return speakers.join(seen, speakers["id"] == seen["speaker_id"], "left").select("id", F.coalesce("meetings", F.lit(0)).cast("long").alias("meetings"), "first_meeting", "first_at", "last_meeting", "last_at")


def json_names(column: str) -> Column:
    """A JSON array of strings; empty if it isn't one."""
    return F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))


def name_suggestions(heard: DataFrame, meetings: DataFrame, speakers: DataFrame) -> DataFrame:
    """(speaker_id, name, place): attendees of a speaker's meetings who have no speaker yet, in order of first sight."""
    at = heard.join(meetings.select(F.col("id").alias("meeting"), "started_at", json_names("attendees").alias("names")), "meeting")
    names = at.select("speaker_id", "started_at", "meeting", F.posexplode("names").alias("position", "name"))
    taken = speakers.where("display_name is not null").select(F.lower("display_name").alias("taken"))
    free = names.join(taken, F.lower("name") == F.col("taken"), "left_anti")
    first = free.groupBy("speaker_id", "name").agg(F.min(F.struct("started_at", "meeting", "position")).alias("first"))
    place = F.row_number().over(Window.partitionBy("speaker_id").orderBy("first"))
    return first.select("speaker_id", "name", place.alias("place"))


def anonymous() -> Column:
    return F.col("display_name").isNull() & ~F.col("confirmed") & ~F.col("is_operator")


def relearnable() -> Column:
    return ~F.col("forgotten") & (F.col("display_name").isNotNull() | F.col("is_operator"))


def unreferenced(speakers: DataFrame, *references: DataFrame) -> DataFrame:
    """Anonymous speakers that none of the references (one column each) names; nulls there name nobody."""
    used = None
    for r in references:
        ids = r.select(F.col(r.columns[0]).alias("used")).where("used is not null")
        used = ids if used is None else used.union(ids)
    return speakers.where(anonymous()).join(used.distinct(), F.col("id") == F.col("used"), "left_anti")


def stale(exemplars: DataFrame, meetings: DataFrame, model: str, version: str) -> DataFrame:
    """Exemplars of another model identity, with the audio they could be made anew from."""
    other = ~F.col("model").eqNullSafe(F.lit(model)) | ~F.col("model_version").eqNullSafe(F.lit(version))
    return exemplars.where(other).join(meetings.select(F.col("id").alias("meeting"), "audio_path"), "meeting", "left")


def joined(into: dict[int, int], frame: DataFrame, *columns: str) -> DataFrame:
    """frame with speakers repointed, as when one is joined into another."""
    if not into:
        return frame
    mapping = F.create_map(*[F.lit(x) for pair in sorted(into.items()) for x in pair])
    return frame.withColumns({c: F.coalesce(mapping[F.col(c)], F.col(c)) for c in columns})


def allowed_joins(speakers: DataFrame, asked: DataFrame) -> DataFrame:
    """C14: the (source, into) of asked that may be: both exist and differ, the source has no name, and the operator joins nobody else.

    Of several for one source that of the smallest target stays; a target that is joined away itself waits for a later call.
    """
    end = lambda c: speakers.select(F.col("id").alias(c), F.col("display_name").isNotNull().alias(f"{c}_named"), F.col("is_operator").alias(f"{c}_operator"))
    fits = "source <> into and not source_named and (not source_operator or into_operator)"
    one = asked.join(end("source"), "source").join(end("into"), "into").where(fits).groupBy("source").agg(F.min("into").alias("into"))
    return one.join(one.select(F.col("source").alias("into")), "into", "left_anti").select("source", "into")


def repointed(frame: DataFrame, joins: DataFrame, *columns: str) -> DataFrame:
    """C14: frame with the columns' speakers replaced by those that they were joined into; joins: (source, into), one row a source."""
    for c in columns:
        frame = frame.join(joins.select(F.col("source").alias("__source"), F.col("into").alias("__into")), F.col(c) == F.col("__source"), "left")
        frame = frame.withColumn(c, F.coalesce("__into", c)).drop("__source", "__into")
    return frame


def speakers_joined(speakers: DataFrame, segments: DataFrame, hints: DataFrame, exemplars: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """C14: the four tables once the allowed of the asked (source, into) are done: sources are gone, and nothing names them."""
    joins = allowed_joins(speakers, asked)
    left = speakers.join(joins.select(F.col("source").alias("id")), "id", "left_anti")
    return left, repointed(segments, joins, "speaker_id"), repointed(hints, joins, "speaker_id", "replaced_id"), repointed(exemplars, joins, "speaker_id")


def renamed(speakers: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Speakers after renames (id, name, joining), the joins (source, into) that these ask for, and those refused (id, name, held_by).

    A name confirms its speaker. A name that somebody else holds, letters' case aside, is not given twice: it is refused, or, where joining is set, means
    that the speaker is that somebody. Of several names for one speaker, and of several speakers for one name, the first by order counts.
    """
    known = asked.join(speakers.select("id"), "id", "left_semi").groupBy("id").agg(F.min(F.struct("name", "joining")).alias("a")).select("id", "a.*")
    holders = speakers.where("display_name is not null").groupBy(F.lower("display_name").alias("folded")).agg(F.min("id").alias("held_by"))
    rows = known.withColumn("folded", F.lower("name")).join(holders, "folded", "left")
    held = F.col("held_by").isNotNull() & (F.col("held_by") != F.col("id"))
    free = rows.where(~held | F.col("held_by").isNull())
    first = free.groupBy("folded").agg(F.min("id").alias("id"), F.min_by("name", "id").alias("new")).select("id", "new")
    named = speakers.join(first, "id", "left").withColumn("confirmed", F.col("confirmed") | F.col("new").isNotNull()).withColumn("display_name", F.coalesce("new", "display_name"))
    late = free.join(first.select("id"), "id", "left_anti").join(first.select(F.lower("new").alias("folded"), F.col("id").alias("by")), "folded")
    taken = rows.where(held).select("id", "name", "joining", "held_by").unionByName(late.select("id", "name", "joining", F.col("by").alias("held_by")))
    return named.select(*speakers.columns), taken.where("joining").select(F.col("id").alias("source"), F.col("held_by").alias("into")), taken.where(~F.col("joining")).select("id", "name", "held_by")


def resolve(frame: DataFrame, typed: str, column: str = "id", anywhere: bool = False) -> DataFrame:
    """Up to two rows that a typed id means: the exact one, else those that start with (or contain) it."""
    bare = "".join(c for c in typed.lower() if c in "0123456789abcdef")
    exact = frame.where(F.col(column) == typed).limit(1)
    if not exact.isEmpty():
        return exact
    plain = F.regexp_replace(F.lower(column), "-", "")
    hit = plain.contains(bare) if anywhere else plain.startswith(bare)
    return frame.where(hit & F.lit(bool(bare))).limit(2)
