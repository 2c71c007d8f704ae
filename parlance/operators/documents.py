"""The Markdown document of a meeting, with its name and what of it is searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import transcripts

#: Columns of a meeting that its document shows where they are there.
OPTIONAL = ("calendar_event_id", "audio_notes", "summary", "summary_gaps", "notes")


def fallback_title(app: Column, started_at: Column) -> Column:
    """What a meeting without a title is called."""
    date = F.substring(started_at, 1, 10)
    return F.when(app.isNotNull(), F.concat_ws(", ", app, date)).otherwise(F.concat(F.lit("Meeting, "), date))


def blank(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def line(label: str, value: Column) -> Column:
    """A line of the head, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{label}: "), value, F.lit("\n")), F.lit(""))


def documents(meetings: DataFrame, labelled: DataFrame, identifier: Column | None = None) -> DataFrame:
    """(meeting, name, markdown, title, body) of meetings (id, started_at, title, detected_app, audio_path, attendees: array, seconds, and those of OPTIONAL) and labelled segments.

    Parts that aren't there yet say so, so a document's shape doesn't change. title and body are what is indexed. identifier: what names are made with, the id itself if not given.
    """
    parts = F.array_sort(F.collect_list(F.struct("sequence", "label", "start_ms", "text")))
    said = labelled.groupBy("meeting").agg(parts.alias("parts")).join(transcripts.speaker_lists(labelled), "meeting")
    kinds = {"audio_notes": "array<string>"}
    rows = meetings.select("*", *[F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in OPTIONAL if c not in meetings.columns]).withColumnRenamed("id", "meeting").join(said, "meeting", "left")
    many = lambda c: F.when(F.size(c) > 0, F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]")))
    head = F.concat(
        F.lit("---\n"), line("id", F.col("meeting").cast("string")), line("date", F.col("started_at")), line("app", F.col("detected_app")), line("duration", T.duration(F.col("seconds"))),
        line("speakers", F.concat(F.lit("["), F.coalesce("speakers", F.lit("")), F.lit("]"))), line("calendar_event", F.col("calendar_event_id")), line("invited", many("attendees")), line("audio", F.col("audio_path")), F.lit("---\n\n"),
    )
    shown = F.coalesce(F.when(blank("title").isNotNull(), F.col("title")), fallback_title(F.col("detected_app"), F.col("started_at")))
    warned = F.when(F.size("audio_notes") > 0, F.concat(F.lit("> **This recording is incomplete.**\n"), F.array_join(F.transform("audio_notes", lambda n: F.concat(F.lit("> - "), n, F.lit("\n"))), ""), F.lit("\n")))
    gaps = F.concat(F.lit("> **This Summary is incomplete.** "), blank("summary_gaps"), F.lit("\n\n"))
    words = lambda p: F.trim(F.coalesce(p["text"], F.lit("")))
    spoken = F.transform("parts", lambda p: F.concat(F.lit("**"), p["label"], F.lit("** ("), transcripts.clock(p["start_ms"], "%02d"), F.lit(") "), words(p), F.lit("\n\n")))
    or_else = lambda c, other: F.concat(F.coalesce(c, F.lit(other)), F.lit("\n\n"))
    markdown = F.concat(
        head, F.lit("# "), shown, F.lit("\n\n"), F.coalesce(warned, F.lit("")), F.lit("## Summary\n\n"), F.coalesce(gaps, F.lit("")), or_else(blank("summary"), "*Not generated yet.*"),
        F.lit("## Notes\n\n"), or_else(blank("notes"), "*None yet.*"), F.lit("## Transcript\n\n"), F.coalesce(F.array_join(spoken, ""), F.lit("*No transcript yet.*\n")),
    )
    name = T.file_name(F.col("started_at"), F.col("title"), F.col("detected_app"), F.col("meeting").cast("string") if identifier is None else identifier)
    body = F.coalesce(F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), "\n"), F.lit(""))
    # an empty title is a title for the index
    title = F.coalesce("title", fallback_title(F.col("detected_app"), F.col("started_at")))
    return rows.select("meeting", name.alias("name"), markdown.alias("markdown"), title.alias("title"), body.alias("body"))
