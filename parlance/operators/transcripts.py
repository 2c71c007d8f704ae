"""Corrected transcripts: the newest hint wins over the machine, and every segment gets a label to show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text

KEY = ("meeting", "sequence")
#: Fixed value: mean token probability under which a decode is an invention.
LEAST_CONFIDENCE = 0.25


def understood(decoded: DataFrame, floor: float = LEAST_CONFIDENCE) -> DataFrame:
    """Of decoded chunks, batch or stream, those that are speech, with their text cleaned."""
    return decoded.where(F.col("confidence") >= floor).withColumn("text", text.cleaned(F.col("text"))).where("text is not null")


def kept_decodes(decodes: DataFrame, floor: float = LEAST_CONFIDENCE) -> DataFrame:
    """Decodes (meeting, channel, start_ms, end_ms, text, confidence) that are speech, with cleaned text and their place in the meeting by start.

    A text that is cleaned away goes, and so does a confidence that is null or under the floor. Ties go by end, channel and text.
    """
    return understood(decodes, floor).withColumn("place", F.row_number().over(Window.partitionBy("meeting").orderBy("start_ms", "end_ms", "channel", "text")))


def effective(segments: DataFrame, hints: DataFrame) -> DataFrame:
    """segments with who and how: the newest hint's speaker if there is a hint, else the machine's."""
    newest = hints.groupBy(*KEY).agg(F.max_by("speaker_id", F.struct("created_at", "id")).alias("hint"), F.lit(True).alias("hinted"))
    joined = segments.join(newest, list(KEY), "left")
    return joined.withColumn("who", F.coalesce("hint", "speaker_id")).withColumn("how", F.when(F.col("hinted"), "operator").otherwise(F.col("attribution"))).drop("hint", "hinted")


def labelled(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """Effective segments with a label: a name, You, Speaker n by first appearance, Unattributed, or the channel's."""
    names = speakers.select(F.col("id").alias("who"), "display_name", "is_operator")
    rows = segments.join(names, "who", "left")
    whole = Window.partitionBy("meeting")
    diarized = F.max(F.col("who").isNotNull() | F.col("how").isNotNull()).over(whole)
    unnamed = F.col("who").isNotNull() & F.col("display_name").isNull() & ~F.coalesce("is_operator", F.lit(False))
    first = F.min("sequence").over(Window.partitionBy("meeting", "who"))
    rows = rows.withColumn("diarized", diarized).withColumn("first", F.when(unnamed, first))
    number = F.dense_rank().over(Window.partitionBy("meeting").orderBy(F.col("first").asc_nulls_last()))
    label = (
        F.when(F.col("who").isNull() & F.col("diarized"), "Unattributed")
        .when(F.col("who").isNull(), F.when(F.col("channel") == "mic", "You").otherwise("Participants"))
        .when(F.col("display_name").isNotNull(), F.col("display_name"))
        .when(F.col("is_operator"), "You")
        .otherwise(F.concat(F.lit("Speaker "), F.col("number").cast("string")))
    )
    return rows.withColumn("number", number).withColumn("label", label).drop("number", "first", "diarized", "display_name", "is_operator")


def bodies(segments: DataFrame) -> DataFrame:
    """(meeting, body): the texts of a meeting in order, one on each line."""
    return segments.groupBy("meeting").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", "text"))), lambda s: s["text"]), "\n").alias("body"))


def speaker_lists(labelled_segments: DataFrame) -> DataFrame:
    """(meeting, speakers): distinct labels by first appearance."""
    first = labelled_segments.groupBy("meeting", "label").agg(F.min("sequence").alias("first"))
    return first.groupBy("meeting").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "label"))), lambda s: s["label"]), ", ").alias("speakers"))


def clock(ms: Column, hours: str = "%d") -> Column:
    """mm:ss, or hours in front from one hour on."""
    total = F.floor(F.greatest(ms, F.lit(0)) / 1000).cast("long")
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    return F.when(h > 0, F.format_string(f"{hours}:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def rendered(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """(meeting, sequence, line): [mm:ss] who: text, with a stand-in for each channel's unnamed voices."""
    names = speakers.select(F.col("id").alias("who"), "display_name")
    who = F.coalesce("display_name", F.when(F.col("channel") == "mic", "You").otherwise("Participant"))
    line = F.concat(F.lit("["), clock(F.col("start_ms")), F.lit("] "), who, F.lit(": "), F.trim(F.coalesce("text", F.lit(""))))
    return segments.join(names, "who", "left").select("meeting", "sequence", line.alias("line"))
