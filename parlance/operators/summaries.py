"""Checks of generated summaries against what was said, line by line and speaker by speaker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as T

#: What stands for unnamed voices, and for an empty list.
PLACEHOLDER, NONE_NOTED = "Participant", "None noted."


def lines_of(summaries: DataFrame) -> DataFrame:
    """(meeting, line, text, item) of each line."""
    rows = summaries.select("meeting", F.posexplode(F.split("summary", "\n")).alias("line", "text"))
    return rows.withColumn("item", T.item(F.col("text")))


def checked(summaries: DataFrame, spoken: DataFrame) -> DataFrame:
    """(meeting, line, who, what, verdict) of table rows: borne-out, unattributed, unknown-speaker or empty.

    At least half of a row's distinctive words, by stem, must occur in the lines of the person it names.
    """
    rows = lines_of(summaries).where("item is not null").select("meeting", "line", "item.who", "item.what", T.distinctive(F.col("item.what")).alias("words"))
    by = spoken.select("meeting", F.lower(F.trim("speaker")).alias("speaker"), F.lower("text").alias("said"))
    who = F.lower(F.trim("who"))
    mine = rows.join(by, "meeting").where((F.col("speaker") != "") & (who.contains(F.col("speaker")) | F.col("speaker").contains(who)))
    theirs = mine.groupBy("meeting", "line").agg(F.array_join(F.collect_list("said"), " ").alias("theirs"))
    found = rows.join(theirs, ["meeting", "line"], "left")
    echoed = F.size(F.filter("words", lambda w: F.col("theirs").contains(T.stem(w))))
    verdict = F.when(F.size("words") == 0, "empty").when(F.col("theirs").isNull(), "unknown-speaker").when(echoed * 2 < F.size("words"), "unattributed").otherwise("borne-out")
    return found.select("meeting", "line", "who", "what", verdict.alias("verdict"))


def quoted(summaries: DataFrame, spoken: DataFrame, least_lines: int = 3) -> DataFrame:
    """(meeting, sequence): summaries whose every distinctive word, by stem, occurs in one line only, the same for all."""
    many = spoken.groupBy("meeting").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_lines)
    dictated = T.distinctive(F.lit(NONE_NOTED))
    words = summaries.join(many, "meeting").select("meeting", F.explode(F.array_except(T.distinctive(F.col("summary")), dictated)).alias("word"))
    hits = words.join(spoken.select("meeting", "sequence", F.lower("text").alias("said")), "meeting").where(F.col("said").contains(T.stem(F.col("word"))))
    total = words.groupBy("meeting").agg(F.countDistinct("word").alias("words"))
    one = hits.groupBy("meeting").agg(F.countDistinct("word").alias("echoed"), F.min("sequence").alias("sequence"), F.max("sequence").alias("last"))
    return one.join(total, "meeting").where("echoed = words and sequence = last").select("meeting", "sequence")


def without_placeholders(summaries: DataFrame) -> DataFrame:
    """(meeting, summary, dropped): rows that credit a placeholder go; a table left without rows becomes one line."""
    rows = lines_of(summaries)
    bare = F.regexp_replace(F.col("item.who"), rf"^[^{T.ALNUM}]+|[^{T.ALNUM}]+$", "")
    rows = rows.withColumn("placeholder", F.col("item").isNotNull() & (F.lower(bare) == PLACEHOLDER.lower()))
    kept = F.array_sort(F.collect_list(F.when(~F.col("placeholder"), F.struct("line", "text"))))
    found = rows.groupBy("meeting").agg(kept.alias("kept"), F.count_if("placeholder").alias("dropped"), F.count_if(F.col("item").isNotNull() & ~F.col("placeholder")).alias("left"))
    barred = F.filter("kept", lambda x: x["text"].contains("|"))
    first = F.when(F.size(barred) > 0, barred[0]["line"])
    emptied = F.transform(F.filter("kept", lambda x: ~x["text"].contains("|") | (x["line"] == first)), lambda x: F.when(x["text"].contains("|"), F.lit(NONE_NOTED)).otherwise(x["text"]))
    text = F.when((F.col("dropped") > 0) & (F.col("left") == 0), emptied).otherwise(F.transform("kept", lambda x: x["text"]))
    return found.select("meeting", F.array_join(text, "\n").alias("summary"), "dropped")


def mapped_and_reduced(chunks: DataFrame, generate: Callable[[str], str | None], reduce: Callable[[str], str | None]) -> DataFrame:
    """(meeting, summary, gaps): a generator over each chunk (meeting, chunk, lines), then over the parts in order.

    The generator is the caller's; None or an exception is a gap, which is counted, not hidden. One chunk needs no reduction.
    """

    def said(make: Callable) -> Callable:
        def run(text: str) -> str | None:
            try:
                return make(text)
            except Exception:  # whatever a generator raises is a gap of this chunk
                return None

        return F.udf(run, "string")

    parts = chunks.select("meeting", "chunk", T.scrubbed(said(generate)(F.col("lines"))).alias("part"))
    joined = parts.groupBy("meeting").agg(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull() & (F.col("part") != ""), F.struct("chunk", "part")))).alias("kept"), F.count(F.lit(1)).alias("n"))
    text = F.array_join(F.transform("kept", lambda x: x["part"]), "\n\n")
    summary = F.when(F.size("kept") == 0, F.lit(None)).when(F.size("kept") == 1, text).otherwise(T.scrubbed(said(reduce)(text)))
    return joined.select("meeting", summary.alias("summary"), (F.col("n") - F.size("kept")).alias("gaps"))
