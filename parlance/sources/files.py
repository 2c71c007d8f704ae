"""Readers and writers of the record's file forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.operators import intervals

OBSERVATIONS = T.StructType([
    T.StructField("channel", T.StringType()), T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("clean", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("vector", T.ArrayType(T.FloatType())),
])


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """(file, speaker, start_ms, end_ms) of SPEAKER lines with 8 fields or more; seconds become rounded milliseconds."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(part.alias("p")).where((F.col("p")[0] == "SPEAKER") & (F.size("p") >= 8))
    ms = lambda i: F.round(F.col("p")[i].cast("double") * 1000).cast("long")
    return rows.select(F.col("p")[1].alias("file"), F.col("p")[7].alias("speaker"), ms(3).alias("start_ms"), (ms(3) + ms(4)).alias("end_ms"))


def rttm_lines(turns: DataFrame) -> DataFrame:
    """One line for each merged turn of (meeting, speaker, start_ms, end_ms)."""
    merged = intervals.merged(turns, "meeting", "speaker")
    seconds = lambda c: F.format_string("%.3f", c / 1000.0)
    return merged.select(F.concat_ws(" ", F.lit("SPEAKER"), F.col("meeting").cast("string"), F.lit("1"), seconds(F.col("start_ms")), seconds(F.col("end_ms") - F.col("start_ms")), F.lit("<NA> <NA>"), F.col("speaker"), F.lit("<NA> <NA>")).alias("value"))


def write_rttm(turns: DataFrame, path: str) -> None:
    rttm_lines(turns).write.text(path)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Observations as JSON lines, with the schema declared."""
    return spark.read.schema(OBSERVATIONS).json(path)


def write_observations(observations: DataFrame, path: str) -> None:
    observations.select(*OBSERVATIONS.names).write.json(path)


def write_documents(meetings: DataFrame, path: str) -> None:
    """One Markdown text for each meeting (name, body), as a table partitioned by name, replaced as a whole."""
    meetings.select("name", F.col("body").alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def upserted(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of new, and those of old whose key new doesn't have."""
    return new.unionByName(old.join(new.select(*keys).distinct(), list(keys), "left_anti"))


def reindexed(index: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """The index with all rows of the fresh documents replaced."""
    return index.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def appended(existing: DataFrame, fresh: DataFrame, key: str = "meeting") -> DataFrame:
    """Fresh segments with sequences that go on from each key's last."""
    from pyspark.sql import Window

    last = existing.groupBy(key).agg(F.max("sequence").alias("last"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("start_ms", "text")).cast("long")
    return fresh.drop("sequence").withColumn("n", number).join(last, key, "left").withColumn("sequence", F.coalesce(F.col("last") + 1, F.lit(0)) + F.col("n") - 1).drop("n", "last")
