"""The generic tables seen as a record of meetings, and the same views as SQL.

Each function takes (spark, folder) and returns one table of the model; SQL has the same tables as DuckDB common table
expressions. Only integers and strings are made up here, so both sides agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the projection.
MS_PER_CHARACTER, TURN_SPACING_MS, TURN_LEAST_MS, TURN_SPREAD_MS = 60, 1500, 500, 6000
SPEAKERS = 11


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def meetings(spark: SparkSession, folder: str) -> DataFrame:
    """id, started_at, ended_at (text with offsets), title, detected_app, attendees (JSON text), audio_path, diarized."""
    ids = table(spark, folder, "conversations").select(F.col("conv_id").alias("id")).distinct()
    at = lambda hour: F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0"), F.lit("T"), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("id") % 60).cast("string"), 2, "0"), F.lit(":00"), F.element_at(F.array(F.lit("-08:00"), F.lit("+00:00"), F.lit("+05:30")), (F.col("id") % 3 + 1).cast("int")))
    return ids.select(
        "id", at(F.col("id") % 12 + 2).alias("started_at"),
        F.when(F.col("id") % 10 == 9, F.lit(None)).when(F.col("id") % 13 == 0, at(F.col("id") % 12 + 1)).otherwise(at(F.col("id") % 12 + 3)).alias("ended_at"),
        F.when(F.col("id") % 4 == 0, F.lit(None)).when(F.col("id") % 4 == 1, F.lit("  ")).otherwise(F.concat(F.lit("Review: Q"), (F.col("id") % 5).cast("string"), F.lit(" / plan"))).alias("title"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("App "), (F.col("id") % 4).cast("string"))).alias("detected_app"),
        F.when(F.col("id") % 7 == 0, F.lit("not json")).when(F.col("id") % 7 == 1, F.lit(None)).otherwise(F.concat(F.lit('["Guest '), (F.col("id") % 9).cast("string"), F.lit('","Name '), (F.col("id") % 4 * 2).cast("string"), F.lit('"]'))).alias("attendees"),
        F.when(F.col("id") % 5 != 3, F.concat(F.lit("/audio/"), F.col("id").cast("string"))).alias("audio_path"), (F.col("id") % 6 != 2).alias("diarized"),
    )


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """meeting, sequence, channel, start_ms, end_ms, text, speaker_id, attribution."""
    turns = table(spark, folder, "conversations")
    length = F.coalesce(F.length("text"), F.lit(0)).cast("long") * MS_PER_CHARACTER
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long")
    speaker = F.when(F.col("turn") % 5 != 4, (F.col("conv_id") * 7 + F.col("turn") * 3) % SPEAKERS)
    return turns.select(
        F.col("conv_id").alias("meeting"), F.col("turn").alias("sequence"), F.when(F.col("role") == "user", "mic").otherwise("system").alias("channel"),
        start.alias("start_ms"), (start + length).alias("end_ms"), "text", speaker.alias("speaker_id"), F.when(speaker.isNotNull(), F.lit("voice")).alias("attribution"),
    )


def hints(spark: SparkSession, folder: str) -> DataFrame:
    """id, meeting, sequence (of the segment), speaker_id, created_at."""
    turns = table(spark, folder, "conversations").where("turn % 4 = 1").select("conv_id", "turn")
    each = turns.select("*", F.explode(F.when(F.col("turn") % 8 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("k"))
    return each.select(
        F.concat_ws("-", "conv_id", "turn", "k").alias("id"), F.col("conv_id").alias("meeting"), F.col("turn").alias("sequence"),
        ((F.col("conv_id") + F.col("turn") + F.col("k")) % SPEAKERS).alias("speaker_id"), (F.col("turn") * 10 + F.col("k")).alias("created_at"),
    )


def speakers(spark: SparkSession, folder: str) -> DataFrame:
    """id, display_name, is_operator, confirmed, forgotten, model, model_version."""
    ids = spark.range(SPEAKERS + 4)
    return ids.select(
        "id", F.when((F.col("id") % 2 == 0) & (F.col("id") > 0), F.concat(F.lit("Name "), F.col("id").cast("string"))).alias("display_name"), (F.col("id") == 0).alias("is_operator"),
        ((F.col("id") % 2 == 0) & (F.col("id") > 0)).alias("confirmed"), (F.col("id") % 8 == 6).alias("forgotten"),
        F.when(F.col("id") % 5 != 4, F.concat(F.lit("model"), (F.col("id") % 2).cast("string"))).alias("model"), F.lit("1").alias("model_version"),
    )


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """event_id, meeting, channel, start_ms, end_ms, cluster."""
    events = table(spark, folder, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    start = ((n - 1) * TURN_SPACING_MS).cast("long")
    return events.select(
        "event_id", F.col("user_id").alias("meeting"), F.when(F.col("event_id") % 2 == 0, "mic").otherwise("system").alias("channel"),
        start.alias("start_ms"), (start + TURN_LEAST_MS + F.floor(F.col("value") * 100).cast("long") % TURN_SPREAD_MS).alias("end_ms"), F.col("event_type").alias("cluster"),
    )


def reference_spans(spark: SparkSession, folder: str) -> DataFrame:
    """meeting, speaker, start_ms, end_ms."""
    return turns(spark, folder).select("meeting", F.col("cluster").alias("speaker"), "start_ms", "end_ms")


def hypothesis_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The reference with turns dropped, shifted and renamed."""
    kept = turns(spark, folder).where("event_id % 7 <> 0")
    name = F.when(F.col("event_id") % 11 == 0, F.lit("h0")).otherwise(F.concat(F.lit("h"), F.length("cluster").cast("string")))
    return kept.select("meeting", name.alias("speaker"), (F.col("start_ms") + 200).alias("start_ms"), (F.col("end_ms") + 200).alias("end_ms"))


def turn_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments on the clock of the turns: meeting, sequence, channel, start_ms, end_ms."""
    return segments(spark, folder).select("meeting", "sequence", "channel", (F.col("start_ms") % 120_000).alias("start_ms"), (F.col("start_ms") % 120_000 + F.col("end_ms") - F.col("start_ms")).alias("end_ms"))


def exemplars(spark: SparkSession, folder: str) -> DataFrame:
    """id, speaker_id, meeting, vector, model, voiced_ms, is_negative."""
    v = F.col("vec_id")
    return table(spark, folder, "embeddings").select(
        v.alias("id"), F.col("label").cast("long").alias("speaker_id"), F.when(v % 9 != 8, v % 7).alias("meeting"), F.col("embedding").cast("array<double>").alias("vector"),
        F.concat(F.lit("model"), (v % 2).cast("string")).alias("model"), F.when(v % 19 == 0, "0").otherwise("1").alias("model_version"), (1000 + v % 13 * 700).alias("voiced_ms"), (v % 17 == 0).alias("is_negative"),
    )


def trials(spark: SparkSession, folder: str) -> DataFrame:
    """score, same."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return labels.join(docs, "doc_id").select((F.col("n_chars") % 1000 / 1000).alias("score"), (F.col("quality") == 1).alias("same"))


def queue(spark: SparkSession, folder: str) -> DataFrame:
    """meeting, priority, enqueued_at."""
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("meeting"), F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), 0).otherwise(1).alias("priority"), F.col("o_orderdate").alias("enqueued_at"))


def detections(spark: SparkSession, folder: str) -> DataFrame:
    """session, at_ms, kind, app_id: one timeline for each user."""
    kinds = F.create_map(*[F.lit(x) for pair in {"click": "MicHeld", "view": "MicReleased", "signup": "AppGone", "error": "Tick", "purchase": "CalendarEventStarted"}.items() for x in pair])
    return turns(spark, folder).select(F.col("meeting").alias("session"), F.col("start_ms").alias("at_ms"), kinds[F.col("cluster")].alias("kind"), F.concat(F.lit("app"), (F.col("event_id") % 3).cast("string")).alias("app_id"), "event_id")


#: The same tables as SQL. Each may use those before it.
SQL = {
    "meetings": """meetings AS (SELECT id,
  '2024-01-' || lpad(CAST(id % 28 + 1 AS VARCHAR), 2, '0') || 'T' || lpad(CAST(id % 12 + 2 AS VARCHAR), 2, '0') || ':' || lpad(CAST(id % 60 AS VARCHAR), 2, '0') || ':00' || z AS started_at,
  CASE WHEN id % 10 = 9 THEN NULL ELSE '2024-01-' || lpad(CAST(id % 28 + 1 AS VARCHAR), 2, '0') || 'T' || lpad(CAST(id % 12 + CASE WHEN id % 13 = 0 THEN 1 ELSE 3 END AS VARCHAR), 2, '0') || ':' || lpad(CAST(id % 60 AS VARCHAR), 2, '0') || ':00' || z END AS ended_at,
  CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'Review: Q' || CAST(id % 5 AS VARCHAR) || ' / plan' END AS title,
  CASE WHEN id % 3 = 0 THEN NULL ELSE 'App ' || CAST(id % 4 AS VARCHAR) END AS detected_app,
  CASE id % 7 WHEN 0 THEN 'not json' WHEN 1 THEN NULL ELSE '["Guest ' || CAST(id % 9 AS VARCHAR) || '","Name ' || CAST(id % 4 * 2 AS VARCHAR) || '"]' END AS attendees,
  CASE WHEN id % 5 <> 3 THEN '/audio/' || CAST(id AS VARCHAR) END AS audio_path, id % 6 <> 2 AS diarized
  FROM (SELECT DISTINCT conv_id AS id, CASE conv_id % 3 WHEN 0 THEN '-08:00' WHEN 1 THEN '+00:00' ELSE '+05:30' END AS z FROM conversations))""",
    "segments": """segments AS (SELECT conv_id AS meeting, turn AS sequence, CASE WHEN role = 'user' THEN 'mic' ELSE 'system' END AS channel,
  CAST(60 * coalesce(sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms,
  CAST(60 * sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS end_ms, text,
  CASE WHEN turn % 5 <> 4 THEN (conv_id * 7 + turn * 3) % 11 END AS speaker_id, CASE WHEN turn % 5 <> 4 THEN 'voice' END AS attribution FROM conversations)""",
    "hints": """hints AS (SELECT conv_id || '-' || turn || '-' || k AS id, conv_id AS meeting, turn AS sequence, (conv_id + turn + k) % 11 AS speaker_id, turn * 10 + k AS created_at
  FROM conversations, (VALUES (0), (1)) AS t(k) WHERE turn % 4 = 1 AND (k = 0 OR turn % 8 = 1))""",
    "speakers": """speakers AS (SELECT id, CASE WHEN id % 2 = 0 AND id > 0 THEN 'Name ' || id END AS display_name, id = 0 AS is_operator, id % 2 = 0 AND id > 0 AS confirmed, id % 8 = 6 AS forgotten,
  CASE WHEN id % 5 <> 4 THEN 'model' || id % 2 END AS model, '1' AS model_version FROM range(15) AS r(id))""",
    "effective": """effective AS (SELECT s.*, coalesce(h.speaker_id, s.speaker_id) AS who, CASE WHEN h.meeting IS NOT NULL THEN 'operator' ELSE s.attribution END AS how
  FROM segments s LEFT JOIN (SELECT * FROM hints QUALIFY row_number() OVER (PARTITION BY meeting, sequence ORDER BY created_at DESC, id DESC) = 1) h USING (meeting, sequence))""",
    "heard": """heard AS (SELECT DISTINCT meeting, speaker_id FROM (SELECT meeting, speaker_id FROM segments UNION ALL SELECT meeting, speaker_id FROM hints) WHERE speaker_id IS NOT NULL)""",
    "turns": """turns AS (SELECT event_id, user_id AS meeting, CASE WHEN event_id % 2 = 0 THEN 'mic' ELSE 'system' END AS channel, start_ms,
  start_ms + 500 + CAST(floor(value * 100) AS BIGINT) % 6000 AS end_ms, event_type AS cluster
  FROM (SELECT *, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 1500 AS BIGINT) AS start_ms FROM events))""",
    "reference": "reference AS (SELECT meeting, cluster AS speaker, start_ms, end_ms FROM turns)",
    "hypothesis": """hypothesis AS (SELECT meeting, CASE WHEN event_id % 11 = 0 THEN 'h0' ELSE 'h' || length(cluster) END AS speaker, start_ms + 200 AS start_ms, end_ms + 200 AS end_ms FROM turns WHERE event_id % 7 <> 0)""",
    "turn_segments": """turn_segments AS (SELECT meeting, sequence, channel, start_ms % 120000 AS start_ms, start_ms % 120000 + end_ms - start_ms AS end_ms FROM segments)""",
    "exemplars": """exemplars AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS speaker_id, CASE WHEN vec_id % 9 <> 8 THEN vec_id % 7 END AS meeting, CAST(embedding AS DOUBLE[]) AS vector, 'model' || vec_id % 2 AS model,
  CASE WHEN vec_id % 19 = 0 THEN '0' ELSE '1' END AS model_version, 1000 + vec_id % 13 * 700 AS voiced_ms, vec_id % 17 = 0 AS is_negative FROM embeddings)""",
    "trials": """trials AS (SELECT n_chars % 1000 / 1000.0::DOUBLE AS score, quality = 1 AS same FROM labels JOIN documents USING (doc_id))""",
    "queue": """queue AS (SELECT o_orderkey AS meeting, CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 0 ELSE 1 END AS priority, o_orderdate AS enqueued_at FROM orders)""",
}


def sql(query: str, *names: str) -> str:
    """query over the named tables."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n" + query
