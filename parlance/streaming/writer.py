"""The transcript writer, a sink that gives each meeting's segments their sequences, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.sources.versions import Versions

SEGMENTS = "meeting long, channel string, start_ms long, end_ms long, text string, sequence long, batch long"
HEADS = "meeting long, last long"
#: Last sequences are gathered into one table once in so many versions.
FOLDED_EVERY = 64


def heads(tables: Versions, at: int) -> DataFrame:
    return tables.table("heads", HEADS, at).groupBy("meeting").agg(F.max("last").alias("last"))


def write_batch(tables: Versions, batch: DataFrame, batch_id: int, order: tuple[str, ...] = ("arrived",), writer: str = "transcript") -> None:
    """Append a batch in order, numbered on from each meeting's last sequence. A batch that was written before is left out.

    The version that holds the rows holds the batch's tag and the new last sequences too, so a crash leaves all or nothing. Only the
    last sequences are read back, not the segments.
    """
    tag = f"{writer}-{batch_id}"

    def change(seen: int) -> dict:
        last = heads(tables, seen)
        place = F.row_number().over(Window.partitionBy("meeting").orderBy(*order)).cast("long")
        mine = last.join(batch.select("meeting").distinct(), "meeting", "left_semi")
        rows = batch.withColumn("n", place).join(mine, "meeting", "left").withColumn("sequence", F.coalesce("last", F.lit(-1)) + F.col("n"))
        rows = rows.withColumn("batch", F.lit(batch_id).cast("long")).select("meeting", "channel", "start_ms", "end_ms", "text", "sequence", "batch")
        new = rows.groupBy("meeting").agg(F.max("sequence").alias("last"))
        if (seen + 1) % FOLDED_EVERY:
            return {"added": {"segments": rows, "heads": new}, "tag": tag}
        return {"added": {"segments": rows}, "replaced": {"heads": last.unionByName(new).groupBy("meeting").agg(F.max("last").alias("last"))}, "tag": tag}

    if not tables.tagged(tag):
        batch = batch.persist()
        try:
            tables.changed(change)
        finally:
            batch.unpersist()


def writing(stream: DataFrame, tables: Versions, checkpoint: str, order: tuple[str, ...] = ("arrived",), writer: str = "transcript"):
    """The sink of a stream of segments (meeting, channel, start_ms, end_ms, text and the columns of order); start() it."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: write_batch(tables, batch, n, order, writer))
