"""What a diarized meeting leaves in the record, as steps over whole tables.

Meetings of one call see the voices as they were before it, so they can be done all at once; a meeting a call is the same as one after another.
Each step's result is written before the next goes on from it. Speakers and evidence are made with ids from what they stand for, so the same call done twice leaves the same tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators import matching, registry, upkeep
from parlance.sources.versions import kept

PRINTS = ("speaker_id", "model", "model_version", "vector", "n")


def refreshed(prints: DataFrame, exemplars: DataFrame, touched: DataFrame) -> DataFrame:
    """Voiceprints with those of touched (speaker_id) made anew from the exemplars that are left; whoever has none left has no print."""
    who = touched.select("speaker_id").distinct()
    fresh = upkeep.voiceprints(exemplars.join(who, "speaker_id", "left_semi"))
    return prints.select(*PRINTS).join(who, "speaker_id", "left_anti").unionByName(fresh.select(*PRINTS))


def withheld(speakers: DataFrame, gates: DataFrame) -> DataFrame:
    """(meeting, speaker_id): the operator, where it isn't enrolled and a meeting's gate (meeting, gate, enrolled) is shut.

    Shut means that a match would say nothing; so the operator's print takes no part at all there.
    """
    operator = speakers.where("is_operator").agg(F.min("id").alias("speaker_id")).where("speaker_id IS NOT NULL")
    return gates.where(~F.col("gate") & ~F.col("enrolled")).select("meeting").crossJoin(F.broadcast(operator))  # one row


@dataclass(frozen=True)
class Record:
    speakers: DataFrame
    exemplars: DataFrame
    prints: DataFrame


def persisted(
    record: Record, clusters: DataFrame, heard: DataFrame, claims: DataFrame, held_back: DataFrame, reseeded: DataFrame, run: int,
    floor: float = matching.MATCH_FLOOR, margin: float = matching.MATCH_MARGIN,
) -> tuple[Record, DataFrame]:
    """The record after the meetings of heard (meeting, cluster) were diarized, and (meeting, cluster, speaker_id, minted).

    clusters: (meeting, cluster, model, model_version, vector, voiced_ms); claims: (meeting, cluster, speaker_id); held_back: (meeting, speaker_id);
    reseeded: (meeting, speaker_id) whose evidence was rebuilt already. run is greater than any exemplar's id.

    1. Anonymous voices lose what the machine took from these meetings, or they would be recognised by their own sound.
    2. Prints of that, but for those held back, are matched with clusters that nobody claims.
    3. Heard clusters are claimed, matched, or new if long enough.
    4. What the machine took from a meeting is replaced by what it takes now, and prints are made anew.
    """
    meetings = heard.select("meeting").union(clusters.select("meeting")).distinct()
    unknown = record.speakers.where(registry.anonymous()).select(F.col("id").alias("speaker_id"))
    machine = record.exemplars.where("source = 'machine'").join(meetings, "meeting", "left_semi")
    withdrawn = machine.join(unknown, "speaker_id", "left_semi").select("id", "speaker_id")
    withdrawn = kept(withdrawn, "withdrawn")
    left = record.exemplars.join(withdrawn.select("id"), "id", "left_anti")
    prints = kept(refreshed(record.prints, left, withdrawn), "prints")

    seeds = prints.join(record.speakers.select(F.col("id").alias("speaker_id"), "confirmed"), "speaker_id")
    open_ones = clusters.join(claims, ["meeting", "cluster"], "left_anti")
    scores = matching.scored(open_ones, seeds).join(held_back, ["meeting", "speaker_id"], "left_anti")
    found = matching.resolved(scores, floor, margin).select("meeting", "cluster", F.col("speaker_id").alias("matched"))
    free = open_ones.join(heard, ["meeting", "cluster"], "left_semi").join(found, ["meeting", "cluster"], "left")
    named = free.where(F.col("matched").isNotNull() | (F.col("voiced_ms") >= upkeep.LEAST_SPEAKER_MS))
    named = named.withColumn("speaker_id", F.coalesce("matched", upkeep.digest_id("meeting", "cluster"))).withColumn("minted", F.col("matched").isNull())
    named = kept(named, "voices")
    claimed = claims.join(heard, ["meeting", "cluster"], "left_semi").select("meeting", "cluster", "speaker_id", F.lit(False).alias("minted"))
    assigned = named.select("meeting", "cluster", "speaker_id", "minted").unionByName(claimed)

    new = named.where("minted").select(F.col("speaker_id").alias("id"), F.lit(False).alias("is_operator"), F.lit(False).alias("confirmed"), F.lit(False).alias("forgotten"))
    speakers = record.speakers.unionByName(new.join(record.speakers.select("id"), "id", "left_anti"), allowMissingColumns=True)
    heard_now = named.join(reseeded, ["meeting", "speaker_id"], "left_anti")
    old = left.where("source = 'machine'").join(heard_now.select("meeting", "speaker_id"), ["meeting", "speaker_id"], "left_semi").select("id")
    # later runs have greater ids, so the newest evidence is the last
    ident = F.lit(run).cast("long") + F.pmod(upkeep.digest_id("meeting", "cluster"), F.lit(1 << 40))
    fresh = heard_now.select(ident.alias("id"), "speaker_id", "meeting", "vector", "model", "model_version", "voiced_ms", F.lit(False).alias("is_negative"), F.lit("machine").alias("source"))
    exemplars = kept(left.join(old, "id", "left_anti").unionByName(fresh, allowMissingColumns=True), "evidence")
    return Record(speakers, exemplars, kept(refreshed(prints, exemplars, heard_now), "prints")), assigned


def attached(record: Record, segments: DataFrame, hints: DataFrame, assigned: DataFrame, found: DataFrame) -> tuple[Record, DataFrame, DataFrame]:
    """Record, segments and hints once the voices of found (meeting, cluster) are the operator's.

    They are folded into the operator there is, else into the first of them. A named one is left as it is. One speaker bears the mark.
    """
    mine = found.join(assigned, ["meeting", "cluster"]).select("meeting", "cluster", "speaker_id")
    first = mine.agg(F.min_by("speaker_id", F.struct("meeting", "cluster")).alias("first"))
    operator = record.speakers.where("is_operator").agg(F.min("id").alias("operator"))
    target = first.crossJoin(operator).select(F.when(F.col("first").isNotNull(), F.coalesce("operator", "first")).alias("into"))  # one row
    target = kept(target, "operator")
    asked = kept(mine.select(F.col("speaker_id").alias("source")).distinct().crossJoin(F.broadcast(target)).where("source <> into"), "asked")
    # what is joined away can't be a target here, so the operator's own mark is all that matters
    speakers, segments, hints, exemplars = registry.speakers_joined(record.speakers, segments, hints, record.exemplars, asked)
    flag = F.when(F.col("into").isNull(), F.col("is_operator")).otherwise(F.col("id") == F.col("into"))
    speakers = speakers.crossJoin(F.broadcast(target)).withColumn("is_operator", flag).drop("into")
    moved = registry.allowed_joins(record.speakers, asked)
    touched = moved.select(F.explode(F.array("source", "into")).alias("speaker_id"))
    return Record(speakers, exemplars, refreshed(record.prints, exemplars, touched)), segments, hints


def wiped(record: Record) -> Record:
    """A new model's space: no vectors and no evidence of the old one; names, confirmations and the prints' stamps stay, so what is stale can be told."""
    return Record(record.speakers, record.exemplars.where("false"), record.prints.withColumn("vector", F.lit(None).cast(record.prints.schema["vector"].dataType)).withColumn("n", F.lit(0).cast("long")))


def adopted(record: Record, rebuilt: DataFrame) -> Record:
    """Vectors made anew are taken over, those without one go, and prints of all whom that touches are refreshed."""
    touched = record.exemplars.join(rebuilt.select("id"), "id", "left_semi").select("speaker_id")
    exemplars = upkeep.adopted(record.exemplars, rebuilt)
    return Record(record.speakers, exemplars, refreshed(record.prints, exemplars, touched))
