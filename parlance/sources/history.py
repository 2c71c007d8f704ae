"""Documents and the search index of a history, kept as tables and replaced meeting by meeting.

A commit of `Versions` holds, for the meetings that it rebuilds, their documents, their words, how many words they have, and which
generation of changes that was. So a document, what is found of it and its acknowledgement change at once. What a
meeting had before is out of date by its version, and a renamed document is the same row with another name.

Words are in folders by digest of the term, sorted by term in their files: a search reads the folders of its words, and of these files the row groups that can
hold them. Numbers of words are a table of their own, so ranking reads no other words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators import search
from parlance.sources.versions import Versions, logged

DOCUMENTS = "meeting long, name string, markdown string, words long"
POSTINGS = "meeting long, field int, position int, term string, bucket int"
DIRTY = "meeting long, generation long, acknowledged long"
#: Folders of words, and into how many tasks the words of one folder are dealt when they are written.
BUCKETS, DEALT = 64, 4


def bucket(term) -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class History:
    """The documents and the index under one folder."""

    def __init__(self, tables: Versions) -> None:
        self.tables = tables

    def publish(self, documents: DataFrame, removed: DataFrame | None = None, generations: DataFrame | None = None) -> int:
        """Replace what is there of the meetings of documents (meeting, name, markdown, title, body), and drop removed (meeting), also where both name one.

        generations: (meeting, generation) that these documents were made from; no other change is acknowledged.
        """
        rows = (documents if removed is None else documents.join(removed.select("meeting").distinct(), "meeting", "left_anti")).persist()
        words = search.postings(rows, "meeting", "title", "body")
        sizes = words.groupBy("meeting").agg(F.count(F.lit(1)).alias("words"))
        shown = logged(rows.join(sizes, "meeting", "left").select("meeting", "name", "markdown", F.coalesce("words", F.lit(0)).cast("long").alias("words")))
        if removed is not None:
            shown = shown.unionByName(logged(removed.select("meeting"), gone=True), allowMissingColumns=True)
        words = words.withColumn("field", F.col("field").cast("int")).withColumn("bucket", bucket("term"))
        words = words.repartition("bucket", F.pmod(F.xxhash64("meeting"), F.lit(DEALT))).sortWithinPartitions("bucket", "term")
        added = {"documents": shown, "postings": (words, ["bucket"])}
        if generations is not None:
            added["acknowledged"] = generations.select("meeting", "generation")
        try:
            return self.tables.changed(lambda seen: {"added": added})
        finally:
            rows.unpersist()

    def documents(self, at: int | None = None) -> DataFrame:
        """(meeting, name, markdown, words, version): the documents there are."""
        return self.tables.current("documents", DOCUMENTS, "meeting", at=at)

    def acknowledged(self, at: int | None = None) -> DataFrame:
        """(meeting, acknowledged): the last generation of changes that each document shows."""
        return self.tables.table("acknowledged", "meeting long, generation long", at).groupBy("meeting").agg(F.max("generation").alias("acknowledged"))

    def lengths(self, at: int | None = None) -> DataFrame:
        rows = self.tables.table("documents", "meeting long, words long, gone boolean", at)
        newest = rows.groupBy("meeting").agg(F.max_by(F.struct("words", "gone", "version"), F.struct("version", F.coalesce("gone", F.lit(False)))).alias("r"))
        return newest.where("r.gone IS NOT TRUE AND r.words > 0").select("meeting", F.col("r.words").alias("size"), "r.version")

    def index(self, terms: list[str], at: int | None = None) -> DataFrame:
        """(meeting, field, term, position) of these words in documents that are up to date."""
        folders = [bucket(F.lit(w)) for w in terms]
        rows = self.tables.table("postings", POSTINGS, at).where(F.col("bucket").isin(*folders) & F.col("term").isin(*terms))
        return rows.join(self.lengths(at), ["meeting", "version"], "left_semi").drop("bucket", "version")

    def search(self, query: str, limit: int = 25, at: int | None = None) -> DataFrame:
        """(meeting, score, hits): T2, T3 over the stored index."""
        terms = sorted({w for p in search.phrases(query) for w in p})
        return search.search(self.index(terms or [""], at), query, limit, "meeting", self.lengths(at).drop("version"))

    def folded(self) -> int:
        """Rewrite both tables without what is out of date."""

        def change(seen: int) -> dict:
            live = self.lengths(seen).select("meeting", "version")
            words = self.tables.table("postings", POSTINGS, seen).join(live, ["meeting", "version"], "left_semi")
            words = words.drop("version").repartition("bucket", F.pmod(F.xxhash64("meeting"), F.lit(DEALT))).sortWithinPartitions("bucket", "term")
            return {"replaced": {"documents": logged(self.documents(seen).drop("version")), "postings": (words, ["bucket"])}}

        return self.tables.changed(change)
