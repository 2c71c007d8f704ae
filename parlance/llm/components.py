"""Connected components of an undirected graph, by hooking to the smallest neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.storage import saved

#: A component's vertices at least halve each round, so this covers any graph.
MOST_ROUNDS = 64
#: A hub's links are joined in so many groups.
SALTS = 16


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join of which neither side is broadcast.

    Spark takes a table for as large as its compressed files, an array for one element and rows after an explode for as many as before, so it
    would send hundreds of MB through the driver.
    """
    return df.hint("merge")


def salted_join(many: DataFrame, few: DataFrame, key: str, by: str, salts: int = SALTS, how: str = "inner") -> DataFrame:
    """many.join(few, key), where a key may have very many rows in many, told apart by the column `by`: few is repeated for each salt."""
    spread = many.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return spread.join(few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [key, "salt"], how).drop("salt")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b: long): the smallest node of its component.

    Every vertex takes its smallest neighbour as parent if that is smaller, links are redrawn between parents, and so on
    until no link joins two vertices. Minima are added up before each shuffle, so a hub is no hot spot. Loops, repeated
    links and an empty table are fine. Joins on a hub or on the root of a large component are salted. The links are read
    several times, so they are best a saved table.
    """
    edges, labels = links.where("a <> b").select("a", "b"), None
    for _ in range(MOST_ROUNDS):
        if edges.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else saved(labels, "labels")
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        parents = both.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("parent")).select("root", F.least("root", "parent").alias("parent"))
        jump = parents.select(F.col("root").alias("parent"), F.col("parent").alias("above"))
        parents = saved(parents.join(shuffled(jump), "parent", "left").select("root", F.coalesce("above", "parent").alias("parent")), "parents")
        if labels is None:  # every node has a link
            labels = parents.select(F.col("root").alias("node"), F.col("parent").alias("root"))
        else:
            labels = salted_join(shuffled(labels), parents, "root", "node", how="left").select("node", F.coalesce("parent", "root").alias("root"))
        pa = parents.select(F.col("root").alias("a"), F.col("parent").alias("pa"))
        pb = parents.select(F.col("root").alias("b"), F.col("parent").alias("pb"))
        moved = salted_join(shuffled(salted_join(shuffled(edges), pa, "a", "b")), pb, "b", "a").where("pa <> pb")
        edges = saved(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
    raise RuntimeError(f"components: links are left after {MOST_ROUNDS} rounds")


def joined_further(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, root) after further links (a, b) between their roots. Only those roots are worked on, not the links that made them."""
    moved = components(links).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return saved(salted_join(shuffled(labels), moved, "root", "node", how="left").select("node", F.coalesce("to", "root").alias("root")), "labels")
