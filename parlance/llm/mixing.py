"""Mixing sources to target weights by Poisson replication.

Each source gets a repetition rate: its target share of all characters, divided by its own share. A document of that
source is repeated k times, where k inverts the Poisson distribution of that mean at a number in [0, 1) drawn by hashing
the seed and the document's id. Copies are then spread at random over all partitions, in random order.

Without given targets, a source's weight is its number of characters to the power TEMPERATURE: large sources are held
back, small ones repeated. The totals stay the same on average.

DataFrame functions only. Only (source, rate, cumulative probabilities) is joined to the documents; if there are more
than BROADCAST_SOURCES sources, by a shuffle on source, which adaptive execution splits where one source is hot.

Defined cases: a null source is a source of its own. A source without any characters has rate 1. A source that given
targets don't name has rate 0 and goes. A null id is drawn like an empty one; rows that repeat an id are drawn alike.
Null and empty texts weigh nothing and are repeated at their source's rate. Texts are never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.arrow import free
from parlance.llm.storage import saved

SEED = 1
TEMPERATURE = 0.5
BROADCAST_SOURCES = 10_000
#: Cumulative probabilities go so many deviations and steps beyond the mean: to the last bit of a double.
DEVIATIONS, STEPS = 12, 30


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of a digest of the parts, joined by |."""
    text = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cumulative(rate: Column) -> Column:
    """P(k or fewer) for k from 0 on, as an array; logarithms keep large rates from underflow."""
    steps = F.sequence(F.lit(1), (F.ceil(rate + DEVIATIONS * F.sqrt(rate)) + STEPS).cast("int"))
    start = F.struct((-rate).alias("log"), F.array(F.exp(-rate)).alias("sums"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.log(rate) - F.log(k.cast("double"))
        return F.struct(log.alias("log"), F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + F.exp(log))).alias("sums"))

    return F.when(rate > 0, F.aggregate(steps, start, step)["sums"]).otherwise(F.array(F.lit(1.0)))


def rates(docs: DataFrame, source: str = "source", text: str = "text", targets: dict[str, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, mass, rate) of each source."""
    mass = docs.groupBy(F.col(source).alias("source")).agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("long").alias("mass"))
    if targets is None:
        weight = F.sqrt("mass") if temperature == 0.5 else F.pow("mass", F.lit(temperature))
    else:
        weight = F.lit(0.0)
        for name, w in sorted(targets.items()):
            weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    weighed = mass.withColumn("weight", F.when(F.col("mass") > 0, weight).otherwise(F.lit(0.0)))
    total = weighed.agg(F.sum("mass").alias("all_mass"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("mass") == 0, F.lit(1.0)).when(F.col("all_weight") == 0, F.lit(0.0)).otherwise(F.col("weight") * F.col("all_mass") / F.col("all_weight") / F.col("mass"))
    return weighed.crossJoin(F.broadcast(total)).select("source", "mass", rate.alias("rate"))  # total is one row


def mixed(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", targets: dict[str, float] | None = None,
    temperature: float = TEMPERATURE, seed: int = SEED, names: tuple[str, str, str] = ("copy", "rate", "place"),
) -> DataFrame:
    """docs repeated and shuffled, with the number of the copy (from 1), the rate, and the number in [0, 1) that gives each row its place.

    These three have the given names; columns of docs that have them too are replaced.
    """
    copy, rate, place = names
    found = saved(rates(docs, source, text, targets, temperature), "rates")  # a row a source, read several times
    of, sums, u, n = (free(f"__{c}", [*docs.columns, *names]) for c in ("source", "sums", "u", "n"))
    known = found.select(F.col("source").alias(of), F.col("rate").alias(rate), cumulative(F.col("rate")).alias(sums))
    if found.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        known = F.broadcast(known)
    kept = docs.drop(*names)
    drawn = kept.join(known, kept[source].eqNullSafe(known[of])).withColumn(u, uniform(F.lit(seed), doc_id))
    drawn = drawn.withColumn(n, F.size(F.filter(sums, lambda p: p <= F.col(u)))).where(F.col(n) > 0)
    copies = drawn.select(*[F.col(f"`{c}`") for c in kept.columns], rate, F.explode(F.sequence(F.lit(1), F.col(n))).alias(copy))
    return copies.withColumn(place, uniform(F.lit(seed + 1), doc_id, copy)).repartition(place).sortWithinPartitions(place)
