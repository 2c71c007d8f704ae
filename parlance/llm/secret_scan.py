"""Secrets in texts: fixed patterns, and strings that look random to character Markov models.

Two first-order models over letters, digits and a few signs are trained from labelled samples, one of random strings and
one of ordinary identifiers: words, and names made of them as code and prose have them (camelCase, CONSTANTS, paths, titles with
hyphens, names with years, numbers, rulers). A candidate, a run of LEAST_RUN or more such characters, is a secret if the
log-likelihood ratio of the two models is over THRESHOLD, and over RATE for each of its transitions, so that a long
ordinary name doesn't add up to a secret. Such spans are added where they don't overlap a span of the patterns.

DataFrame functions only. Spans are places of code points, end exclusive.

Defined cases: a null text is scanned like an empty one and has no spans; rows are scanned each by itself; texts are
scanned whole. Without any sample of a class, all its transitions are equally likely.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns: kind, pattern, group whose length counts, least length. In the order in which kinds are listed.
#: Where a match is a whole run of characters, the least length is in the pattern too, so that few matches are built.
PATTERNS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+", 0, 32),
)
RANDOM = "random"
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST_RUN = 12
RUN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}+"
#: Natural logarithm of how much likelier a secret must be under the model of random strings, in all and for each transition.
THRESHOLD, RATE = 20.0, 2.5
#: Matches of a text whose places are added up at once.
GROUP = 64
#: Bounds of the labelled samples that a query trains from.
SAMPLED_DOCS, RANDOM_STRINGS = 512, 4096


SPANS = "array<struct<start:int,kind:int,end:int>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, kind, end>> of the leftmost matches that don't overlap, without those too short.

    Places are added up within groups of matches and then over the groups, so a text of many matches costs no square of them.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(counted, F.length).alias("counted"))
    none = F.expr(f"cast(array() as {SPANS})")

    def step(acc: Column, row: Column) -> Column:
        begin = acc["at"] + row["gap"]
        end = begin + F.coalesce(row["size"], F.lit(0))
        one = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(row["counted"] >= least, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    def moved(part: Column, by: Column) -> Column:
        return F.transform(part, lambda f: F.struct((f["start"] + by).alias("start"), f["kind"].alias("kind"), (f["end"] + by).alias("end")))

    def over(acc: Column, part: Column) -> Column:
        one = F.array(F.struct(acc["at"].alias("by"), part["found"].alias("found")))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["parts"], one).alias("parts"))

    start = F.struct(F.lit(0).alias("at"), none.alias("found"))
    first = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<struct<by:int,found:{SPANS}>>)").alias("parts"))
    groups = lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / GROUP).cast("int")), lambda g: F.aggregate(F.slice(r, g * GROUP + 1, F.lit(GROUP)), start, step))
    found = bound(rows, lambda r: F.flatten(F.transform(F.aggregate(groups(r), first, over)["parts"], lambda p: moved(p["found"], p["by"]))))
    return F.when(text.rlike(pattern), found).otherwise(none)


def sample_random(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    """(sample, label) of n random strings in the usual alphabets, by digests of numbers."""
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")).cast("binary"), 256)
    coded = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    kind = F.col("id") % 4
    sample = F.when(kind == 0, digest).when(kind == 1, F.upper(F.translate(coded, "+/", ""))).when(kind == 2, F.translate(coded, "+/", "-_")).otherwise(coded)
    return spark.range(n).select(sample.alias("sample"), F.lit(RANDOM).alias("label"))


def named(a: Column, b: Column, c: Column, i: Column) -> Column:
    """A name of three words in the i-th manner."""
    year = (F.lit(1990) + i * 7 % 60).cast("string")
    month = F.lpad((i % 12 + 1).cast("string"), 2, "0")
    number = F.abs(F.xxhash64(a, b, i)).cast("string")
    manners = [
        F.concat_ws("_", a, b), F.concat(a, F.initcap(b), F.initcap(c)), F.concat(F.initcap(a), F.initcap(b), F.initcap(c)), F.upper(F.concat_ws("_", a, b, c)),
        F.concat_ws("/", a, b, c), F.concat_ws("-", a, b, c), F.concat_ws("_", a, b, year), F.concat_ws("-", a, year, month),
        F.concat(F.substring(number, F.lit(1), i % 14 + 4), F.lit("")), F.concat(F.lit("/"), a, F.lit("/"), b, F.lit("-"), c), F.concat(F.upper(F.substring(a, 1, 3)), F.lit("-"), F.substring(number, 1, 4)), F.repeat(F.substring(F.lit("-=_/+"), (i / 12 % 5 + 1).cast("int"), F.lit(1)), F.lit(24)),
    ]
    return F.element_at(F.array(*manners), (i % len(manners) + 1).cast("int"))


def sample_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = SAMPLED_DOCS) -> DataFrame:
    """(sample, label) of ordinary identifiers: the words of n texts drawn by hash, and names made of each three of them.

    Rows that repeat id and text are drawn once; a null id is drawn like others.
    """
    rows = docs.select(F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("h"), F.col(text).alias("text"))
    drawn = rows.select("h").distinct().orderBy("h").limit(n)
    texts = rows.join(F.broadcast(drawn), "h").groupBy("h").agg(F.first("text").alias("text"))
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,19}"), F.lit(0))

    def all_of(w: Column) -> Column:
        later = lambda k: F.slice(w, k, F.greatest(F.size(w), F.lit(1)))
        three = F.arrays_zip(w.alias("a"), later(2).alias("b"), later(3).alias("c"))
        return F.concat(w, F.transform(three, lambda r, i: named(r["a"], F.coalesce(r["b"], r["a"]), F.coalesce(r["c"], r["a"]), i)))

    return texts.select(F.explode(bound(words, all_of)).alias("sample"), F.lit("word").alias("label"))


def train(samples: DataFrame, sample: str = "sample", label: str = "label", weight: float = 4.0) -> list[float]:
    """Log-likelihood ratios of all transitions, row by row; samples not labelled `random` are ordinary.

    A transition's counts are smoothed by weight times how often its second sign follows any other, so that signs that a
    class hardly has are unlikely in it after any sign. The driver gets at most two counts for each pair of signs.
    """
    steps = F.transform(F.sequence(F.lit(1), F.length(sample) - 1), lambda i: F.substring(F.col(sample), i, F.lit(2)))
    pairs = samples.where(F.length(sample) > 1).select((F.col(label) == RANDOM).alias("random"), F.explode(steps).alias("pair"))
    rows = pairs.where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {(bool(r["random"]), r["pair"]): r["n"] for r in rows}
    logs = []
    for kind in (True, False):
        follows = [sum(n.get((kind, a + b), 0) for a in SIGNS) + 0.5 for b in SIGNS]
        share = [x / sum(follows) for x in follows]
        total = [sum(n.get((kind, a + b), 0) for b in SIGNS) for a in SIGNS]
        logs.append([math.log((n.get((kind, a + b), 0) + weight * share[j]) / (total[i] + weight)) for i, a in enumerate(SIGNS) for j, b in enumerate(SIGNS)])
    return [x - y for x, y in zip(*logs, strict=True)]


def ratio(run: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a run of signs under the table of transitions."""
    lookup = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")
    places = F.transform(F.split(run, ""), lambda c: F.position(c, F.lit(SIGNS)))
    steps = F.zip_with(places, F.slice(places, F.lit(2), F.size(places)), lambda x, y: F.element_at(lookup, (x - 1) * len(SIGNS) + y))
    return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def is_random(run: Column, table: list[float], threshold: float = THRESHOLD, rate: float = RATE) -> Column:
    return bound(ratio(run, table), lambda x: (x > threshold) & (x > rate * (F.length(run) - 1)))


def scan(docs: DataFrame, table: list[float], text: str = "text", threshold: float = THRESHOLD, rate: float = RATE) -> DataFrame:
    """docs with base_spans and model_spans, arrays of (start, kind, end); kind counts PATTERNS, then the model's."""
    kept = docs.drop("base_spans", "model_spans")
    whole = F.coalesce(F.col(text), F.lit(""))
    base = F.array_sort(F.concat(*[spans(whole, i, pattern, group, least) for i, (_, pattern, group, least) in enumerate(PATTERNS)]))
    runs = spans(whole, len(PATTERNS), RUN, 0, LEAST_RUN)
    random = F.filter(runs, lambda r: is_random(F.substring(whole, r["start"] + 1, r["end"] - r["start"]), table, threshold, rate))
    apart = F.filter("runs", lambda r: ~F.exists("base_spans", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return kept.withColumn("base_spans", base).withColumn("runs", random).withColumn("model_spans", apart).drop("runs")


def written(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(name) for name, *_ in PATTERNS], F.lit("random"))
    return F.array_join(F.transform(found, lambda r: F.concat_ws(":", F.element_at(names, r["kind"] + 1), r["start"].cast("string"), r["end"].cast("string"))), ",")


def of_kind(found: Column, name: str) -> Column:
    kind = [n for n, *_ in PATTERNS].index(name)
    return F.size(F.filter(found, lambda r: r["kind"] == kind)).cast("long")
