"""URL filtering: host and path rules, and boosted trees on lexical features for what no rule fits.

A rule is a host and a path prefix; it fits that host and its subdomains. The longest rule that fits decides. Other URLs
are judged by gradient-boosted trees over length, depth, digit ratio, entropy, parameter counts and statistics of the
host's suffix and the path's first segment, trained from labelled URLs.

DataFrame functions and Spark's own boosted trees only. The rates that the trees are trained on are those of the other folds of the labelled URLs.

Defined cases: a null URL, or one without ://, has an empty host and path, fits no rule and is judged by the trees like
any other. Of rules of equal length, the one with the longer host decides, then the alphabetically first. If the labels
have one class, it is the verdict; without any labels it is allow. Repeated rows are judged each by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.storage import saved

ALLOW, BLOCK = "allow", "block"
#: The trees are trained from at most so many labelled URLs, those of the smallest hashes.
SAMPLED_URLS = 16_384
TREES, DEPTH = 15, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labels added to each suffix's own, spread as all labels are.
PRIOR = 8.0
#: While the trees are trained, a URL's rates come from the labels of the other folds, so they can't tell its own label.
FOLDS = 5
FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digits", "entropy", "parameters", "hyphens", "suffix_rate", "segment_rate")


def host_of(url: Column) -> Column:
    """What is between the first :// and /, ?, # or the end, A to Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest (verdict, rule) that fits, null if none does; a rule is written host/path."""
    parts = [(rule, verdict, *rule.partition("/")[::2]) for verdict, rule in rules]
    parts.sort(key=lambda p: (-len(p[0]), -len(p[2]), p[0]))
    fits = [(rule, verdict, ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)) for rule, verdict, h, p in parts]
    none = F.lit(None).cast("string")
    name, said = none, none
    for rule, verdict, fit in reversed(fits):
        name, said = F.when(fit, F.lit(rule)).otherwise(name), F.when(fit, F.lit(verdict)).otherwise(said)
    return name, said


def count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")


def entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c == "", F.lit(0.0)).otherwise(-share(c) * F.log2(share(c))))
    return F.when(n > 0, F.aggregate(bits, F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0)))).otherwise(F.lit(0.0))


def lexical(urls: DataFrame, url: str) -> DataFrame:
    """urls with the features that need no training, and the keys of those that do."""
    u, host, path = F.coalesce(F.col(url), F.lit("")), host_of(F.col(url)), path_of(F.col(url))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    made = {
        "url_length": F.length(u).cast("double"), "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
        "depth": count_of(path, "/"), "labels": count_of(host, "."), "digits": count_of(u, "0123456789") / F.greatest(F.length(u), F.lit(1)), "entropy": entropy(u),
        "parameters": F.when(query == "", F.lit(0.0)).otherwise(1.0 + count_of(query, "&")), "hyphens": count_of(u, "-"),
        "suffix_key": F.regexp_extract(host, r"([^.]*)$", 1), "segment_key": F.regexp_extract(path, r"^/([^/]*)", 1),
    }
    return urls.withColumns(made)


@dataclass
class Judge:
    """model is None if the labels have fewer than two classes; verdict is then theirs."""

    model: object
    verdict: str
    base: float
    rates: dict[str, DataFrame]

    def features(self, urls: DataFrame, url: str) -> DataFrame:
        """urls with one vector; rates have at most SAMPLED_URLS rows, so they are broadcast."""
        return vectors(lexical(urls, url), self.rates, self.base)

    def judged(self, urls: DataFrame, key: str, url: str) -> DataFrame:
        """(key, url, verdict)."""
        only = urls.select(F.col(key).alias("key"), F.col(url).alias("url"))
        if self.model is None:
            return only.withColumn("verdict", F.lit(self.verdict))
        found = self.model.transform(self.features(only, "url"))
        return found.select("key", "url", F.when(F.col("prediction") > 0.5, BLOCK).otherwise(ALLOW).alias("verdict"))


def vectors(made: DataFrame, rates: dict[str, DataFrame], base: float, *also: str) -> DataFrame:
    """made, from lexical, with its rates by key (and the columns also) and all features as one vector."""
    for name, known in rates.items():
        made = made.join(F.broadcast(known), [f"{name}_key", *also], "left").withColumn(f"{name}_rate", F.coalesce(f"{name}_rate", F.lit(base)))
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(made)


def fold_of(url: str = "url") -> Column:
    return F.pmod(F.xxhash64(url, F.lit(FOLDS)), F.lit(FOLDS)).cast("int")


def rates_of(keys: DataFrame, name: str, base: float) -> tuple[DataFrame, DataFrame]:
    """(key, rate) over all rows of keys (with url and label), and (key, fold, rate) over those outside each fold."""
    key, rate = f"{name}_key", lambda s, n: ((s + PRIOR * base) / (n + PRIOR)).alias(f"{name}_rate")
    parts = keys.groupBy(key, fold_of().alias("fold")).agg(F.sum("label").alias("s"), F.count(F.lit(1)).alias("n"))
    whole = parts.groupBy(key).agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    outside = parts.join(whole, key).select(key, "fold", rate(F.col("all_s") - F.col("s"), F.col("all_n") - F.col("n")))
    return whole.select(key, rate(F.col("all_s"), F.col("all_n"))), outside


def train(labelled: DataFrame, url: str = "url", verdict: str = "verdict") -> Judge:
    """Trees from labelled URLs; of more than SAMPLED_URLS, those of the smallest hashes."""
    rows = labelled.where(F.col(url).isNotNull() & F.col(verdict).isin(ALLOW, BLOCK)).select(F.col(url).alias("url"), (F.col(verdict) == BLOCK).cast("double").alias("label"))
    rows = saved(rows.orderBy(F.xxhash64("url"), "url", "label").limit(SAMPLED_URLS), "labelled-urls")
    n, blocked = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if blocked in (0, n):
        return Judge(None, BLOCK if n and blocked == n else ALLOW, 0.0, {})
    base, keys, rates, outside = blocked / n, lexical(rows, "url"), {}, {}
    for name in ("suffix", "segment"):
        rates[name], outside[name] = (saved(r, f"{name}-rates") for r in rates_of(keys, name, base))
    judge = Judge(None, ALLOW, base, rates)
    made = vectors(keys.withColumn("fold", fold_of()), outside, base, "fold")
    judge.model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=1).fit(made.select("features", "label"))
    return judge


def judged(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url", judge: Judge | None = None) -> DataFrame:
    """(key, host, path, rule, verdict) of each row; without a judge, one is trained from the URLs that a rule fits."""
    rule, said = matched(host_of(F.col(url)), path_of(F.col(url)), rules)
    if judge is None:
        judge = train(pages.select(F.col(url).alias("url"), said.alias("verdict")), "url", "verdict")
    found = judge.judged(pages, key, url)
    rule, said = matched(host_of(F.col("url")), path_of(F.col("url")), rules)
    return found.select(F.col("key").alias(key), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), rule.alias("rule"), F.coalesce(said, F.col("verdict")).alias("verdict"))
