"""Full-text search over postings: literal phrases, all of which must occur, ranked by BM25."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as T

#: Published defaults of BM25.
K1, B = 1.2, 0.75


#: Places of a field are so far from those of the next that no phrase crosses.
FIELD_STRIDE = 1 << 40


def postings(docs: DataFrame, key: str = "id", *fields: str) -> DataFrame:
    """(key, field, term, position): the words of all fields, from one pass over the rows."""
    each = docs.select(key, F.posexplode(F.array(*[F.coalesce(f, F.lit("")) for f in fields])).alias("field", "__text"))
    return each.select(key, "field", F.posexplode(T.cut(F.col("__text"))).alias("position", "term")).withColumn("term", F.lower("term"))


def phrases(query: str) -> list[list[str]]:
    """Each blank-separated token is a phrase of its words; tokens without a word ask for nothing."""
    cut = ["".join(c.lower() if c.isalnum() else " " for c in token).split() for token in query.split()]
    return [p for p in cut if p]


def search(index: DataFrame, query: str, limit: int = 25, key: str = "id", lengths: DataFrame | None = None) -> DataFrame:
    """(key, score, hits): documents with every phrase, best first, ties by key. An empty query finds nothing.

    lengths: (key, size), the words of each document that has some, where that is known.
    """
    asked = phrases(query)
    if not asked:
        return index.select(key, F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("hits")).limit(0)
    if lengths is None:
        lengths = index.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    whole = lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("size").alias("mean"))
    terms = sorted({w for p in asked for w in p})
    place = F.col("field") * F.lit(FIELD_STRIDE) + F.col("position")
    # one scan of the asked terms; where a document has each of them is bounded by its own text
    hits = index.where(F.col("term").isin(*terms)).groupBy(key).agg(*[F.collect_list(F.when(F.col("term") == w, place)).alias(f"w{i}") for i, w in enumerate(terms)])
    back = lambda w, j: F.transform(f"w{terms.index(w)}", lambda p: p - j)
    starts = lambda phrase: [back(w, j) for j, w in enumerate(phrase)]
    times = [F.size(reduce(F.array_intersect, starts(phrase))).cast("long").alias(f"t{i}") for i, phrase in enumerate(asked)]
    counted = hits.select(key, *times)
    names = [f"t{i}" for i in range(len(asked))]
    rare = counted.agg(*[F.count_if(F.col(t) > 0).alias(f"d{i}") for i, t in enumerate(names)])
    rows = counted.where(reduce(Column.__and__, [F.col(t) > 0 for t in names])).join(lengths, key).crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(rare))  # one row each

    def gain(i: int) -> Column:
        tf, df = F.col(f"t{i}"), F.col(f"d{i}")
        return F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / F.col("mean")))

    score = F.round(reduce(Column.__add__, map(gain, range(len(asked)))), 6)
    return rows.select(key, score.alias("score"), reduce(Column.__add__, map(F.col, names)).alias("hits")).orderBy(F.col("score").desc(), key).limit(limit)


def snippets(docs: DataFrame, found: DataFrame, query: str, field: str = "text", width: int = 16, key: str = "id") -> DataFrame:
    """T4: (key, snippet): the first window of width words of the text, as written, with the most words of the query.

    An ellipsis stands where the text goes on. Found documents without a word of the query in this field have no row.
    """
    asked = sorted({w for p in phrases(query) for w in p})
    piece = lambda w: F.regexp_replace(F.lower(w), rf"[^{T.ALNUM}]+$", "")
    rows = docs.join(found.select(key), key, "left_semi").select(key, F.regexp_extract_all(F.coalesce(field, F.lit("")), F.lit(rf"([{T.ALNUM}]+[^{T.ALNUM}]*)")).alias("pieces"))
    rows = rows.withColumn("at", F.filter(F.transform("pieces", lambda w, i: F.when(piece(w).isin(*asked), i)), lambda i: i.isNotNull())).where(F.size("at") > 0)
    # at most width places lie in a window, so each place looks at so many after it
    near = F.transform("at", lambda p, i: F.struct(F.size(F.filter(F.slice("at", i + 1, width), lambda q: q < p + width)).alias("n"), (-p).alias("start")))
    rows = rows.withColumn("start", -F.array_max(near)["start"])
    ellipsis = lambda condition: F.when(condition, "…").otherwise("")
    text = F.trim(F.array_join(F.slice("pieces", F.col("start") + 1, width), ""))
    return rows.select(key, F.concat(ellipsis(F.col("start") > 0), text, ellipsis(F.size("pieces") > F.col("start") + width)).alias("snippet"))
