"""The registered queries of the ten operators, over whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import brown_lm, dart_minhash, decontaminate, hard_negatives, lang_id, mixing, rabitq, secret_scan, simple8b, storage, suffix_dedup, token_counts, url_filter, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece lengths of every text."""
    pieces = token_counts.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, pieces, drop=("text",))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document repeats."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and class-bigram scores of every text, learned from four of five folds."""
    docs = table(spark, sf_dir, "documents")
    held_out = lang_id.fold("doc_id") == 1
    return brown_lm.fit_and_scored(docs.select("doc_id", held_out.alias("held_out"), "text"), ~F.col("held_out"), drop=("text",))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near copies."""
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text, by pattern and by Markov models of random strings and words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    samples = secret_scan.sample_random(spark).unionByName(secret_scan.sample_words(docs))
    found = secret_scan.scan(docs, secret_scan.train(samples))
    counts = [secret_scan.of_kind(F.col("base_spans"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    digest = F.sha2(secret_scan.written(F.col("base_spans")).cast("binary"), 256).alias("base_sha256")
    every = secret_scan.written(F.array_sort(F.concat("base_spans", "model_spans"))).alias("spans")
    return found.select("doc_id", *counts, digest, every)


#: The rules of the query on pages.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict, by rule or else by trees trained from the pages that rules decide."""
    return url_filter.judged(table(spark, sf_dir, "pages"), RULES)


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, written as Simple-8b shards and read back."""
    path = f"{storage.shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        simple8b.write_ids(table(spark, sf_dir, "documents"), path, f.read(), end_id=1)
    return simple8b.read_ids(spark, path)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of each vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return rabitq.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents repeated to square-root weights of their sources, spread and ordered at random."""
    return mixing.mixed(table(spark, sf_dir, "documents")).drop("rate")


MIXING_SQL = """
WITH mass AS (SELECT source, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS mass FROM documents GROUP BY source),
weighed AS (SELECT source, mass, CASE WHEN mass > 0 THEN sqrt(mass) ELSE 0.0 END AS weight FROM mass),
total AS (SELECT sum(mass) AS all_mass, sum(weight) AS all_weight FROM weighed),
rates AS (SELECT source, CASE WHEN mass = 0 THEN 1.0 WHEN all_weight = 0 THEN 0.0 ELSE weight * all_mass / all_weight / mass END AS rate FROM weighed, total),
sums AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p
  FROM rates, range(0, 400) AS g(k) WHERE rate > 0),
drawn AS (SELECT *, CAST('0x' || substr(md5('1|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(s.k + 1 AS INTEGER) AS copy,
  CAST('0x' || substr(md5('2|' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || CAST(s.k + 1 AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 AS place
FROM drawn d JOIN sums s ON d.source IS NOT DISTINCT FROM s.source AND s.p <= d.u
"""

NEAREST_SQL = """
WITH kept AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
  FROM kept q JOIN kept c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every text, learned from four of five folds."""
    docs = table(spark, sf_dir, "documents")
    held_out = lang_id.fold("doc_id") == 0
    profiles = lang_id.fit(docs.where(~held_out))
    found = lang_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), profiles, drop=("text",))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the bytes of 100-byte strings that start earlier."""
    found = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes as hex digits; a kept piece is a run of bytes that no repeated string covers.
SUFFIX_SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents),
strings AS (SELECT doc_id, s, substr(h, CAST(2 * s + 1 AS INTEGER), 200) AS w FROM docs, LATERAL (SELECT unnest(range(0, n_bytes - 99)) AS s)),
later AS (SELECT doc_id, s FROM strings QUALIFY row_number() OVER (PARTITION BY md5(w) ORDER BY doc_id, s) > 1),
marked AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 100 THEN 0 ELSE 1 END AS new FROM later),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked) GROUP BY doc_id, run),
edges AS (SELECT doc_id, a, b FROM runs UNION ALL SELECT doc_id, n_bytes, n_bytes FROM docs),
pieces AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS since FROM edges),
kept AS (SELECT p.doc_id, string_agg(substr(h, CAST(2 * since + 1 AS INTEGER), CAST(2 * (a - since) AS INTEGER)), '' ORDER BY a, since) AS k FROM pieces p JOIN docs d ON p.doc_id = d.doc_id GROUP BY p.doc_id),
sums AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM docs d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every positive of each vector whose id is divisible by 50; a seventh of the labels are moved."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


NEGATIVES_SQL = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM kept a JOIN kept r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id AND len(a.v) = len(r.v)),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM ranked WHERE rank <= 3
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors in 8 parts of 16 entries, six rounds."""
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


def vector_codes_sql(rounds: int) -> str:
    """One round is three views: distances, assignments, entries."""
    views = ["""WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, len(embedding) // 8 AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, p, v[p * w + 1 : p * w + w] AS x FROM kept, range(0, 8) AS g(p)),
e0 AS (SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS INTEGER) AS e, x FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16))"""]  # fmt: skip
    for r in range(rounds + 1):
        views.append(f"a{r} AS (SELECT vec_id, label, s.p, s.x, e, list_sum(list_transform(list_zip(s.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts s JOIN e{r} c ON s.p = c.p QUALIFY row_number() OVER (PARTITION BY vec_id, s.p ORDER BY d, e) = 1)")
        if r < rounds:
            views.append(f"""s{r} AS (SELECT p, e, list(m ORDER BY j) AS x FROM (SELECT p, e, j, CAST(floor(sum(x[j]) / count(*)) AS BIGINT) AS m FROM a{r}, range(1, 1 + len(x)) AS g(j) GROUP BY p, e, j) GROUP BY p, e),
e{r + 1} AS (SELECT e{r}.p, e{r}.e, coalesce(s{r}.x, e{r}.x) AS x FROM e{r} LEFT JOIN s{r} ON e{r}.p = s{r}.p AND e{r}.e = s{r}.e)""")
    return ",\n".join(views) + f""",
book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM e{rounds}),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, book"""


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_decontamination": op2_decontamination,
    "op3_class_lm": op3_class_lm,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_secret_scan": op5_secret_scan,
    "op6_url_filter": op6_url_filter,
    "op7_token_ids": op7_token_ids,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_source_mixing": op9_source_mixing,
    "op10_language_id": op10_language_id,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_vector_codes": op13_vector_codes,
}

#: SQL can't express the other methods; tests hold those against brute force.
ORACLE_SQL = {"op8_nearest_neighbours": NEAREST_SQL, "op9_source_mixing": MIXING_SQL, "op11_suffix_dedup": SUFFIX_SQL, "op12_hard_negatives": NEGATIVES_SQL, "op13_vector_codes": vector_codes_sql(vector_codes.ROUNDS)}
