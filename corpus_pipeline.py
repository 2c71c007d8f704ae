"""From raw documents to token ids: five stages, each written as Parquet and reread as the next one's documents.

Every stage works on all rows that the one before kept. All but the last return the columns of documents.

Defined cases: documents with a null or empty text or without a letter go with the first stage. Rows that repeat id and
text leave one row. Null ids and sources are kept like others. Without benchmark items nothing is contaminated. Empty
tables pass through. Other columns of documents are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import arrow, dart_minhash, decontaminate, lang_id, mixing, simple8b, storage

#: Documents whose n-gram ranks are farther than this from every language are rejected, as are those without a letter.
#: Random letters, other scripts and markup score up to 0.32, and prose of learned languages from about 0.36 on.
LEAST_LANGUAGE_SCORE = 0.35
TOKENIZER, END_ID = "word_bpe_49k.json", 1


def own(name: str, docs: DataFrame) -> str:
    """A name that no column of docs has."""
    return arrow.free(name, docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents in no learned language go. Profiles are learned from all that name their language."""
    lang, score = own("__lang_pred", docs), own("__score", docs)
    judged = lang_id.predict(docs, lang_id.fit(docs), names=(lang, score))
    return judged.where((F.col(lang) != lang_id.UNDETERMINED) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each class stays, that of the smallest id."""
    return dart_minhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that repeat a benchmark item go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents are repeated to the target weights of their sources and shuffled."""
    return mixing.mixed(docs, names=(own("__copy", docs), own("__rate", docs), own("__place", docs))).select(*[F.col(f"`{c}`") for c in docs.columns])


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as Simple-8b shards, in a shuffled order that sets copies apart, and what is in them of each document."""
    path = f"{storage.shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        simple8b.write_ids(docs, path, f.read(), END_ID, seed=mixing.SEED)
    return simple8b.read_ids(spark, path)


STAGES = [
    ("language_id", keep_languages),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_ids", write_token_ids),
]

#: SQL can't express rank-order profiles, signatures or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
