"""Texts of the class model: cut by columns, coded once."""

import math
import random

import pyarrow as pa
from pyspark.sql import functions as F

from parlance.llm import brown_lm

SIGNS = ["a", "B", "É", "\x1c", "\x85", " ", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x00", "z" * 70, "Z" * 70, "\xa0", "İ"]


def texts(n):
    rng = random.Random(1)
    return [None, "", " ", "  \n", *("".join(rng.choices(SIGNS, k=rng.randint(0, 12))) for _ in range(n))]


def plain(text):
    return [*map(brown_lm.kept, text.encode().lower().split() if text else []), brown_lm.END]


def test_tokens_are_those_of_the_plain_way():
    for column in (pa.array(texts(2000)), pa.array(texts(2000)).slice(3, 500), pa.array(texts(50), pa.large_string()), pa.array([], pa.string())):
        words, places, sizes = brown_lm.tokens(column)
        want, names = [plain(t) for t in column.to_pylist()], words.to_pylist()
        assert sizes.tolist() == [len(w) for w in want]
        assert [names[i] for i in places] == [w for ws in want for w in ws]


def test_texts_coded_once_score_as_texts_coded_twice(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "DICTIONARY", 8)
    monkeypatch.setattr(brown_lm, "HELD_PAIRS", 20)
    rows = list(enumerate(texts(120)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumn("__learned", F.lit("mine"))
    learned = F.col("doc_id") % 3 > 0
    want = {r["doc_id"]: r for r in brown_lm.scored(docs, brown_lm.fit(docs.where(learned), classes=5)).collect()}
    got = brown_lm.fit_and_scored(docs, learned, classes=5)
    assert got.columns == ["doc_id", "text", "__learned", *brown_lm.MADE]
    for r in got.collect():
        assert all(math.isclose(r[c], want[r["doc_id"]][c], rel_tol=1e-9) for c in brown_lm.MADE) and r["__learned"] == "mine"
    assert got.count() == len(rows)
