"""Columns with the names that operators use inside, other tokenizer files, and more languages than go at once."""

import json

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parlance.llm import decontaminate, lang_id, mixing, simple8b

INSIDE = ("__u", "__n", "__sums", "__source", "__leaks", "__copy", "__rate", "__place", "__lang_pred", "__score")
PROSE = {"en": "the quick brown fox jumps over the lazy dog and then it goes to the river", "de": "der schnelle braune fuchs springt über den faulen hund und geht dann zum fluss", "fr": "le renard brun saute par dessus le chien paresseux et puis il va à la rivière"}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, PROSE[("en", "de", "fr")[i % 3]] + f" number {i}", ("en", "de", "fr")[i % 3], f"s{i % 2}", 9, *[f"{c}{i}" for c in INSIDE]) for i in range(30)]
    return spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *INSIDE]).withColumn("n_chars", F.col("n_chars").cast("long"))


def kept_as_they_were(df):
    rows = df.collect()
    assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in INSIDE)
    return rows


def test_mixing_keeps_all_columns(docs):
    rows = kept_as_they_were(mixing.mixed(docs))
    assert sorted((r["doc_id"], r["copy"]) for r in rows) == sorted((r["doc_id"], r["copy"]) for r in mixing.mixed(docs.select("doc_id", "text", "source")).collect())


def test_dropping_leaks_keeps_all_columns(spark, docs):
    items = spark.createDataFrame([(1, PROSE["de"])], "item_id long, text string")
    assert {r["doc_id"] % 3 for r in kept_as_they_were(decontaminate.drop_leaks(docs, items))} == {0, 2}


@pytest.mark.parametrize("stage", [corpus_pipeline.keep_languages, corpus_pipeline.mix_sources])
def test_stages_keep_all_columns(spark, docs, stage):
    found = stage(spark, docs, "")
    assert found.columns == docs.columns
    kept_as_they_were(found)


def test_languages_in_lots(spark, docs, monkeypatch):
    profiles = lang_id.fit(docs)
    strange = spark.createDataFrame([(100, "fluss und river rivière"), (101, None), (102, "1234"), (103, "zzz")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(strange)
    told = lambda: sorted(map(tuple, lang_id.predict(every, profiles, drop=("text",)).collect()), key=str)
    want = told()
    assert {r[1] for r in want} == {"en", "de", "fr", "und"}
    for n in (1, 2):
        monkeypatch.setattr(lang_id, "LANGUAGES_AT_ONCE", n)
        assert told() == want


def test_distances_are_out_of_place_sums():
    rng = np.random.default_rng(0)
    own = {name: rng.permutation(40)[:20].tolist() for name in ("a", "b", "c")}
    profiles = lang_id.Profiles.of([(name, code, rank) for name, codes in own.items() for rank, code in enumerate(codes)], 20)
    for _ in range(50):
        top = rng.permutation(50)[: rng.integers(1, 20)]
        apart = {name: sum(abs(codes.index(g) - i) if g in codes else 20 for i, g in enumerate(top.tolist())) for name, codes in own.items()}
        best = min(sorted(apart), key=apart.get)
        assert profiles.nearest(top) == (best, pytest.approx(1 - apart[best] / (20 * len(top))))


TEXTS = ["Hello World HELLO", "don't stop -- 42 naïve Ünïted", "a  b\n\tc", "", "<|endoftext|> word<|endoftext|>!", "漢字 and émoji 😀"]


@pytest.mark.parametrize("change", ["none", "no normalizer", "other split", "other file"])
def test_ids_of_any_file_are_the_library_s(change):
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json" if change == "other file" else "word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    if change == "no normalizer":
        spec["normalizer"] = None
    if change == "other split":
        spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}]+|\s+"
    text = json.dumps(spec)
    assert simple8b.cuts_apart(text) == (change == "none")
    library = Tokenizer.from_str(text)
    found = simple8b.ChunkIds(text).encode([t.encode() for t in TEXTS])
    assert [np.frombuffer(x, np.uint32).tolist() for x in found] == [library.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_rates_of_other_folds(spark):
    from parlance.llm import url_filter

    rows = [(f"http://h{i}.{('com', 'net', 'xyz')[i % 3]}/p", float(i % 2)) for i in range(60)]
    keys = url_filter.lexical(spark.createDataFrame(rows, "url string, label double"), "url").withColumn("fold", url_filter.fold_of())
    found = [(r["url"], r["label"], r["suffix_key"], r["fold"]) for r in keys.collect()]
    whole, outside = url_filter.rates_of(keys.drop("fold"), "suffix", 0.5)
    rate = lambda some: (sum(some) + url_filter.PRIOR * 0.5) / (len(some) + url_filter.PRIOR)
    assert {r["suffix_key"]: round(r["suffix_rate"], 9) for r in whole.collect()} == {k: round(rate([x for _, x, s, _ in found if s == k]), 9) for k in ("com", "net", "xyz")}
    want = {(k, f): round(rate([x for _, x, s, g in found if s == k and g != f]), 9) for _, _, k, f in found}
    assert {(r["suffix_key"], r["fold"]): round(r["suffix_rate"], 9) for r in outside.collect()} == want


def test_trees_on_urls_they_have_not_seen(spark):
    """A suffix that comes once must not pass for its URL's own label; what tells is elsewhere."""
    import random

    from parlance.llm import url_filter

    rng = random.Random(2)

    def page():
        bad = rng.random() < 0.5
        tail = "".join(rng.choice("0123456789") for _ in range(12)) if bad else "notes/of/the/day"
        host = "".join(rng.choice("abcdefghij") for _ in range(8))
        return f"http://www.example.{host}/{tail}" + ("?a=1&b=2&c=3" if bad else ""), url_filter.BLOCK if bad else url_filter.ALLOW

    made = [page() for _ in range(600)]
    judge = url_filter.train(spark.createDataFrame(made[:300], "url string, verdict string"))
    rest = spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(made[300:])], "page_id long, url string, want string")
    told = judge.judged(rest, "page_id", "url").join(rest.select(F.col("page_id").alias("key"), "want"), "key")
    assert told.where("verdict = want").count() >= 0.95 * 300
