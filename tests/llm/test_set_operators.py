"""Operators on pairs and on the whole corpus, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from parlance.llm import brown_lm, dart_minhash, decontaminate, queries, rabitq, storage
from parlance.llm.components import components, joined_further
from parlance.llm.words import WordHashes, shingles_of_text

DOCS = "doc_id long, text string"


def roots_of(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("kind", ["path", "stars", "random", "none", "loops"])
def test_components(spark, kind):
    rng = random.Random(kind)
    order = rng.sample(range(300), 300)
    links = {
        "path": list(zip(order, order[1:], strict=False)), "stars": [(order[0], x) for x in order[1:100]] + [(order[150], x) for x in order[151:]],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(160)], "none": [], "loops": [(1, 1), (2, 3), (3, 2), (2, 3)],
    }[kind]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a != b]
    assert got == roots_of({n for link in real for n in link}, real)


def test_signature_estimates_weighted_similarity():
    rng = np.random.default_rng(1)
    e = rng.integers(0, 2**63, 200).astype(np.uint64)
    for n, low, high in ((200, 1, 2), (200, 1, 9), (3, 1, 4), (1, 1, 2)):
        a, b = rng.integers(low, high, n).astype(float), rng.integers(low, high, n).astype(float)
        b[rng.random(n) < 0.2] = 0
        if not b.any():
            b[0] = 1
        both = np.concatenate([e[:n], e[:n][b > 0]])
        made = dart_minhash.signatures(both, np.concatenate([a, b[b > 0]]), np.repeat([0, 1], [n, int((b > 0).sum())]), 2, 4000)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((made[0] == made[1]).mean() - true) < 4.5 * (true * (1 - true) / 4000) ** 0.5 + 1e-9


def near_documents(copies=60):
    rng = random.Random(9)
    words = ["".join(rng.choices("aeiknrst", k=6)) for _ in range(4000)]
    base = rng.choices(words, k=150)
    docs = [" ".join(base)] * 5 + [" ".join(base).upper() + "!"]
    for _ in range(copies):  # a continuum of edits: some near the base, some near another copy only, some near none
        edited = list(base)
        for _ in range(rng.randint(0, 8)):
            edited[rng.randrange(150)] = rng.choice(words)
        docs.append(" ".join(edited))
    for _ in range(60):
        docs.append(" ".join(rng.choices(words, k=rng.randint(0, 200))))
    docs += [None, "", "!!!", "one", "One.", "one two three", "two one three", "echo " * 500, "echo " * 480, "echo " * 100]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_components_joined_further(spark):
    """Labels after further links, given between roots, are those of all links at once."""
    rng = random.Random(5)
    first, later = ([(rng.randrange(60), rng.randrange(60)) for _ in range(n)] for n in (25, 30))
    table = lambda links: spark.createDataFrame(links, "a long, b long")
    nodes = table([(n, n) for n in range(60)]).select(F.col("a").alias("node"))
    whole = lambda links: nodes.join(components(table(links)), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    labels = {r["node"]: r["root"] for r in whole(first).collect()}
    got = joined_further(whole(first), table([(labels[a], labels[b]) for a, b in later]))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole(first + later).collect()))
    assert sorted(map(tuple, joined_further(whole(first), table([])).collect())) == sorted(labels.items())


def brute_classes(docs, similarity=0.8):
    hashes, sets = WordHashes(), {}
    for i, text in docs:
        flat, _ = hashes.of([text])
        sets[i] = Counter(shingles_of_text(flat).tolist())
    links = []
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = sum((sets[i] & sets[j]).values())
                if both / sum((sets[i] | sets[j]).values()) >= similarity:
                    links.append((i, j))
    return roots_of(sets, links)


def test_near_duplicates(spark):
    docs = near_documents()
    rows = [*docs, docs[3], (None, docs[5][1]), (None, None)]
    frame = spark.createDataFrame(rows, DOCS).withColumn("class_id", F.lit("clash")).withColumn("fp", F.lit(0))
    got = dart_minhash.near_duplicates(frame).collect()
    want = brute_classes(docs)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == want
    kept = dart_minhash.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(set(want.values()))
    assert kept.where("doc_id is null").count() == 1  # the one without words
    assert dart_minhash.near_duplicates(frame.limit(0)).count() == 0 and dart_minhash.one_of_each(frame.limit(0)).count() == 0


def test_all_pairs_between_classes_are_compared(spark):
    docs = near_documents(copies=200)
    got = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicates(spark.createDataFrame(docs, DOCS), similarity=0.9).collect()}
    assert got == brute_classes(docs, 0.9)


# op8


def brute_nearest(rows, k):
    rows = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q in rows:
        if q % 50 == 0:
            found = []
            for c, v in rows.items():
                if c != q and len(v) == len(rows[q]):
                    a, b = rows[q] / np.abs(rows[q]).max(), v / np.abs(v).max()
                    found.append((-(a @ b) / np.sqrt((a @ a) * (b @ b)), c))
            out[q] = sorted(found)[:k]
    return out


@pytest.mark.parametrize("dimension", [1, 3, 64, 100])
def test_nearest(spark, dimension, monkeypatch):
    monkeypatch.setattr(rabitq, "PART_ROWS", 200)
    monkeypatch.setattr(rabitq, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(dimension)
    centres = rng.standard_normal((6, dimension))
    v = centres[rng.integers(0, 6, 700)] + 0.3 * rng.standard_normal((700, dimension))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows[60] = (60, rows[50][1])
    rows[61] = (61, rows[50][1])
    odd = [(None, rows[1][1]), (1000, None), (1050, []), (1100, [0.0] * dimension), (1150, [float("nan")] * dimension), (1200, [float("inf")] * dimension), (1250, [None] * dimension), rows[50], rows[51], (1300, [1.0] * (dimension + 1))]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {}
    for r in rabitq.search(frame, frame.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = brute_nearest([*rows, (1300, [1.0] * (dimension + 1))], 5)
    found = total = 0
    for q, near in want.items():
        if not near:
            continue
        assert sorted(got[q]) == list(range(1, len(near) + 1))
        found += len({i for _, i in near} & {i for i, _ in got[q].values()}) if dimension > 1 else len(near)
        total += len(near)
        for rank, (i, s) in got[q].items():
            assert abs(s + near[rank - 1][0]) < 1e-9 or dimension > 1
    assert found / total >= 0.99 and 1300 not in got
    assert rabitq.search(frame.limit(0), frame.limit(0), 5).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    v, q = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64))
    centre, turn = rabitq.unit(v).mean(0), rabitq.rotation(64)
    low, high = rabitq.bounds(rabitq.code(v, centre, turn), rabitq.turned(rabitq.unit(q), centre, turn), 64)
    true = rabitq.unit(q) @ rabitq.unit(v).T
    assert ((low <= true) & (true <= high)).mean() > 0.999 and abs(((low + high) / 2 - true).mean()) < 0.005


# the pipeline


def test_stages_on_odd_tables(spark, tmp_path):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()), T.StructField("copy", T.StringType())])
    rng = random.Random(2)
    words = "the house with that was and for this some more words here there when where who".split()
    text = lambda n: " ".join(rng.choices(words, k=n))
    item = text(30)
    rows = [(i, text(60), "en", f"s{i % 3}", 1, "x", "y") for i in range(40)]
    rows += [(100, rows[0][1], "en", "s0", 1, None, None), (101, rows[1][1].upper(), None, None, None, None, None), (102, text(20) + " " + item, "en", "s1", 1, None, None)]
    rows += [(103, None, "en", "s0", 1, None, None), (104, "", None, None, None, None, None), (105, "123 !!", "en", "s2", 1, None, None), (None, text(50), "en", "s2", 1, None, None), rows[5], rows[5]]
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "source_mixing", "token_ids"]
    docs, kept = spark.createDataFrame(rows, schema), []
    for name, stage in corpus_pipeline.STAGES:
        docs = storage.saved(stage(spark, docs, str(tmp_path)), name)
        kept.append([r["doc_id"] for r in docs.collect()])
        if name != "token_ids":
            assert docs.columns == schema.names
    assert Counter(kept[0]) == Counter([*range(40), 100, 101, 102, None, 5, 5])
    assert sorted(kept[1], key=str) == sorted([*range(40), 102, None], key=str)
    assert sorted(kept[2], key=str) == sorted([*range(40), None], key=str)
    assert set(kept[3]) <= set(kept[2]) and Counter(kept[4]) == Counter(kept[3])
    spark.createDataFrame(rows, schema).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rejected_languages(spark, tmp_path):
    rng = random.Random(6)
    words = "the house with that was and for this some more words here there when where who then people water under great small".split()
    prose = [(i, " ".join(rng.choices(words, k=80)), "en") for i in range(30)]
    letters = lambda a: " ".join("".join(rng.choices(a, k=rng.randint(2, 9))) for _ in range(80))
    odd = [(100, letters("abcdefghijklmnopqrstuvwxyz"), None), (101, letters("абвгдежзиклмнопр"), None), (102, "<a href='x'>y</a> " * 40, None), (103, None, None)]
    docs = spark.createDataFrame(prose + odd, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_languages(spark, docs, "").collect()) == list(range(30))


def test_one_hot_bucket(spark, monkeypatch):
    """Hundreds of near copies of one text, with clashing names and repeated rows: one class, and one row stays."""
    monkeypatch.setattr(dart_minhash, "PAIRS", 16)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    near = [(i, " ".join(w if j != i % 120 else f"x{i}" for j, w in enumerate(base)), "fp", "kept", 1) for i in range(300)]
    rest = [(1000 + i, " ".join(f"v{rng.randrange(500)}" for _ in range(60)), None, None, None) for i in range(40)]
    docs = spark.createDataFrame([*near, near[7], *rest], "doc_id long, text string, fp string, kept string, tid long").repartition(7)
    got = dart_minhash.near_duplicates(docs).collect()
    assert {r["class_id"] for r in got if r["doc_id"] < 1000} == {0} and len({r["class_id"] for r in got}) == 41
    kept = dart_minhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, *range(1000, 1040)]


def test_folder_without_the_setting(spark):
    """A session that names no shared folder: a local one works with one of its own."""
    before = spark.conf.get("spark.checkpoint.dir", None)
    found = storage.saved(spark.range(3), "three")
    assert found.count() == 3 and found.saved_at.startswith(storage.shared_dir(spark))
    storage.dropped(found)
    assert spark.conf.get("spark.checkpoint.dir", None) == before


def test_registered_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert decontaminate.SIMILARITY == dart_minhash.SIMILARITY == 0.8 and brown_lm.END == b""
