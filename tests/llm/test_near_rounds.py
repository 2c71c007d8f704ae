"""Near-duplicate classes take few rounds of few tables, and no round or bound loses a link."""

import numpy as np
import pytest
from test_set_operators import DOCS, brute_classes, near_documents

from parlance.llm import components, dart_minhash, storage


def classes(spark, docs, similarity):
    return {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicates(spark.createDataFrame(docs, DOCS), similarity=similarity).collect()}


def test_few_tables_are_written(spark, monkeypatch):
    """A group with many classes in its buckets: all pairs between them take one round, since they are few."""
    made = []

    def counted(df, name, *partition_by):
        made.append(name)
        return storage.saved(df, name, *partition_by)

    monkeypatch.setattr(dart_minhash, "saved", counted)
    monkeypatch.setattr(components, "saved", counted)
    docs = near_documents(copies=200)
    assert classes(spark, docs, 0.9) == brute_classes(docs, 0.9)
    assert len(made) <= 24, made


@pytest.mark.parametrize("chunk", [1 << 15, 7])
def test_many_rounds_compare_all_pairs(spark, monkeypatch, chunk):
    """Members by REGROW, where a round may list next to nothing."""
    for name, value in (("ROUND_PAIRS", 1), ("REGROW", 5), ("PAIRS", 16), ("CHUNK", chunk)):
        monkeypatch.setattr(dart_minhash, name, value)
    docs = near_documents(copies=100)
    assert classes(spark, docs, 0.9) == brute_classes(docs, 0.9)


def test_no_two_texts_share_more_than_the_bound():
    rng = np.random.default_rng(3)
    for n, kept in ((5, 4), (300, 0), (300, 299), (300, 250), (2_000, 1_700), (40_000, 30_000)):
        whole = rng.integers(0, 1 << 63, 2 * n - kept, dtype=np.uint64) * np.uint64(2)
        a, b = np.unique(whole[:n]), np.unique(whole[n - kept :])
        shared = len(np.intersect1d(a, b))
        x, y = (dart_minhash.digests_of(s)[None] for s in (a, b))
        bound = dart_minhash.most_shared(x, np.array([len(a)]), y, np.array([len(b)]))[0]
        assert shared <= bound <= n
        if n == 300:
            assert bound < shared + 0.7 * (n - shared)
