"""All registered queries over empty tables, and over tables of nulls, extremes, repeats and extra columns."""

import pytest

import corpus_pipeline
from parlance.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, copy int, verdict string, fp string, item_id string, word string, n long, root long, lang_pred string"
PAGES = "page_id long, url string, html string, host string, path string, rule string, label double, features string"
VECTORS = "vec_id long, embedding array<float>, label int, id long, vector string, score double"
ITEMS = "item_id long, text string, doc_id long"


def pad(rows, schema):
    n = schema.count(",") + 1
    return [(*r, *[None] * (n - len(r))) for r in rows]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
    prose = " ".join(words * 3)
    docs = [
        (None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n", None, None, 3), (4, prose, "en", "a", 9), (4, prose, "en", "a", 9), (5, prose.upper(), "en", None, 9), (6, "x" * 300_000, "en", "b", 9),
        (7, (prose + " ") * 2_000, "de", "b", 9), (8, "12 34 !!", "de", "b", 9), (None, prose + " and more words here", "de", "b", 9), (9, "password = hunter2hunter2 " + "AKIA" + "B" * 16 + " " + "0f" * 40, "en", "a", 9), (10, "😀 é ½ 漢字", "zh", "a", 9),
    ]
    pages = [(None, None, None), (1, "", None), (2, "http://a.org/x", ""), (3, "http://b.com/de/", ""), (3, "http://b.com/de/", ""), (4, "no scheme", ""), (5, "http://" + "z" * 50_000 + "/" + "9" * 50_000, ""), (6, "HTTP://É.Net?q=1&r#f", "")]
    vectors = [(None, [1.0, 0.0]), (0, None), (50, []), (100, [0.0, 0.0]), (150, [1.0, None]), (200, [float("nan"), 1.0]), (250, [1.0, 1.0]), (251, [1.0, 1.0]), (252, [1.0, 1.0]), (252, [1.0, 1.0]), (253, [-1.0, 0.5]), (300, [1.0, 2.0, 3.0])]
    out = {}
    for kind, keep in (("odd", True), ("empty", False)):
        folder = tmp_path_factory.mktemp(kind)
        for name, rows, schema in (("documents", docs, DOCS), ("pages", pages, PAGES), ("embeddings", vectors, VECTORS), ("benchmark", [(1, " ".join(words)), (2, None), (3, ""), (None, "one two"), (1, " ".join(words))], ITEMS)):
            spark.createDataFrame(pad(rows, schema) if keep else [], schema).write.parquet(f"{folder}/{name}.parquet")
        out[kind] = str(folder)
    out["rows"] = {"documents": len(docs), "pages": len(pages)}
    return out


PER_ROW = {"op1_token_counts": "documents", "op3_class_lm": "documents", "op4_near_duplicates": "documents", "op5_secret_scan": "documents", "op6_url_filter": "pages", "op7_token_ids": "documents", "op10_language_id": "documents", "op11_suffix_dedup": "documents"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, folders, name):
    assert queries.QUERIES[name](spark, folders["empty"]).count() == 0
    found = queries.QUERIES[name](spark, folders["odd"])
    rows = found.collect()
    if name in PER_ROW:
        assert len(rows) == folders["rows"][PER_ROW[name]]
    if name == "op2_decontamination":
        assert {r["doc_id"] for r in rows} == {4, 5, 7, None} and {r["item_id"] for r in rows} == {1}
    if name == "op4_near_duplicates":
        assert {r["class_id"] for r in rows if r["doc_id"] in (4, 5)} == {4}
    if name == "op5_secret_scan":
        r = next(r for r in rows if r["doc_id"] == 9)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (1, 1, 1)
    if name == "op8_nearest_neighbours":
        assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in rows) == [(250, 1, 251), (250, 2, 252), (250, 3, 253)]
    if name == "op13_vector_codes":
        assert len(rows) == 9 and {r["codebooks_sha256"] for r in rows if r["vec_id"] in (100, 250)} != {None}
    if name == "op9_source_mixing":
        assert all(r["copy"] >= 1 for r in rows) and found.columns.count("copy") == 1


def test_pipeline(spark, folders):
    assert corpus_pipeline.run(spark, folders["empty"]).count() == 0
    rows = corpus_pipeline.run(spark, folders["odd"]).collect()
    assert {r["doc_id"] for r in rows} <= {6, 9, 10, None}
