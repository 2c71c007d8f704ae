"""Near-duplicate classes send no table through the driver, however small Spark takes it for."""

from pyspark.sql import DataFrame
from test_set_operators import DOCS, brute_classes, near_documents

from parlance.llm import components, dart_minhash, storage


def plan_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_join_is_a_broadcast(spark, monkeypatch):
    """Buckets after an explode, rows for each salt, labels in small files: each was broadcast by its size before."""
    plans = []

    def seen(df, name, *partition_by):
        plans.append((name, plan_of(df)))
        return storage.saved(df, name, *partition_by)

    monkeypatch.setattr(dart_minhash, "saved", seen)
    monkeypatch.setattr(components, "saved", seen)
    docs = near_documents(copies=20)
    found = dart_minhash.near_duplicates(spark.createDataFrame(docs, DOCS), similarity=0.9)
    plans.append(("classes", plan_of(found)))
    assert {r["doc_id"]: r["class_id"] for r in found.collect()} == brute_classes(docs, 0.9)
    assert [name for name, plan in plans if "SortMergeJoin" in plan]
    assert not [name for name, plan in plans if "Broadcast" in plan]
