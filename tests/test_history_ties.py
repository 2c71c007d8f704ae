"""A meeting that one change both replaces and removes is gone, however Spark orders the rows."""

import pytest

from parlance.sources.history import History
from parlance.sources.versions import Versions

DOCS = "meeting long, name string, markdown string, title string, body string"


def test_replaced_and_removed_at_once_is_removed(spark, tmp_path):
    history = History(Versions(spark, str(tmp_path / "history")))
    rows = spark.createDataFrame([(13, "a", "x", "Plan", "one two"), (4, "b", "y", "Plan", "three")], DOCS)
    history.publish(rows)
    history.publish(rows, spark.createDataFrame([(13,), (13,)], "meeting long"))
    stored = history.tables.table("documents", "meeting long, gone boolean").where("meeting = 13 AND version = 1")
    assert {r["gone"] for r in stored.collect()} == {True}
    assert [(r["meeting"], r["words"]) for r in history.documents().collect()] == [(4, 2)]
    assert [r["meeting"] for r in history.search("plan").collect()] == [4]


@pytest.mark.parametrize("turned", [False, True])
def test_gone_wins_within_a_commit(spark, tmp_path, turned):
    log = Versions(spark, str(tmp_path / "log"))
    rows = [(1, False), (1, True), (2, False)]
    log.commit(-1, added={"t": spark.createDataFrame(rows[::-1] if turned else rows, "k long, gone boolean").coalesce(1)})
    assert [r["k"] for r in log.current("t", "k long", "k").collect()] == [2]
