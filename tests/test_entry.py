import __spark_entry__ as entry


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_errors_elsewhere_are_not_hidden():
    assert entry.OPTIONAL == ("parlance.llm", "corpus_pipeline")
