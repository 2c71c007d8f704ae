"""Every query with SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from parlance.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    return round(float(x), 6) if isinstance(x, (int, float)) else str(x)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, FOLDER)
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(found.columns)
    want = sorted((tuple(plain(dict(zip(names, row, strict=True))[c]) for c in sorted(names)) for row in cursor.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in found.collect()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql(spark, duck, name):
    assert registry.queries()[name](spark, FOLDER).count() > 0
