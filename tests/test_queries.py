"""Every registered query that has SQL gives DuckDB's rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidewell.plans import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(norm(r[i]) for i in order) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows_of(df.columns, df.collect())
    assert got
    if name in ORACLE_SQL:
        cur = duck.execute(ORACLE_SQL[name])
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows_of(columns, cur.fetchall())


def test_entry(spark):
    flagship = entry.entry(spark)
    assert flagship.columns == ["timestamp", "n", "ic", "rank_ic", "spread"] and flagship.count()
    assert set(entry.oracle_sql()) <= set(entry.queries())
