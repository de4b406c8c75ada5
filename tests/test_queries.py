"""Every registered query that has SQL gives the same rows as that SQL in DuckDB."""

from collections import Counter
from datetime import datetime

import duckdb
import pytest

from tidewatch.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    return v.replace(tzinfo=None) if isinstance(v, datetime) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    at = [want.columns.index(c) for c in order]
    a = Counter(tuple(plain(r[c]) for c in order) for r in got.collect())
    b = Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert a == b


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(ORACLE_SQL) <= set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
