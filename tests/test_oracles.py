"""Every engine query against its SQL equivalent."""

import os

import duckdb
import pytest

from quillspark.queries import ORACLE_SQL, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "pages", "events", "labels", "conversations", "benchmark")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    ours = sorted(str(tuple(r[c] for c in names)) for r in df.collect())
    found = con.execute(ORACLE_SQL[name])
    cols = [c[0] for c in found.description]
    theirs = sorted(str(tuple(r[cols.index(c)] for c in names)) for r in found.fetchall())
    assert sorted(cols) == names
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).collect()


def test_oracles_belong_to_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
