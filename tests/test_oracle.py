"""Every query that has SQL gives the same multiset of rows as that SQL in another engine."""

from __future__ import annotations

import duckdb
import pytest

from sedge.plans.catalog import REGISTRY
from sedge.plans.dialect import TABLES


def flat(v):
    return repr(v) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def other(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", sorted(k for k, q in REGISTRY.items() if q.oracle))
def test_same_rows(spark, data, other, key):
    q = REGISTRY[key]
    df = q.run(spark, data)
    want = other.sql(q.oracle)
    assert sorted(df.columns) == sorted(want.columns)
    names = sorted(df.columns)
    got = sorted(tuple(flat(r[c]) for c in names) for r in df.collect())
    at = [want.columns.index(c) for c in names]
    assert got == sorted(tuple(flat(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("key", sorted(k for k, q in REGISTRY.items() if not q.oracle))
def test_rows(spark, data, key):
    df = REGISTRY[key].run(spark, data)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
