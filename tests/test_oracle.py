"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from gleanwork.plans import queries as _registered  # noqa: F401  registers the queries
from gleanwork.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, db, name):
    df = QUERIES[name](spark, small)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert got
        return
    expected = db.sql(ORACLE_SQL[name])
    columns = expected.columns
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in sorted(columns)]
    assert sorted(got) == sorted(tuple(plain(r[i]) for i in at) for r in expected.fetchall())
