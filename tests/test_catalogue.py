"""Every registered query that has SQL gives the SQL's rows on the smallest tables."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb
import pytest

from folioforge.plans.catalogue import QUERIES, SQL

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, Decimal)):
        return f"{round(float(v), 5) + 0.0:g}"
    if isinstance(v, int):
        return f"{float(v):g}" if abs(v) < 10**5 else str(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    want = duck.sql(SQL[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    got = sorted(tuple(norm(r[c]) for c in order) for r in df.collect())
    at = [want.columns.index(c) for c in order]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())
