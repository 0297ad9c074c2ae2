"""Every registered query runs, and equals its SQL twin where it has one."""

from __future__ import annotations

import math
import os
from collections import Counter

import pytest

from quarryline.plans import ORACLES, QUERIES

from .conftest import TESTDATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        path = f"{TESTDATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    con.execute("SET timezone = 'UTC'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v if not hasattr(v, "as_tuple") else float(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, TESTDATA)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    result = con.execute(ORACLES[name])
    order = [c[0] for c in result.description]
    assert sorted(order) == sorted(df.columns)
    want = Counter(tuple(plain(r[order.index(c)]) for c in sorted(order)) for r in result.fetchall())
    assert Counter(tuple(plain(r[c]) for c in sorted(order)) for r in rows) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
