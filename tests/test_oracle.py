"""Every core query with an oracle gives the rows of its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import eventlake.plans
from eventlake import catalog

SF = "/root/testdata/sf0.001"
eventlake.plans.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def text(v):
    return repr(v) if isinstance(v, float) else v.hex() if isinstance(v, bytes | bytearray) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    assert rows
    if name in catalog.ORACLES:
        result = duck.execute(catalog.ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert rows == sorted(tuple(text(r[i]) for i in at) for r in result.fetchall())


def test_entry_imports_without_the_optional_part():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
