"""Queries on small tables with odd keys, against their DuckDB SQL."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import eventlake.plans
from eventlake import catalog
from tests.test_oracle import text

eventlake.plans.load()


def both(spark, folder, name, **tables):
    """The sorted rows of a query and of its SQL over the given tables."""
    con = duckdb.connect()
    for t, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    result = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    return sorted(tuple(map(text, r)) for r in df.collect()), sorted(tuple(map(text, r)) for r in result)


def test_bitset_density_tells_zero_from_one(spark, tmp_path):
    events = [(1, 0), (1, 1), (2, 1000), (2, 2001), (2, 3001), (3, 5), (3, -4), (3, -5), (4, None), (4, 999), (4, -999), (None, 0), (None, 1), (5, None)]
    got, want = both(spark, tmp_path, "bitset_density", events={"user_id": [u for u, _ in events], "event_id": [e for _, e in events]})
    assert got == want
    assert ("1", "2", "0.002") in got


def test_key_splits_counts_hashes(spark, tmp_path):
    users = [58659, 67268, 58659, None, None, 1, -7]  # the first two share 375b17c1
    got, want = both(spark, tmp_path, "key_splits", events={"user_id": users})
    assert got == want
