"""Every query runs on the smallest data; those with SQL give the same rows as DuckDB."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from folioscope.plans import all_queries, all_sql


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, tiny, name):
    df = all_queries()[name](spark, tiny)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name in all_sql():
        duckdb = pytest.importorskip("duckdb")
        c = duckdb.connect()
        for f in Path(tiny).glob("*.parquet"):
            c.sql(f"create view {f.stem} as select * from '{f}'")
        r = c.sql(all_sql()[name])
        assert sorted(r.columns) == columns
        want = sorted(repr([plain(v) for v in row]) for row in r.select(", ".join(f'"{x}"' for x in columns)).fetchall())
        assert got == want


def test_entry(spark, tiny):
    assert set(all_queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
