"""Every registered query with an oracle gives the SQL's rows on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from veilframe.plans import queries as core

SF = "/root/testdata/sf0.001"


def normal(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(normal, v))
    return v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_matches_oracle(spark, tables, name):
    df = core.QUERIES[name](spark, SF)
    order = sorted(df.columns)
    got = sorted((tuple(normal(r[c]) for c in order) for r in df.collect()), key=str)
    cur = tables.execute(core.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == order
    want = sorted((tuple(normal(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
