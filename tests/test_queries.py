"""Every named query against its DuckDB text."""

import math
from pathlib import Path

import duckdb
import pytest

from loamline.plans import registry

QUERIES, ORACLES = registry.load()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*cols).collect())
    if name not in ORACLES:
        return
    with duckdb.connect() as db:
        for f in Path(small).glob("*.parquet"):
            db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
        rows = db.execute(ORACLES[name])
        names = [d[0] for d in rows.description]
        assert sorted(names) == cols
        want = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in rows.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_top_k_keeps_few_rows(spark, small):
    plan = QUERIES["offset_page"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan or "GlobalLimit" in plan


def test_band_join_is_an_equi_join(spark, small):
    plan = QUERIES["nearest_owner"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_prefix_reaches_the_scan(spark, small):
    plan = QUERIES["prefix_range"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(p_type,S)" in plan and "ReadSchema: struct<p_partkey:bigint,p_type:string>" in plan
