"""Every registered query against its DuckDB SQL on the smallest tables (the driver repeats this at sf0.01)."""

import pytest

from ticketlens.plans.catalog import load_all
from ticketlens.plans.oracle import compare

SF_SMALL = "/root/testdata/sf0.001"

REG = load_all()
WITH_SQL = sorted(n for n, q in REG.items() if q.sql)
ROWS_ONLY = sorted(n for n, q in REG.items() if not q.sql)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_duckdb(spark, duck_small, name):
    q = REG[name]
    got = q.build(spark, SF_SMALL).toPandas()
    want = duck_small.execute(q.sql).fetchdf()
    assert compare(got, want) == []


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_runs(spark, name):
    df = REG[name].build(spark, SF_SMALL)
    assert df.count() >= 0
    assert len(df.columns) > 0


def test_entry_contract(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
