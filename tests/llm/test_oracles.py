"""The registered queries that SQL can express, against DuckDB on whole small tables."""

import pytest

from ticketlens.llm.queries import QUERIES, SQL
from ticketlens.plans.oracle import compare

from .conftest import SF


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, duck_small, name):
    assert compare(QUERIES[name](spark, SF).toPandas(), duck_small.execute(SQL[name]).fetchdf()) == []


def test_entry_lists_every_operator():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
