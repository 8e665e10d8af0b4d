"""Every query with SQL gives the rows that DuckDB gives; the others run and have columns."""

from __future__ import annotations

import pytest

from eventloom.plans import catalogue
from tests.oracle import duck, spark_rows

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, data, name):
    df = catalogue.queries()[name](spark, data)
    columns, expected = duck(data, SQL[name])
    assert sorted(df.columns) == sorted(columns)
    assert spark_rows(df) == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_query_without_sql_runs_and_repeats(spark, data, name):
    query = catalogue.queries()[name]
    assert spark_rows(query(spark, data)) == spark_rows(query(spark, data))


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["activity", "next_activity", "edge_count"]
    assert entry.entry(spark).count() > 0


def test_sql_names_are_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
