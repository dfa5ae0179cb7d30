"""Every query of the core against its SQL on the smallest tables."""

import pytest

from loomtext import queries as core

from .helpers import DATA, rows, sql_rows

SQL = core.oracle_sql()


def test_every_query_has_sql():
    assert set(SQL) == set(core.queries())


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_same_as_sql(spark, name):
    folder = f"{DATA}/sf0.001"
    df = core.queries()[name](spark, folder)
    columns, expected = sql_rows(SQL[name], folder)
    assert sorted(df.columns) == columns
    assert rows(df) == expected


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())
