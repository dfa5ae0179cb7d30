"""Queries of this subpackage against their SQL, and the columns that are fixed."""

import pytest

from loomtext.llm import queries as llm

from ..helpers import DATA, rows, sql_rows

FIXED = {"p1_found": ["origin", "rec_id", "subject"], "p3_found": ["doc_a", "doc_b"], "p4_found": ["doc_id", "term"], "p5_found": ["term", "mark"], "p6_found": ["doc_id"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query(spark, name):
    folder = f"{DATA}/sf0.001"
    df = llm.queries()[name](spark, folder)
    assert df.columns == FIXED.get(name, df.columns)
    got = rows(df)
    if name.endswith("_found"):
        assert len(set(got)) == len(got)
    if name in llm.oracle_sql():
        columns, expected = sql_rows(llm.oracle_sql()[name], folder)
        assert sorted(df.columns) == columns and got == expected
