"""Queries with SQL, against that SQL in another engine."""

import pytest

import compare
from loamline.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_rows_match_sql(spark, sf_dir, name):
    assert compare.difference(spark, compare.connect(sf_dir), Q.queries()[name], Q.oracle_sql()[name], sf_dir) == ""


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in sorted(Q.queries(), key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]
