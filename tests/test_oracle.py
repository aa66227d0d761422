"""Every registered query equals its SQL."""

from __future__ import annotations

import pytest

from oracle_check import duck_rows, spark_rows
from tagloom.queries import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert queries().keys() == oracle_sql().keys()


@pytest.mark.parametrize("name", list(queries()))
def test_query_equals_sql(spark, name):
    assert spark_rows(queries()[name](spark, FOLDER)) == duck_rows(FOLDER, oracle_sql()[name])
