"""Operators that SQL can express, against it on the smallest tables."""

import os

import pytest

from corpusloom.llm.queries import ORACLE_SQL, QUERIES
from corpusloom.plans.compare import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert differences(spark, SF, name, QUERIES, ORACLE_SQL) == ""
