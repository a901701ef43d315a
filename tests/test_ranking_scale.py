"""Work that must not grow with users times chunks, or repeat with each reader of a column."""

import os

import pytest

from corpusloom.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
def test_users_share_the_best_chunks_of_a_preference(spark):
    plan = QUERIES["personalised_ranking"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    limits = [line for line in plan.split("\n") if "WindowGroupLimit" in line]
    assert any("framework" in line and "preference" in line for line in limits)


def test_words_of_chunks_are_found_once(spark):
    from corpusloom.operators import quality as Q

    rows = [(1, "b a"), (2, "A, b; a"), (3, "a"), (4, ""), (5, None), (6, "..")]
    found = Q.with_duplicates(spark.createDataFrame(rows, "id long, content string"))
    assert {r["id"]: r["n_same"] for r in found.collect()} == {1: 2, 2: 2, 3: 1, 4: None, 5: None, 6: None}
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
