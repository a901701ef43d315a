"""Scores of groups that break no rule, and of chunks without a group."""

from corpusloom.plans.compare import differences
from corpusloom.queries import QUERIES


def test_groups_without_issues_have_scores(spark, tmp_path):
    """Language c has one chunk that breaks no rule, and two chunks have no language."""
    docs = [(1, "one", "a"), (2, "two", "c"), (3, "three", None), (9, "nine", "b"), (4, "four", None)]
    rows = spark.createDataFrame([(i, f"words of chunk {t}", lang, "web") for i, t, lang in docs], "doc_id long, text string, lang string, source string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["language"]: r for r in QUERIES["quality_scores"](spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b", "c", None}
    c = got["c"]
    assert (c["accuracy"], c["completeness"], c["relevance"], c["clarity"]) == (75.0, 80.0, 90.0, 80.0)
    assert c["score"] == round((75 * 0.25 + 80 * 0.2 + 90 * 0.15 + 80 * 0.1) / 0.7, 4)
    assert differences(spark, str(tmp_path), "quality_scores") == ""
