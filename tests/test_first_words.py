"""Files take their first words from the begin of a text where these are whole there."""

import re

from pyspark.sql import functions as F

from corpusloom.sources import code


def test_first_words_are_those_of_the_whole_text(spark, tmp_path):
    texts = ["", "ab cd", "one two three four five six", "x" * 395 + " word", "Ab1 " * 99 + "one two three four fivesixseveneightnine ten", "a" * 30, " ".join(["word"] * 79) + " long" * 9, *(f"{'. ' * n}alpha beta gamma delta epsilonzeta eta" for n in range(180, 200))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["w"][:5] for r in rows.select("doc_id", code.first_words(F.col("text")).alias("w")).collect()}
    assert got == {i: re.findall(code.WORD, t)[:5] for i, t in enumerate(texts)}
    rows.union(spark.createDataFrame([(None, "lost")], rows.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    files = code.files(spark, str(tmp_path))
    assert files.count() == len(texts) + 1 and files.where("kind IS NULL").count() == 1
    plan = files.where("kind = 'flask'")._jdf.queryExecution().optimizedPlan().toString()
    assert "flask" in plan and "RestController" not in plan
