"""Workers get source files in small batches, however many rows a partition has."""

import pytest

from corpusloom.operators import declarations as D


@pytest.fixture
def sizes_of_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    yield name
    spark.conf.set(name, before)


def test_batches_are_small(spark, sizes_of_batches):
    spark.conf.set(sizes_of_batches, str(64 << 20))
    text = "x = 1  # note\n" + "y" * 1_000_000
    files = spark.createDataFrame([(i, text, "python") for i in range(12)], "file_id int, content string, language string").coalesce(1)
    cleaned = D.cleaned(files, "content", "language")
    assert int(spark.conf.get(sizes_of_batches)) == D.BATCH_BYTES

    def rows(batches):
        for pdf in batches:
            yield pdf.assign(rows=len(pdf))[["file_id", "rows"]]

    got = files.mapInPandas(rows, "file_id int, rows int").collect()
    assert len(got) == 12 and max(r["rows"] for r in got) <= 6
    assert cleaned.where("content LIKE '%note%'").isEmpty() and cleaned.count() == 12
