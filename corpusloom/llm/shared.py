"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of the batches that Python workers get.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where that is unset and all of Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again, so that its lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """From here on this session hands rows to Python workers about ``BATCH_BYTES`` at a time.

    A worker holds a batch several times over (as Arrow, as pandas, as bytes),
    so Spark's default of 64 MB makes workers large.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def crc_remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a missing id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def size_of_plan(df: DataFrame) -> int:
    """Bytes to be read for ``df`` by the plan's statistics; 0 where Spark knows no size."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 56 else 0


def size_of_text(df: DataFrame, column: str = "text") -> int:
    """Bytes to be read for ``df`` by the plan's statistics, or the length of its texts where Spark knows no size."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 56 else df.agg(F.sum(F.length(column))).first()[0] or 0


def let(value, body):
    """``body(value)`` with ``value`` evaluated once, even where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]
