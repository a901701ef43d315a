"""Tables derived once and kept in the folder that driver and executors share, such as a term index."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[tuple, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where that is unset and all of Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _version(spark: SparkSession, files: tuple[str, ...]) -> tuple:
    """Size and time of change of each file; read by Hadoop's file systems, so any store will do."""
    out = []
    for name in files:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


#: Bytes of input files for one partition of a shuffle.
PART_BYTES = 4 << 20


def deal_by_size(*tables: DataFrame) -> None:
    """From here on the session shuffles into one partition at least for each ``PART_BYTES`` of the tables' files.

    So a task sorts and groups no more as the tables grow, however few partitions
    are set; where these are too small, adaptive execution joins them again.
    """
    spark = tables[0].sparkSession
    files = {name for t in tables for name in t.inputFiles()}
    n = -(-sum(size for _, size, _ in _version(spark, tuple(files))) // PART_BYTES)
    if n > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))


def stored(source: DataFrame, name: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``build(source)``, written as Parquet when it is first asked for in this session and read from there afterwards.

    It is built again where the files of ``source`` are others than before, or
    have another size or time of change, and each time where ``source`` reads no
    files.  ``name`` has to tell apart whatever else ``build`` depends on.
    """
    spark = source.sparkSession
    files = tuple(sorted(source.inputFiles()))
    key = (spark.sparkContext.applicationId, name, _version(spark, files))
    if key not in _KEPT or not files:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        build(source).write.parquet(path)
        _KEPT[key] = path
    return spark.read.parquet(_KEPT[key])


class Rounds:
    """Tables of an iteration, each written in the shared folder when it is kept, so that no lineage grows and lost executors cost nothing.

    A table that is kept under a name takes the place of the one kept before
    under it, which is deleted; so a table must not be read any more once
    another one has its name.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._delete(self.paths.get(name))
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self, *needed: str) -> None:
        """Deletes all tables but those still needed."""
        for name in set(self.paths) - set(needed):
            self._delete(self.paths.pop(name))

    def _delete(self, path: str | None) -> None:
        if path:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
