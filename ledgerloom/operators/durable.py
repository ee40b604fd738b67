"""Intermediate tables of loops and of jobs that read a result more than once, in the shared folder of spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only in local mode with the setting unset."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Rows that a Python worker takes at once.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Let Python workers take at most BATCH_ROWS texts at once: a batch is held as Arrow, as strings and as the rows made of
    it, and each text may be long and make many rows. A lower setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


#: Rows of a shuffled table that one task gets, about, so that what a task holds does not grow with the table.
TASK_ROWS = 500_000


def parts_for(spark: SparkSession, rows: int) -> int | None:
    """Partitions for so many rows, never fewer than the session's; None for a small table, which needs no dealing."""
    if rows <= 4 * TASK_ROWS:
        return None
    return max(-(-rows // TASK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """df in so many partitions by the keys, so that groups and joins by them need no shuffle of their own; as it is if None."""
    return df.repartition(parts, *keys) if parts else df


def few(table: DataFrame, most: int = 100_000) -> bool:
    """Whether a small table may be broadcast."""
    return table.limit(most + 1).count() <= most


class Workspace:
    """Tables of one job in a folder of its own: a kept table ends the lineage, so a lost executor costs no recomputation.

    As a context manager it removes its tables at the end; `result` keeps one table beyond that, which is left to the
    cleaning of the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self._spark, self._path, self._n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        """df computed once, as a table of the workspace."""
        self._n += 1
        return self._written(df, f"{self._path}/{self._n}")

    def result(self, df: DataFrame) -> DataFrame:
        """df computed once, as a table that outlives the workspace."""
        return self._written(df, f"{self._path}-result-{uuid.uuid4().hex}")

    def _written(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        target = self._spark._jvm.org.apache.hadoop.fs.Path(self._path)
        target.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(target, True)
