"""Watching roots: changes of files as a stream, and scanner files held until they are renamed or old."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ledgerloom.sources.files import is_raw_scan, wanted

LISTING = "root string, path string, mtime timestamp, size long"
CHANGES = "kind string, root string, path string, old_path string, mtime timestamp, size long"


def listing(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """(root, path, mtime, size) of the wanted files below several roots; contents are not read. A root that is offline has none."""
    out = spark.createDataFrame([], LISTING)
    for name, path in roots.items():
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        except AnalysisException:
            continue
        out = out.unionByName(files.select(F.lit(name).alias("root"), "path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size")).where(wanted(F.col("path"))))
    return out


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """CHANGES between two listings: created, modified, moved (old_path) and deleted files; what is alike gives no row.

    A file is modified if its time or size differs. A path that is new and one that is gone are one move if root, time
    and size are equal; several of the same kind pair in the order of their paths, each once.
    """
    old = before.select("root", "path", F.col("mtime").alias("m0"), F.col("size").alias("s0"))
    both = now.join(old, ["root", "path"], "full")
    modified = both.where("mtime is not null and m0 is not null and (mtime <> m0 or size <> s0)").select(F.lit("modified").alias("kind"), "root", "path", F.lit(None).cast("string").alias("old_path"), "mtime", "size")
    place = F.row_number().over(Window.partitionBy("root", "mtime", "size").orderBy("path"))
    came = both.where("m0 is null").select("root", "path", "mtime", "size").withColumn("n", place)
    went = both.where("mtime is null").select("root", "path", F.col("m0").alias("mtime"), F.col("s0").alias("size")).withColumn("n", place).withColumnRenamed("path", "old_path")
    paired = came.join(went, ["root", "mtime", "size", "n"], "full")
    kind = F.when(F.col("path").isNull(), "deleted").when(F.col("old_path").isNull(), "created").otherwise("moved")
    rest = paired.select(kind.alias("kind"), "root", F.coalesce("path", "old_path").alias("path"), F.when(F.col("path").isNotNull(), F.col("old_path")).alias("old_path"), "mtime", "size")
    return modified.unionByName(rest)


def watch(spark: SparkSession, roots: dict[str, str], folder: str, every: str = "10 seconds") -> StreamingQuery:
    """List the roots every so often and write what changed to `folder`/changes, which watched() reads as a stream.

    Each batch compares a listing with the one that the batch before it stored, and writes both its own listing and the
    changes under its number: a batch that is run again after a failure compares with the same listing and replaces its
    own folders, so no change is lost or told twice. Spark's readers list the roots, so they may lie in any store. Of the
    listings the last two stay.
    """

    def step(_: DataFrame, batch_id: int) -> None:
        own = listing(spark, roots)
        own.write.mode("overwrite").parquet(f"{folder}/listing/{batch_id}")
        now = spark.read.schema(LISTING).parquet(f"{folder}/listing/{batch_id}")
        before = spark.read.schema(LISTING).parquet(f"{folder}/listing/{batch_id - 1}") if batch_id else spark.createDataFrame([], LISTING)
        found = changes(before, now)
        if not found.isEmpty():
            found.coalesce(max(1, min(8, found.rdd.getNumPartitions()))).write.mode("overwrite").parquet(f"{folder}/changes/batch={batch_id}")
        _delete(spark, f"{folder}/listing/{batch_id - 2}")

    spark.createDataFrame([], CHANGES).write.mode("append").parquet(f"{folder}/changes/batch=-1")  # so that the folder can be read at once
    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    return clock.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime=every).start()


def watched(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of changes that watch() writes."""
    return spark.readStream.schema(CHANGES + ", batch int").parquet(f"{folder}/changes").drop("batch")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


RELEASED = "path string, mtime timestamp, size long, late boolean"


class _Hold(StatefulProcessor):
    """Per path: a scanner's file waits for its time; a rename or removal drops it."""

    def __init__(self, grace_ms: int, event_time: bool):
        self._grace, self._event_time = grace_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getValueState("held", "path string, mtime timestamp, size long")

    def _now(self, timer_values: Any) -> int:
        return timer_values.getCurrentWatermarkInMs() if self._event_time else timer_values.getCurrentProcessingTimeInMs()

    def _forget(self) -> None:
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        self._held.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last = max(rows, key=lambda r: (r["ms"], r["gone"]))
        self._forget()
        if last["gone"]:
            return
        due = last["ms"] + self._grace
        if due <= self._now(timerValues):
            yield Row(path=last["path"], mtime=last["mtime"], size=last["size"], late=True)
        else:
            self._held.update((last["path"], last["mtime"], last["size"]))
            self._handle.registerTimer(due)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self._held.exists():
            path, mtime, size = self._held.get()
            self._held.clear()
            yield Row(path=path, mtime=mtime, size=size, late=True)

    def close(self) -> None:
        pass


def hold(stream: DataFrame, grace_hours: float = 96, event_time: str | None = None, raw: Column | None = None) -> DataFrame:
    """RELEASED files of a stream of changes (CHANGES): a scanner's own file name is held for grace_hours after its mtime.

    Other files pass at once (late is false). A held file is let go by a timer; if it is renamed, moved or deleted before, it is
    dropped, and its new name is judged by itself. A file that is already old passes with its batch. The clock is the
    processing time, or the watermark of the column event_time, which the caller has set. Only scanner files and what
    renames or removes them reach the state, which is kept per path in the RocksDB store
    (spark.sql.streaming.stateStore.providerClass) and survives a restart from the checkpoint.
    """
    raw = is_raw_scan(F.col("path")) if raw is None else raw
    kept = [event_time] if event_time else []
    here = stream.where("kind <> 'deleted'").select("path", "mtime", "size", F.lit(False).alias("gone"), *kept)
    left = stream.where("kind in ('moved', 'deleted')").select(F.when(F.col("kind") == "moved", F.col("old_path")).otherwise(F.col("path")).alias("path"), "mtime", "size", F.lit(True).alias("gone"), *kept)
    through = here.where(~raw).select("path", "mtime", "size", F.lit(False).alias("late"))
    keyed = here.unionByName(left).where(raw).withColumn("ms", F.unix_millis("mtime"))
    late = keyed.groupBy("path").transformWithState(_Hold(int(grace_hours * 3_600_000), event_time is not None), RELEASED, "append", "EventTime" if event_time else "ProcessingTime")
    return through.unionByName(late)


def run_id(checkpoint: str) -> str:
    """A short name of a query by its checkpoint, so that batches of different queries never share a folder."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
