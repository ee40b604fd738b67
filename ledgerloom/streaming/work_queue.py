"""A queue of documents through chained stages, with dead letters that come back and work that is never done twice."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ledgerloom.operators.durable import Workspace
from ledgerloom.streaming.watch import run_id

Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def utc_now() -> datetime.datetime:
    return datetime.datetime.now(datetime.timezone.utc)


@dataclass
class WorkQueue:
    """Entries (key and payload columns) go through the stages in order; what happened to each is a log below `folder`.

    A stage takes the rows that are left and returns them with a column error, null where it worked; it may add columns, which
    later stages and the results have. A row that fails leaves the chain: it is a dead letter with its stage, error and
    number of failures, and comes back with a later batch, from the first stage on, after base_seconds * 2^(failures - 1),
    until it has failed `most` times. Work that was claimed but never ended (its process died and its checkpoint is
    gone) comes back after stranded_seconds.

    Each batch writes its claims, results and log under its own name and reads those of others only, so running a batch
    again replaces what it wrote and changes nothing else. The latest log row of a key is its state, the latest result
    its result; both come from one aggregation by key.
    """

    spark: SparkSession
    folder: str
    key: str
    payload: StructType
    stages: list[Stage]
    most: int = 3
    base_seconds: int = 60
    stranded_seconds: int = 60
    now: Callable[[], datetime.datetime] = field(default=utc_now)

    def _read(self, table: str, without: str | None = None) -> DataFrame | None:
        try:
            df = self.spark.read.option("mergeSchema", True).parquet(f"{self.folder}/{table}")
        except AnalysisException:  # nothing was written yet
            return None
        return df if without is None else df.where(F.col("part") != without)

    def _latest(self, table: str, without: str | None = None) -> DataFrame | None:
        df = self._read(table, without)
        if df is None:
            return None
        last = df.groupBy(F.col(self.key).alias("_k")).agg(F.max_by(F.struct("*"), F.struct("at", "part")).alias("_row"))
        return last.select("_row.*")

    def entries(self) -> DataFrame | None:
        """The state of each key: done, or failed with stage, error, failures and when it is due again (null: never)."""
        return self._latest("log")

    def results(self) -> DataFrame | None:
        """The latest result of each key that is done."""
        return self._latest("results")

    def _returning(self, own: str, at: datetime.datetime) -> DataFrame | None:
        """Payloads of dead letters that are due and of claims that never ended."""
        claims = self._latest("claims", own)
        if claims is None:
            return None
        stamp = F.lit(at).cast("timestamp")
        log = self._latest("log", own)
        if log is None:
            open_ = claims.withColumn("_status", F.lit(None).cast("string")).withColumn("_due", F.lit(None).cast("timestamp")).withColumn("_failures", F.lit(0))
        else:
            told = log.select(F.col(self.key).alias("_k"), F.col("status").alias("_status"), F.col("due").alias("_due"), F.col("failures").alias("_failures"), F.col("part").alias("_part"))
            open_ = claims.join(told, F.col(self.key) == F.col("_k"), "left").withColumn("_status", F.when(F.col("part") == F.col("_part"), F.col("_status")))
        stranded = F.col("_status").isNull() & (F.unix_timestamp(stamp) - F.unix_timestamp("at") > self.stranded_seconds)
        due = (F.col("_status") == "failed") & (F.col("_due") <= stamp)
        return open_.where(stranded | due).select(*self.payload.names, F.coalesce("_failures", F.lit(0)).alias("failures"))

    def step(self, batch: DataFrame, batch_id: int, run: str = "run") -> None:
        """Work on one batch, by its number within a run."""
        own, at = f"{run}-{batch_id}", self.now()
        with Workspace(self.spark, "queue") as work:
            fresh = batch.select(*self.payload.names).dropDuplicates([self.key]).withColumn("failures", F.lit(0))
            back = self._returning(own, at)
            if back is not None:
                back = work.keep(back.join(fresh.select(F.col(self.key).alias("_k")), F.col(self.key) == F.col("_k"), "left_anti"))
                fresh = fresh.unionByName(back)
            rows = work.keep(fresh)
            self._write(rows.drop("failures"), "claims", own, at)
            failed = None
            for name, stage in self.stages:
                out = work.keep(stage(rows))
                lost = out.where("error is not null").select(self.key, "failures", F.lit(name).alias("stage"), "error")
                failed = lost if failed is None else failed.unionByName(lost)
                rows = out.where("error is null").drop("error")
            done = rows.select(self.key, F.lit("done").alias("status"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("error"), "failures", F.lit(None).cast("timestamp").alias("due"))
            again = F.when(F.col("failures") + 1 < self.most, F.timestamp_seconds(F.unix_timestamp(F.lit(at).cast("timestamp")) + F.lit(self.base_seconds) * F.pow(F.lit(2), F.col("failures"))))
            letters = failed.select(self.key, F.lit("failed").alias("status"), "stage", "error", (F.col("failures") + 1).alias("failures"), again.alias("due"))
            self._write(rows.drop("failures"), "results", own, at)
            self._write(done.unionByName(letters), "log", own, at)  # last: without it the claims are stranded and come back

    def _write(self, df: DataFrame, table: str, own: str, at: datetime.datetime) -> None:
        df.withColumn("at", F.lit(at).cast("timestamp")).write.mode("overwrite").parquet(f"{self.folder}/{table}/part={own}")

    def start(self, source: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run the queue on a stream; trigger as for writeStream, all that is there if not given."""
        run = run_id(checkpoint)
        writer = source.writeStream.foreachBatch(lambda batch, n: self.step(batch, n, run)).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
