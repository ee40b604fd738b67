"""Streams: dedup of events, throughput, retries, matching on arrival."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ledgerloom.streaming.watch import run_id

def enqueue_once(events: DataFrame, key: str, at: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """First event of each key within the watermark; on a batch table simply one row a key."""
    if events.isStreaming:
        return events.withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def throughput(events: DataFrame, at: str = "ts", window: str = "60 seconds", lateness: str = "10 minutes") -> DataFrame:
    """Events and value per window and type; the same plan for a stream and a table."""
    timed = events.withWatermark(at, lateness) if events.isStreaming else events
    return timed.groupBy(F.window(at, window), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))


def totals(events: DataFrame, by: list[str], sums: dict[str, str]) -> DataFrame:
    """Running totals per group: number of events and sums (name -> expression), such as chunks by tier or bytes by extension.

    On a stream the state has one row a group, so `by` must have few values; output mode complete or update.
    """
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("events"), *[F.sum(F.expr(e)).alias(n) for n, e in sums.items()])


def retry(letters: DataFrame, work: Callable[[DataFrame], DataFrame], most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(done, failed): `work` on dead letters that failed fewer than `most` times; what fails again counts one failure more.

    Letters that failed `most` times stay as they are. `work` keeps the column retries.
    """
    again = work(letters.where(F.col("retries") < most).drop("error", "batch"))
    spent = letters.where(F.col("retries") >= most).drop("batch")
    failed = again.where("error is not null").withColumn("retries", F.col("retries") + 1)
    return again.where("error is null").drop("error", "retries"), failed.unionByName(spent)


def stranded(entries: DataFrame, now, seconds: int = 60) -> DataFrame:
    """Queue entries (status, enqueued_at) whose work began more than `seconds` ago and never ended are pending again."""
    late = (F.col("status") == "processing") & (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("enqueued_at") > seconds)
    return entries.withColumn("status", F.when(late, "pending").otherwise(F.col("status")))


def match_on_arrival(arrivals: DataFrame, open_actions: Callable[[], DataFrame], match: Callable[[DataFrame, DataFrame], DataFrame], out: str, checkpoint: str, **trigger):
    """Match each micro-batch of documents with the actions that are open by then; an action is fulfilled once over all batches.

    open_actions gives the actions (action_id) at the time of a batch; match takes (actions, documents) and returns one row
    an action at most (operators.actions.first_matches). What earlier batches fulfilled, by the rows below `out`, no longer
    takes part. A batch writes under its own name and does not read it, so running it again changes nothing.
    """
    run, spark = run_id(checkpoint), arrivals.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        own, actions = f"{run}-{batch_id}", open_actions()
        try:
            before = spark.read.parquet(out).where(F.col("part") != own).select("action_id").distinct()
            actions = actions.join(before, "action_id", "left_anti")
        except AnalysisException:  # nothing was written yet
            pass
        match(actions, batch).write.mode("overwrite").parquet(f"{out}/part={own}")

    return arrivals.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
