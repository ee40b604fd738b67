"""Approximate nearest vectors by inverted lists: every row is in the list of its nearest centre, a query reads some lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.retrieval import best_by_cosine, ranked

SAMPLE_ROWS = 65_536
MAX_LISTS = 4096
SHARD_ROWS = 8192
ROWS = "doc_id long, v array<double>, list int"


@dataclass
class VectorIndex:
    """Stored rows in folders by list, and the centres (at most MAX_LISTS, so they may be broadcast)."""

    spark: SparkSession
    path: str
    centres: np.ndarray

    def rows(self) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(f"{self.path}/rows")


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms > 0, norms, 1)


def with_lists(df: DataFrame, column: str, centres: np.ndarray, n: int) -> DataFrame:
    """df with `lists`, the n centres that are nearest to a vector by cosine, nearest first; a vector of another length or
    without a direction has the first n."""
    sent = df.sparkSession.sparkContext.broadcast(_unit(centres))

    @F.pandas_udf("array<int>")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        for batch in batches:
            m = np.zeros((len(batch), own.shape[1]))
            for i, v in enumerate(batch):
                if v is not None and len(v) == own.shape[1]:
                    m[i] = v
            yield pd.Series(list(np.argsort(-(np.nan_to_num(m) @ own.T), axis=1, kind="stable")[:, :n].astype(np.int32)))

    return df.withColumn("lists", nearest(F.col(column).cast("array<double>")))


def build(vectors: DataFrame, path: str, lists: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 1) -> VectorIndex:
    """Index vectors (doc_id, v): k-means by cosine on at most sample_rows rows, drawn by a hash of doc_id, then every row is
    written to the list of its nearest centre.

    The sample is the documented bound of the fit; the rows it leaves out are indexed all the same. lists: the root of the
    number of rows unless given, MAX_LISTS at most. Rows with a null id or vector are left out.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("v").cast("array<double>").alias("v")).where("doc_id is not null and v is not null and size(v) > 0 and not exists(v, c -> c is null or isnan(c))")
    n = good.count()
    if not n:
        good.withColumn("list", F.lit(0)).write.mode("overwrite").parquet(f"{path}/rows")
        return VectorIndex(spark, path, np.zeros((1, 1)))
    dim = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()["d"]
    with_length = good.where((F.size("v") == dim) & F.exists("v", lambda c: c != 0))
    sample = with_length.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select(array_to_vector("v").alias("features"))
    k = max(1, min(MAX_LISTS, round(n**0.5) if lists is None else lists))
    centres = np.array(KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=15).fit(sample).clusterCenters()) if k > 1 and sample.limit(2).count() > 1 else np.ones((1, dim))
    listed = with_lists(good, "v", centres, 1).select("doc_id", "v", F.get("lists", F.lit(0)).alias("list"))
    listed.repartition("list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    return VectorIndex(spark, path, centres)


def search(index: VectorIndex, queries: DataFrame, limit: int = 10, floor: float = 0.25, probes: int = 16) -> DataFrame:
    """(query_id, doc_id, score, rank): as retrieval.vector_topk for queries (query_id, q), over the `probes` lists that are
    nearest to a query. With as many probes as lists the result is exact.

    Lists of more than SHARD_ROWS rows are split, so that a list of many copies is no single task.
    """
    sizes = index.rows().groupBy("list").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("shards"))  # a row per list
    shard = F.pmod(F.xxhash64("doc_id"), F.col("shards")).cast("int")
    own = index.rows().join(F.broadcast(sizes), "list").select("list", shard.alias("shard"), "doc_id", "v", F.size("v").alias("dim"))
    asked = with_lists(queries.select("query_id", F.col("q").cast("array<double>").alias("q")).where("q is not null"), "q", index.centres, probes).withColumn("list", F.explode("lists")).drop("lists")
    asked = asked.join(F.broadcast(sizes), "list").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select("list", "shard", "query_id", "q", F.size("q").alias("dim"))

    def best(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return best_by_cosine(left, right, limit, floor)

    keys = ["list", "shard", "dim"]
    return ranked(own.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(best, "query_id long, doc_id long, score double"), limit)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (queries, recall): the share of the exact result's rows (query_id, doc_id) that were found."""
    hit = exact.join(found.select("query_id", "doc_id").withColumn("_hit", F.lit(1)), ["query_id", "doc_id"], "left")
    return hit.agg(F.countDistinct("query_id").alias("queries"), F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))
