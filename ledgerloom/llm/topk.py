"""Exact top-k search by tiled integer matrix products and a tree of merges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_TILE = 2048
SHARD_TILE = 4096
HIT_SCHEMA = "query_id long, tile int, vec_id long, score long"


def quantise(vectors: list, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, computed in double precision."""
    return np.floor(scale * np.array([np.asarray(v, np.float64) for v in vectors]))


def products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by doubles where no sum can pass 2^53, else by Python integers, held within longs."""
    bound = max(1, queries.shape[1]) * np.abs(queries).max(initial=0) * np.abs(shard).max(initial=0)
    if bound < 2**53:
        return (queries @ shard.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
    return np.clip(whole(queries).dot(whole(shard).T), -(2**63), 2**63 - 1).astype(np.int64)


def best_of_tile(query_ids: np.ndarray, scores: np.ndarray, vec_ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the positions of its k best (score descending, smaller id first) among other ids, by partial selection.

    vec_ids ascend, so of equal scores the earlier column is the better one.
    """
    out = []
    for row, own in zip(scores, query_ids, strict=True):
        keep = np.flatnonzero(vec_ids != own)
        values = row[keep]
        if len(values) > k:
            floor = np.partition(values, len(values) - k)[len(values) - k]
            above, level = keep[values > floor], keep[values == floor]
            keep = np.concatenate([above, level[: k - len(above)]])
            values = row[keep]
        out.append((keep, values))
    return out


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding", query_tile: int = QUERY_TILE, shard_tile: int = SHARD_TILE) -> DataFrame:
    """The k nearest rows of each query row (id divisible by `every`) by integer inner product, exactly.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id, a query's own id is no candidate
    (nor are repeated rows of it), and a query with fewer candidates gets them all. Rows with a null id, a null vector
    or a null, NaN or infinite component, and empty vectors, take no part; only vectors of equal length meet. If a query's id repeats, its
    smallest vector asks. Other columns are not read.

    Queries and vectors are dealt over a grid: query tiles of about query_tile rows, shards of about shard_tile rows,
    both by hash, so repeats of a vector spread. One task holds one tile and one shard, computes their matrix product
    and keeps k rows a query; the lists are then merged in two levels, so no task merges more than the square root of
    the number of shards. The counts that set the grid are the only values the driver sees. Exact search is quadratic:
    each vector is sent once per tile of queries and each query once per shard of vectors, so the shuffle is
    rows * (queries / query_tile) + queries * (rows / shard_tile) vectors; larger tiles lower it against a task's memory.
    """
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    good = good.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).withColumn("dim", F.size("v")).where("dim > 0")
    asked = good.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id"), "dim").agg(F.min("v").alias("v"))
    asked = asked.groupBy("query_id").agg(F.min(F.struct("dim", "v")).alias("q")).select("query_id", "q.dim", "q.v")
    shards = max(1, -(-good.count() // shard_tile))
    tiles = max(1, -(-asked.count() // query_tile))
    left = good.select("dim", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), "vec_id", "v")
    right = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("query_id", F.lit(2)), F.lit(tiles)).cast("int").alias("tile"), "query_id", "v")
    keys = ["dim", "shard", "tile"]

    def product(key: tuple, own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(queries):
            return pd.DataFrame({"query_id": [], "tile": [], "vec_id": [], "score": []}).astype("int64")
        own = own.sort_values("vec_id", kind="stable")
        ids, query_ids, dim = own["vec_id"].to_numpy(np.int64), queries["query_id"].to_numpy(np.int64), int(key[0])
        scores = products(quantise(list(queries["v"]), scale).reshape(-1, dim), quantise(list(own["v"]), scale).reshape(-1, dim))
        best = best_of_tile(query_ids, scores, ids, k)
        return pd.DataFrame({"query_id": np.repeat(query_ids, [len(p) for p, _ in best]), "tile": int(key[1]), "vec_id": ids[np.concatenate([p for p, _ in best])], "score": np.concatenate([s for _, s in best])})

    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(product, HIT_SCHEMA)
    order = [F.desc("score"), F.asc("vec_id")]
    branch = F.pmod(F.col("tile"), F.lit(max(1, round(shards**0.5))))
    first = hits.withColumn("branch", branch).withColumn("r", F.row_number().over(Window.partitionBy("query_id", "branch").orderBy(*order))).where(F.col("r") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
