"""Hard-negative mining by exact Strassen products of anchor and candidate tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANCHOR_TILE = 1024
CANDIDATE_TILE = 4096
LEAF = 32
_LONG = 2**63 - 1


def leaf_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """int64 product of two small matrices: by doubles where every sum is exact in them, else in integers."""
    if a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _padded(m: np.ndarray, rows: int, cols: int) -> np.ndarray:
    out = np.zeros((rows, cols), np.int64)
    out[: m.shape[0], : m.shape[1]] = m
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b for int64 matrices of any shape by Strassen's recursion: seven products of halves in place of eight.

    Both are padded with zeros to multiples of 2^levels, halved until one side is at most `leaf`. Integer additions are
    exact modulo 2^64, so the result is exact whenever it fits in longs, even if a sum on the way does not.
    """
    rows, inner, cols = a.shape[0], a.shape[1], b.shape[1]
    if min(rows, inner, cols) == 0:
        return np.zeros((rows, cols), np.int64)
    levels, side = 0, min(rows, inner, cols)
    while side > leaf:
        levels, side = levels + 1, -(-side // 2)
    unit = 1 << levels
    up = lambda n: -(-n // unit) * unit
    return _halved(_padded(a, up(rows), up(inner)), _padded(b, up(inner), up(cols)), levels)[:rows, :cols]


def _halved(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    if not levels:
        return leaf_product(a, b)
    r, k, c = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :k], a[:r, k:], a[r:, :k], a[r:, k:]
    b11, b12, b21, b22 = b[:k, :c], b[:k, c:], b[k:, :c], b[k:, c:]
    times = lambda x, y: _halved(x, y, levels - 1)
    out = np.empty((2 * r, 2 * c), np.int64)
    m = times(a11 + a22, b11 + b22)
    out[:r, :c] = m
    out[r:, c:] = m
    m = times(a21 + a22, b11)
    out[r:, :c] = m
    out[r:, c:] -= m
    m = times(a11, b12 - b22)
    out[:r, c:] = m
    out[r:, c:] += m
    m = times(a22, b21 - b11)
    out[:r, :c] += m
    out[r:, :c] += m
    m = times(a11 + a12, b22)
    out[:r, :c] -= m
    out[:r, c:] += m
    out[r:, c:] += times(a21 - a11, b11 + b12)
    out[:r, :c] += times(a12 - a22, b21 + b22)
    return out


def scores_of(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows of whole doubles, held within longs.

    Where a product could pass a long, Python integers take Strassen's place, so that the value can be held at the end.
    """
    bound = int(max(1, anchors.shape[1])) * int(np.abs(anchors).max(initial=0)) * int(np.abs(candidates).max(initial=0))
    if bound <= _LONG:
        return strassen(anchors.astype(np.int64), candidates.astype(np.int64).T)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
    return np.clip(whole(anchors).dot(whole(candidates).T), -_LONG - 1, _LONG).astype(np.int64)


def best_places(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest values, of equal ones the first, by partial selection; in no order."""
    if len(values) <= k:
        return np.arange(len(values))
    floor = np.partition(values, len(values) - k)[len(values) - k]
    above = np.flatnonzero(values > floor)
    return np.concatenate([above, np.flatnonzero(values == floor)[: k - len(above)]])


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest whole s with low * score <= 100 * s <= high * score, held within longs."""
    return max(-_LONG - 1, -(-low * score // 100)), min(_LONG, high * score // 100)


def _vectors(column: pd.Series, dim: int, scale: float) -> np.ndarray:
    return np.floor(scale * np.array([np.asarray(v, np.float64) for v in column]).reshape(-1, dim))


def _tile(own: pd.DataFrame, anchors: pd.DataFrame, dim: int, scale: float) -> tuple:
    own = own.sort_values("vec_id", kind="stable")
    return own["vec_id"].to_numpy(np.int64), own["label"].to_numpy(np.int64), _vectors(own["v"], dim, scale), anchors["anchor_id"].to_numpy(np.int64), anchors["anchor_label"].to_numpy(np.int64), _vectors(anchors["v"], dim, scale)


def _merged(hits: DataFrame, keys: list[str], k: int, candidate_tiles: int, order: list[Column]) -> DataFrame:
    """The k best hits of each key, of lists that are each the k best of a tile: merged in two levels, ranked from 1.

    The best of a union are among the best of its parts, so lists merge in any grouping, and no task merges more than
    the square root of the number of tiles.
    """
    branch = F.pmod(F.col("tile"), F.lit(max(1, round(candidate_tiles**0.5))))
    first = hits.withColumn("_branch", branch).withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_branch").orderBy(*order))).where(F.col("_r") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k).drop("_r", "_branch", "tile")


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, every: int = 100, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor_tile: int = ANCHOR_TILE, candidate_tile: int = CANDIDATE_TILE) -> DataFrame:
    """Hard negatives of each anchor (id divisible by `every`) and positive, exactly.

    Scores are integer inner products of floor(scale * x). An anchor's positives are its `positives` best other rows of
    its label; for each, the `negatives` best rows of other labels with low * p <= 100 * n <= high * p follow, p and n
    the scores (a negative p has no such row). Higher scores come first, ties by smaller id. Returns anchor_id,
    positive_id, rank (from 1), negative_id, positive_score, negative_score, positive_rank; a pair without a hard
    negative, or an anchor without a positive, gives no row.

    Rows with a null id, label or vector, an empty vector or a null, NaN or infinite component take no part; only
    vectors of equal length meet; other columns are not read. Rows of the anchor's id are none of its positives; if it
    repeats, its smallest label and vector ask. Repeated rows of another id are candidates each. Scores that pass a long
    are held at its bounds.

    Anchors and candidates are dealt by hash over a grid of tiles, so a hot label or many copies of a vector spread. The
    first round multiplies, within a tile, only blocks of one label; the second the whole tile, with the anchors'
    windows known from the merged positives. Each pair is thus multiplied once, but for those of one label. A task holds
    one tile of each side and their scores. Exact mining is quadratic: a vector travels once per tile of anchors and an
    anchor once per tile of candidates, twice over. The driver sees the two counts that set the grid.
    """
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and label is not null and v is not null")
    good = good.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).withColumn("dim", F.size("v")).where("dim > 0")
    asked = good.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("dim", "label", "v")).alias("a"))
    asked = asked.select("anchor_id", "a.dim", F.col("a.label").alias("anchor_label"), "a.v")
    tiles, shards = max(1, -(-asked.count() // anchor_tile)), max(1, -(-good.count() // candidate_tile))
    keys = ["dim", "shard", "tile"]
    own = good.select("dim", F.pmod(F.xxhash64("vec_id", "label", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), "vec_id", "label", "v")
    spread = lambda df: df.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("tile", F.pmod(F.xxhash64("anchor_id", F.lit(2)), F.lit(tiles)).cast("int"))

    def same_label(key: tuple, own: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(own) and len(anchors):
            ids, labels, v, anchor_ids, anchor_labels, a = _tile(own, anchors, int(key[0]), scale)
            for label in np.unique(anchor_labels):
                mine, theirs = np.flatnonzero(anchor_labels == label), np.flatnonzero(labels == label)
                for anchor, row in zip(anchor_ids[mine].tolist(), scores_of(a[mine], v[theirs]), strict=True):
                    others = np.flatnonzero(ids[theirs] != anchor)
                    others = others[best_places(row[others], positives)]
                    out += [(anchor, int(key[1]), i, s) for i, s in zip(ids[theirs[others]].tolist(), row[others].tolist(), strict=True)]
        return pd.DataFrame(out, columns=["anchor_id", "tile", "positive_id", "positive_score"]).astype("int64")

    hits = own.groupBy(*keys).cogroup(spread(asked).groupBy(*keys)).applyInPandas(same_label, "anchor_id long, tile int, positive_id long, positive_score long")
    found = _merged(hits, ["anchor_id"], positives, shards, [F.desc("positive_score"), F.asc("positive_id")]).withColumnRenamed("rank", "positive_rank")
    told = found.groupBy(F.col("anchor_id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("positive_rank", "positive_id", "positive_score"))).alias("wanted"))
    windows = asked.join(told, F.col("anchor_id") == F.col("_id")).drop("_id")

    def in_window(key: tuple, own: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(own) and len(anchors):
            ids, labels, v, anchor_ids, anchor_labels, a = _tile(own, anchors, int(key[0]), scale)
            for anchor, label, wanted, row in zip(anchor_ids.tolist(), anchor_labels.tolist(), anchors["wanted"], scores_of(a, v), strict=True):
                asks = [(p, *window_of(int(p["positive_score"]), low, high)) for p in wanted]
                asks = [x for x in asks if x[1] <= x[2]]
                if not asks:
                    continue
                near = np.flatnonzero((row >= min(x[1] for x in asks)) & (row <= max(x[2] for x in asks)) & (labels != label))
                values = row[near]
                for p, least, greatest in asks:
                    within = np.flatnonzero((values >= least) & (values <= greatest))
                    within = within[best_places(values[within], negatives)]
                    out += [(anchor, int(p["positive_rank"]), int(p["positive_id"]), int(p["positive_score"]), int(key[1]), i, s) for i, s in zip(ids[near[within]].tolist(), values[within].tolist(), strict=True)]
        return pd.DataFrame(out, columns=["anchor_id", "positive_rank", "positive_id", "positive_score", "tile", "negative_id", "negative_score"]).astype("int64")

    hard = own.groupBy(*keys).cogroup(spread(windows).groupBy(*keys)).applyInPandas(in_window, "anchor_id long, positive_rank int, positive_id long, positive_score long, tile int, negative_id long, negative_score long")
    ranked = _merged(hard, ["anchor_id", "positive_rank"], negatives, shards, [F.desc("negative_score"), F.asc("negative_id")])
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")


def shifted_labels(vectors: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """vectors with label (label + 1) % labels where vec_id is divisible by `every`: wrong labels at known places."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))
