"""Helpers that several training-data operators share: durable tables, salted numbering, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only in local mode with the setting unset."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="ledgerloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Let Python workers take texts in Arrow batches of at most BATCH_ROWS rows: a batch is held several times over, as
    Arrow, as strings and as results, and texts may be long. A lower setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


class Workspace:
    """Durable intermediate tables of one job, in a folder of their own below the shared one.

    A kept table ends the lineage, so a lost executor costs no recomputation. Tables that nothing reads any more are
    dropped at once, the whole folder at the end of the job.
    """

    def __init__(self, spark: SparkSession, name: str):
        self._spark, self._path, self._n = spark, f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self._paths: dict[int, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self._path}/{self._n}-{name}"
        df.write.parquet(path)
        out = self._spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._delete(self._paths.pop(id(table)))

    def close(self) -> None:
        self._delete(self._path)

    def _delete(self, path: str) -> None:
        target = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(target, True)


def number_within(df: DataFrame, key: str, order: list[str], sizes: DataFrame, out: str, group_rows: int = 256, deal: Column | None = None, few: bool = True) -> DataFrame:
    """Number the rows of each key from 0, in a pseudo-random but reproducible order.

    df: rows with a non-null `key`. sizes: one row (key, rows) per key, few enough to broadcast (the callers state
    why) unless few is False. A key is split by `deal` (a long, else a hash of `order`) into sub-groups of about max(group_rows, sqrt(rows)) rows, each numbered
    by itself and shifted by the sizes of the sub-groups before it, so that no task holds a whole hot key.
    """
    parts = sizes.select(F.col(key).alias("_k"), F.greatest(F.lit(1), F.ceil(F.col("rows") / F.greatest(F.lit(float(group_rows)), F.sqrt("rows")))).cast("long").alias("_parts"))
    dealt = df.join(F.broadcast(parts) if few else parts, df[key] == F.col("_k")).withColumn("_part", F.pmod(F.xxhash64(*order) if deal is None else deal, F.col("_parts"))).drop("_k", "_parts")
    by_part = dealt.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select(F.col(key).alias("_bk"), F.col("_part").alias("_bp"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)) - 1
    numbered = dealt.withColumn("_own", own)
    return numbered.join(base, (numbered[key] == base["_bk"]) & (numbered["_part"] == base["_bp"])).withColumn(out, F.col("_own") + F.col("_base")).drop("_own", "_base", "_bk", "_bp", "_part")


def number_in_order(df: DataFrame, key: str, place: str, then: list[str], out: str) -> DataFrame:
    """Number the rows of each key from 0 by (place, *then), where place is a long that no more than a few rows share.

    A key is split by ranges of 1024 places, each numbered by itself and shifted by the sizes of the ranges before it, so
    that no task holds a whole hot key.
    """
    dealt = df.withColumn("_part", F.shiftright(place, 10))
    by_part = dealt.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select(F.col(key).alias("_bk"), F.col("_part").alias("_bp"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    numbered = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(key, "_part").orderBy(place, *then)) - 1)
    return numbered.join(base, (numbered[key] == base["_bk"]) & (numbered["_part"] == base["_bp"])).withColumn(out, F.col("_own") + F.col("_base")).drop("_own", "_base", "_bk", "_bp", "_part")


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """Connected components of edges (a, b), longs: one row (node, label) per node of an edge; label is the smallest node.

    Minimum labels spread along the edges and jump through labels already found, so stars need two rounds and chains a
    logarithmic number. Each round is kept in the workspace and takes the place of the one before; only the count of
    changed labels reaches the driver.
    """
    both = work.keep(edges.select("a", "b").where("a <> b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), "edges")
    labels = work.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.col("a").alias("was"), F.least("a", "m").alias("label")), "labels")
    while not labels.where("label <> was").isEmpty():
        heard = both.join(labels.select("node", "label"), both["b"] == F.col("node")).groupBy("a").agg(F.min("label").alias("heard"))
        spread = work.keep(labels.drop("was").join(heard, F.col("node") == heard["a"], "left").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label")), "spread")
        via = spread.select(F.col("node").alias("via"), F.col("label").alias("beyond"))
        jumped = work.keep(spread.join(via, spread["label"] == via["via"], "left").select("node", "was", F.least("label", "beyond").alias("label")), "labels")
        work.drop(spread, labels)
        labels = jumped
    work.drop(both)
    return labels.select("node", "label")


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on unsigned 64-bit integers."""
    x = (x + U64(0x9E3779B97F4A7C15)).astype(U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Bytes that belong to words: ASCII letters, digits, underscore and every byte of a character beyond ASCII.
WORD_BYTE = np.array([i >= 128 or chr(i).isalnum() or chr(i) == "_" for i in range(256)])
_BASE = 0x100000001B3 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of many texts, in order, and the index of each word's text.

    A word is a maximal run of WORD_BYTE bytes of the UTF-8 text. One prefix sum over all bytes gives each word's
    polynomial hash by a difference, so no Python object is made for a word.
    """
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    hashes, owners = [], []
    start = 0
    while start < len(raw):  # about a megabyte at a time bounds memory; a longer text is taken alone and whole
        end, size = start + 1, len(raw[start])
        while end < len(raw) and size + len(raw[end]) < 1_000_000:
            size += len(raw[end])
            end += 1
        lengths = np.array([len(x) + 1 for x in raw[start:end]])
        data = np.frombuffer(b" ".join(raw[start:end]) + b" ", np.uint8)
        inside = np.zeros(len(data) + 1, bool)
        inside[1:] = WORD_BYTE[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begins, ends = edges[0::2], edges[1::2]
        up, down = _power_tables(len(data))
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * up, out=sums[1:])
        hashes.append(mix64((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(U64)))
        owners.append(np.searchsorted(np.cumsum(lengths), begins, side="right") + start)
        start = end
    if not hashes:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns that an operator is about to add; an input column of such a name gives way."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])
