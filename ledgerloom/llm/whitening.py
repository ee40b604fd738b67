"""Whitening of embeddings by distributed block matrices."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from decimal import Decimal

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import Workspace, materialise

ROWS_PER_BLOCK = 1024
COLS_PER_BLOCK = 1024
BLOCKS_PER_SPLIT = 16
#: Scaled components are held within these bounds, so that a count is a long.
HELD = 9.0e18
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vectors: DataFrame, scale: float, shift: int, id_col: str, vector_col: str) -> DataFrame:
    """Rows (vec_id, x) with x = floor(scale * c) + shift, in longs, of the vectors that are whole and finite."""
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("size(v) > 0")
    good = good.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    held = lambda c: F.greatest(F.least(c * scale, F.lit(HELD)), F.lit(-HELD))
    return good.select("vec_id", F.transform("v", lambda c: F.floor(held(c)).cast("long") + F.lit(shift).cast("long")).alias("x"))


def numbered(table: DataFrame) -> DataFrame:
    """A stored table with a dense index from 0: rows of the files before it, and the row's place in its file.

    A second reading gives the same numbers, so a lost executor changes none. The offsets are one row per file.
    """
    placed = table.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    sizes = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(F.col("_file").alias("_f"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return placed.join(base, F.col("_file") == F.col("_f")).withColumn("index", F.col("_base") + F.col("_at")).drop("_file", "_f", "_at", "_base")


def blocks_of(rows: DataFrame, n: int, cols: int) -> BlockMatrix:
    """A block matrix of n rows (index, vector as array of doubles); the vectors never leave the JVM."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("vector").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, cols).toBlockMatrix(ROWS_PER_BLOCK, min(cols, COLS_PER_BLOCK))


@contextmanager
def kept(matrix: BlockMatrix) -> Iterator[BlockMatrix]:
    """The matrix with its blocks stored on the executors for as long as several products read them; what is lost with an
    executor is made again."""
    matrix.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield matrix
    finally:
        matrix._java_matrix_wrapper._java_model.blocks().unpersist(False)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """transpose(matrix) * matrix, on the driver: columns times columns, whatever the number of rows.

    The product has few blocks, so it is cut along the rows as well: each part sums BLOCKS_PER_SPLIT blocks of rows,
    and only the parts' sums meet.
    """
    splits = max(1, -(-int(matrix.numRows()) // (matrix.rowsPerBlock * BLOCKS_PER_SPLIT)))
    transposed = matrix.transpose()._java_matrix_wrapper
    product = transposed.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def projected(spark: SparkSession, matrix: BlockMatrix, weights: np.ndarray) -> DataFrame:
    """Rows (index, values) of matrix * weights, a local matrix that is cut into blocks along the columns of matrix."""
    side, k = matrix.colsPerBlock, weights.shape[1]
    local = [((i // side, 0), DenseMatrix(*part.shape, part.ravel(order="F"))) for i in range(0, len(weights), side) for part in [weights[i : i + side]]]
    right = BlockMatrix(spark.sparkContext.parallelize(local, 1), side, k, len(weights), k)
    rows = callMLlibFunc("getIndexedRows", matrix.multiply(right).toIndexedRowMatrix()._java_matrix_wrapper._java_model)  # .rows, without a way through Python
    return rows.select("index", vector_to_array("vector").alias("values"))


def eigen(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues by falling size, unit eigenvectors as columns, and which eigenvalues are not zero up to rounding."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return values, vectors, values > max(values[0], 0) * len(covariance) * np.finfo(float).eps


def whiten(vectors: DataFrame, components: int = 8, scale: float = 1024.0, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Every vector on the leading `components` eigenvectors of the covariance, scaled to variance one: one row each.

    x = floor(scale * c) + shift (scale * c held within 9.0e18). Returned: vec_id, component (from 1, by falling eigenvalue e; no more than the
    dimensions), n (rows), deviation (sum over dimensions of (n * x - S)^2, exact, S the sums of x; null if it passes a
    long), whitened ((x - S / n) on the component, over sqrt(e)), explained (e over the trace), identity_error (largest
    entry of whitened's covariance minus the identity, over components with e > 0).

    Rows whose vector is null or empty or holds a null, NaN or infinite entry take no part; of vectors of several
    lengths the most frequent length stays (of equally frequent ones the greatest). Null ids stay; repeated rows count
    and are returned as often as they come; other columns are not read. A component whose eigenvalue is zero up to
    rounding has whitened null; if all are (one row, or equal rows), explained and identity_error are null too. No
    usable row gives no row.

    The driver holds the sums and a matrix of dimensions x dimensions, and its block products know the places of the
    blocks (ROWS_PER_BLOCK rows each), never their content. Centring comes first: (n * x - S) in longs, then one
    division.
    """
    spark, work = vectors.sparkSession, Workspace(vectors.sparkSession, "whitening")
    try:
        table = work.keep(usable(vectors, scale, shift, id_col, vector_col), "counts")
        dims = table.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
        if not dims:
            return spark.createDataFrame([], SCHEMA)
        d = dims[0]["d"]
        if table.where(F.size("x") != d).limit(1).collect():
            table = work.keep(table.where(F.size("x") == d), "of-one-length")
        sums, largest, n = [0] * d, 1, table.count()
        for r in table.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(19,0)")).alias("s"), F.max(F.abs("c")).alias("m")).collect():
            sums[r["i"]], largest = int(r["s"]), max(largest, r["m"])
        kind = "long" if 2 * n * largest < 2**63 else "decimal(38,0)"  # longs where nothing can pass them, with the same values
        total, times = F.array(*[F.lit(Decimal(s)).cast(kind) for s in sums]), F.lit(n).cast("long" if kind == "long" else "decimal(18,0)")
        rows = numbered(table).select("vec_id", "index", F.zip_with("x", total, lambda a, s: (a.cast("long" if kind == "long" else "decimal(19,0)") * times - s).cast(kind)).alias("centred"))
        whole = "decimal(38,0)"
        square = lambda a: F.try_multiply(a.cast("decimal(19,0)" if kind == "long" else whole), a.cast("decimal(19,0)" if kind == "long" else whole)).cast(whole)
        deviation = F.aggregate("centred", F.lit(0).cast(whole), lambda acc, a: F.try_add(acc, square(a)).cast(whole))
        with kept(blocks_of(rows.select("index", F.transform("centred", lambda a: a.cast("double") / n).alias("vector")), n, d)) as matrix:
            covariance = scatter(matrix) / n
            values, axes, real = eigen(covariance, min(components, d))
            trace = float(np.trace(covariance))
            weights = np.where(real, axes / np.sqrt(np.where(real, values, 1)), 0.0)
            scores = work.keep(projected(spark, matrix, weights), "projected")
        error = identity_error(scores, n, int(real.sum()))
        doubles = lambda xs: F.array(*[F.lit(None if x is None else float(x)).cast("double") for x in xs])
        shares = doubles([e / trace if trace > 0 else None for e in values])
        known = F.array(*[F.lit(bool(r)) for r in real])
        of = scores.withColumnRenamed("index", "_i")
        out = rows.select("vec_id", "index", deviation.try_cast("long").alias("deviation")).join(of, F.col("index") == F.col("_i")).select("vec_id", "deviation", F.posexplode("values").alias("_c", "_w"))
        out = out.select(
            "vec_id", (F.col("_c") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(F.get(known, F.col("_c")), F.col("_w")).alias("whitened"),
            F.get(shares, F.col("_c")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
        )
        return materialise(out, "whitened")
    finally:
        work.close()


def identity_error(scores: DataFrame, n: int, k: int) -> float | None:
    """Largest absolute entry of the covariance of the first k values, centred before multiplying, minus the identity."""
    if not k:
        return None
    means = scores.agg(*[F.avg(F.get("values", F.lit(i))).alias(f"m{i}") for i in range(k)]).first()
    centred = scores.select("index", F.zip_with(F.slice("values", 1, k), F.array(*[F.lit(m) for m in means]), lambda a, m: a - m).alias("vector"))
    with kept(blocks_of(centred, n, k)) as matrix:
        return float(np.abs(scatter(matrix) / n - np.eye(k)).max())
