"""Stored tables that are merged by key: only partitions that a batch touches are read and rewritten, and every change is told."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.operators.durable import Workspace
from ledgerloom.operators.ledger import insert_if_absent, set_single_theme, upsert

PARTS = 64
AUDIT = "table string, key string, action string, at timestamp"


def _schema(**columns: str) -> StructType:
    out = StructType()
    for name, kind in columns.items():
        out = out.add(name, kind)
    return out


def chunk_id(document: Column, index: Column) -> Column:
    """Deterministic id of a chunk: SHA-256 of the document's key and the chunk's place."""
    return F.sha2(F.concat_ws(":", document.cast("string"), index.cast("string")), 256)


@dataclass
class KeyedTable:
    """A Parquet table in folders by a hash of `by`, columns of its key; a row's folder never changes."""

    spark: SparkSession
    path: str
    schema: StructType
    keys: list[str]
    by: list[str]
    parts: int = PARTS

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.parts)).cast("int")

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def read(self, touched: list[int] | None = None) -> DataFrame:
        """All rows, or those of some folders; the others are not opened."""
        if not self._exists(self.path):
            return self.spark.createDataFrame([], self.schema)
        df = self.spark.read.schema(StructType([*self.schema.fields]).add("part", "integer")).parquet(self.path)
        df = df if touched is None else df.where(F.col("part").isin(touched))
        return df.select(*self.schema.names)

    def merge(self, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], audit: str | None = None, name: str = "", at: Column | None = None) -> None:
        """Replace the rows of the touched folders by combine(stored rows there, batch).

        batch needs the columns of `by`; combine must keep rows of other keys. audit: a folder for AUDIT rows (inserted,
        updated or deleted keys) of this merge, which are written before the table. If the merge is run again after a
        failure, the audit that is already complete stays and the table is written again, so a combine that gives the
        same rows when repeated leaves the same table and one audit.
        """
        with Workspace(self.spark, "merge") as work:
            batch = work.keep(batch)
            touched = sorted(r["p"] for r in batch.select(self._part().alias("p")).distinct().collect())  # `parts` numbers at most
            if not touched:
                return
            old = self.read(touched)
            new = work.keep(combine(old, batch).select(*self.schema.names))
            if audit is not None and not self._exists(f"{audit}/_SUCCESS"):
                self._changes(old, new, name, F.current_timestamp() if at is None else at).write.mode("overwrite").parquet(audit)
            rest = self.spark.createDataFrame([(p,) for p in touched], "part int")
            out = new.withColumn("part", self._part())
            self._empty(rest.join(out.select("part").distinct(), "part", "left_anti"))
            out.repartition("part").sortWithinPartitions(*self.keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)

    def _empty(self, gone: DataFrame) -> None:
        """Folders that lost all their rows: dynamic overwriting would leave them as they are."""
        for row in gone.collect():
            target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/part={row['part']}")
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def _changes(self, old: DataFrame, new: DataFrame, name: str, at: Column) -> DataFrame:
        key = F.to_json(F.struct(*self.keys))
        told = lambda df, out: df.groupBy(key.alias("key")).agg(F.sum(F.xxhash64(*self.schema.names).cast("decimal(20,0)")).alias(out))
        both = told(old, "before").join(told(new, "after"), "key", "full")
        action = F.when(F.col("before").isNull(), "inserted").when(F.col("after").isNull(), "deleted").when(F.col("before") != F.col("after"), "updated")
        return both.select(F.lit(name).alias("table"), "key", action.alias("action"), at.cast("timestamp").alias("at")).where("action is not null")


class GraphStore:
    """Nodes, edges and links of a property graph as keyed tables below a folder, with an audit of every merge.

    Nodes and edges are merged by key, the row with the greatest seq wins; links are inserted if absent, and a document
    of the batch that comes with a theme loses the themes that it had. A batch has a name: its audit lies under that
    name, and running it again changes nothing.
    """

    NODES = _schema(node_id="string", node_type="string", name="string", seq="long")
    EDGES = _schema(src="string", dst="string", relation="string", weight="double", seq="long")
    LINKS = _schema(doc="string", node_id="string", role="string")

    def __init__(self, spark: SparkSession, folder: str, parts: int = PARTS):
        self._spark, self._folder = spark, folder
        self.nodes = KeyedTable(spark, f"{folder}/nodes", self.NODES, ["node_id"], ["node_id"], parts)
        self.edges = KeyedTable(spark, f"{folder}/edges", self.EDGES, ["src", "dst", "relation"], ["src"], parts)
        self.links = KeyedTable(spark, f"{folder}/links", self.LINKS, ["doc", "node_id", "role"], ["doc"], parts)

    def merge(self, batch: str, nodes: DataFrame | None = None, edges: DataFrame | None = None, links: DataFrame | None = None) -> None:
        for name, table, rows in (("nodes", self.nodes, nodes), ("edges", self.edges, edges)):
            if rows is not None:
                table.merge(rows.select(*table.schema.names), lambda old, new, t=table: upsert(old, new, t.keys, "seq"), f"{self._folder}/audit/batch={batch}/{name}", name)
        if links is not None:
            keys = self.links.keys
            put = lambda old, new: insert_if_absent(set_single_theme(old, new.where("role = 'theme'").dropDuplicates(["doc"])), new.where("role <> 'theme'"), keys)
            self.links.merge(links.select(*keys).distinct(), put, f"{self._folder}/audit/batch={batch}/links", "links")

    def audit(self) -> DataFrame:
        """AUDIT rows of all batches."""
        return self._spark.read.schema(AUDIT).option("recursiveFileLookup", True).parquet(f"{self._folder}/audit")


class ChunkStore(KeyedTable):
    """Chunks of documents by deterministic id: a document's chunks are replaced as a whole, or deleted with it."""

    SCHEMA = _schema(chunk_id="string", doc="string", chunk_index="integer", chunk_text="string")

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        super().__init__(spark, path, self.SCHEMA, ["chunk_id"], ["doc"], parts)

    def replace(self, chunks: DataFrame) -> None:
        """chunks (doc, chunk_index, chunk_text) take the place of all that their documents had."""
        rows = chunks.select(chunk_id(F.col("doc"), F.col("chunk_index")).alias("chunk_id"), "doc", "chunk_index", "chunk_text").dropDuplicates(["chunk_id"])
        self.merge(rows, lambda old, new: old.join(new.select("doc").distinct(), "doc", "left_anti").select(*self.schema.names).unionByName(new))

    def delete(self, docs: DataFrame) -> None:
        """Remove the chunks of documents (doc)."""
        self.merge(docs.select("doc").distinct(), lambda old, gone: old.join(gone, "doc", "left_anti"))
