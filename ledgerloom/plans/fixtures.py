"""How the given tables stand for the engine's inputs: names of documents, graph tables, obligations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.durable import dealt, parts_for, small_batches

#: The same expression in Spark SQL and in DuckDB: an invented file name of a document.
FILE_NAME = """case doc_id % 6
 when 0 then concat(lpad(cast(doc_id % 31 + 1 as string), 2, '0'), '.', lpad(cast(doc_id % 12 + 1 as string), 2, '0'), '.25-', source, '.txt')
 when 1 then concat('2024-', lpad(cast(doc_id % 12 + 1 as string), 2, '0'), '-', lpad(cast(doc_id % 28 + 1 as string), 2, '0'), '_', source, '_final.txt')
 when 2 then concat(source, '_v', cast(doc_id % 4 + 1 as string), '.txt')
 when 3 then concat(source, '_draft_', cast(doc_id as string), '.txt')
 when 4 then concat('note ', source, ' 20191105 x.txt')
 else concat(source, '_', cast(doc_id as string), '.txt') end"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Texts that come in fewer splits than there are cores are dealt out; larger inputs are read as they lie."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in ("documents", "pages"):
        small_batches(spark)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("filename", F.expr(FILE_NAME))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers of an order as entity links of a document; many lines are dealt by order, before they make two links."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), "l_partkey", "l_suppkey")
    both = F.explode(F.array(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")))
    return dealt(items, link_parts(spark, sf_dir), "doc").select("doc", both.alias("node_id")).distinct()


def link_parts(spark: SparkSession, sf_dir: str) -> int | None:
    """Partitions for two links a line."""
    return parts_for(spark, 2 * table(spark, sf_dir, "lineitem").count())


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part supplied by supplier, weighted by the number of lines."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    pair = dealt(items, parts_for(spark, items.count()), "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("weight"))
    return pair.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.lit("supplied_by").alias("relation"), "weight")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node_id"), F.lit("part").alias("node_type"), F.col("p_name").alias("name"))
    return part.unionAll(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node_id"), F.lit("supplier").alias("node_type"), F.col("s_name").alias("name")))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as obligations: due a month after their date, of the theme of their priority."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "completed").otherwise("dismissed")
    return o.select(F.col("o_orderkey").alias("action_id"), F.col("o_custkey").alias("party"), F.col("o_orderpriority").alias("action_type"), F.col("o_orderpriority").alias("theme"), status.alias("status"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("due"))


LINKS_SQL = "links as (select distinct doc, node_id from (select l_orderkey doc, 'p' || l_partkey node_id from lineitem union all select l_orderkey, 's' || l_suppkey from lineitem))"
EDGES_SQL = "edges as (select 'p' || l_partkey src, 's' || l_suppkey dst, count(*) weight from lineitem group by all)"
ACTIONS_SQL = "actions as (select o_orderkey action_id, o_custkey party, o_orderpriority action_type, o_orderpriority theme, case o_orderstatus when 'O' then 'pending' when 'F' then 'completed' else 'dismissed' end status, o_orderdate as \"start\", o_orderdate + interval 30 day due from orders)"
