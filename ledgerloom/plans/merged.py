"""Registered queries of merge sinks: two batches into stored tables, read back, and their audit."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.operators.durable import shared_folder
from ledgerloom.operators.merge import GraphStore
from ledgerloom.plans import fixtures as fx
from ledgerloom.plans.registered import query


def _store(spark, sf):
    """Parts, and the theme of each order by its priority; then large parts renamed, suppliers, and finished orders closed."""
    store = GraphStore(spark, f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}", parts=8)
    part, supplier, orders = (fx.table(spark, sf, t) for t in ("part", "supplier", "orders"))
    node = lambda df, letter, key, kind, name, seq: df.select(F.concat(F.lit(letter), key).alias("node_id"), F.lit(kind).alias("node_type"), name.alias("name"), F.lit(seq).cast("long").alias("seq"))
    theme = lambda df, value: df.select(F.col("o_orderkey").cast("string").alias("doc"), value.alias("node_id"), F.lit("theme").alias("role"))
    store.merge("first", nodes=node(part, "p", "p_partkey", "part", F.col("p_name"), 1), links=theme(orders, F.col("o_orderpriority")))
    large, done = part.where("p_size > 25"), orders.where("o_orderstatus = 'F'")
    party = done.select(F.col("o_orderkey").cast("string").alias("doc"), F.concat(F.lit("c"), "o_custkey").alias("node_id"), F.lit("party").alias("role"))
    store.merge("second", nodes=node(large, "p", "p_partkey", "part", F.upper("p_name"), 2).unionByName(node(supplier, "s", "s_suppkey", "supplier", F.col("s_name"), 2)), links=theme(done, F.lit("closed")).unionByName(party))
    return store


@query(
    "select 'p' || p_partkey a, case when p_size > 25 then upper(p_name) else p_name end b, 'part' kind from part union all select 's' || s_suppkey, s_name, 'supplier' from supplier "
    "union all select o_orderkey::varchar, case when o_orderstatus = 'F' then 'closed' else o_orderpriority end, 'theme' from orders union all select o_orderkey::varchar, 'c' || o_custkey, 'party' from orders where o_orderstatus = 'F'"
)
def merged_graph(spark, sf):
    store = _store(spark, sf)
    nodes = store.nodes.read().select(F.col("node_id").alias("a"), F.col("name").alias("b"), F.col("node_type").alias("kind"))
    return nodes.unionByName(store.links.read().select(F.col("doc").alias("a"), F.col("node_id").alias("b"), F.col("role").alias("kind")))


@query(
    "select 'nodes' \"table\", 'inserted' action, (select count(*) from part) + (select count(*) from supplier) \"rows\" union all select 'nodes', 'updated', count(*) from part where p_size > 25 "
    "union all select 'links', 'inserted', (select count(*) from orders) + 2 * (select count(*) from orders where o_orderstatus = 'F') union all select 'links', 'deleted', count(*) from orders where o_orderstatus = 'F'"
)
def merge_audit(spark, sf):
    return _store(spark, sf).audit().groupBy("table", "action").agg(F.count(F.lit(1)).alias("rows"))
