"""Registered queries of graph rules: sampling by recency, first edges, merged links, pruning, retries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import graph
from ledgerloom.plans import catalogue as C
from ledgerloom.plans import fixtures as fx
from ledgerloom.plans.registered import query
from ledgerloom.streaming import jobs


@query(
    f"with {C._STATS}, latest as (select node_id, max(o_orderdate) latest from links join orders on doc = o_orderkey group by all), "
    "r as (select *, row_number() over (partition by node_type order by degree * 2 + docs * 5 desc, node_id) r from stats left join latest using (node_id)) "
    "select node_id, node_type, overall from (select *, degree * 2 + docs * 3 + (coalesce(year(latest), 2005) - 2005) * 10 overall from r where r <= 120) order by overall desc, node_id limit 150"
)
def sampled_nodes(spark, sf):
    """The sample is the feature: a picture of a graph has room for so many nodes."""
    dates = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_orderdate").alias("doc_date"))
    stats = graph.node_stats(fx.nodes(spark, sf), fx.edges(spark, sf), fx.links(spark, sf), dates)
    return graph.sampled_nodes(stats, 120, 150).select("node_id", "node_type", "overall")


@query("select 'p' || l_partkey src, 's' || l_suppkey dst, l_returnflag relation, min_by(l_quantity::double, (l_orderkey, l_linenumber))::double weight from lineitem group by all")
def first_edges(spark, sf):
    items = fx.table(spark, sf, "lineitem")
    place = F.struct("l_orderkey", "l_linenumber")
    edges = items.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.col("l_returnflag").alias("relation"), F.col("l_quantity").cast("double").alias("weight"), place.alias("place"))
    return graph.first_edges(edges, "place")


@query(f"with {fx.LINKS_SQL} select distinct doc, case when node_id like 'p%7' then 'p1' else node_id end node_id from links")
def consolidated_links(spark, sf):
    aliases = fx.nodes(spark, sf).where("node_id like 'p%7'").select(F.col("node_id").alias("alias"), F.lit("p1").alias("canonical"))
    return graph.consolidate_links(fx.links(spark, sf), aliases, fx.link_parts(spark, sf))


_GRAPH = """n as (select 'c' || c_custkey node_id, 'contract_type' node_type, c_mktsegment "name" from customer union all select 's' || s_suppkey, 'person', s_name from supplier
 union all select 'n' || n_nationkey, 'organization', n_name from nation), e as (select 's' || s_suppkey src, 'n' || s_nationkey dst from supplier where s_acctbal > 0),
 o as (select *, node_id not in (select src from e union select dst from e) alone from n),
 j as (select node_id, case when node_type = 'organization' and "name" in (select n_name from nation where n_regionkey < 3) then 'location' when node_type = 'contract_type' and lower("name") not like '%build%' then 'document_category' else node_type end node_type,
  "name", alone and "name" like '%3' noise from o), listed as (select node_id from j where not noise and node_type = 'person' and "name" like '%9')"""


def _pruned(spark, sf):
    t = lambda name: fx.table(spark, sf, name)
    nodes = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("node_id"), F.lit("contract_type").alias("node_type"), F.col("c_mktsegment").alias("name"))
    nodes = nodes.unionAll(t("supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.lit("person"), "s_name")).unionAll(t("nation").select(F.concat(F.lit("n"), "n_nationkey"), F.lit("organization"), "n_name"))
    edges = t("supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    links = fx.links(spark, sf).where("node_id like 's%'")
    places = t("nation").where("n_regionkey < 3").select(F.col("n_name").alias("name"))
    return graph.prune(nodes, edges, links, F.col("name").like("%3"), places, contracts=("build",), blacklist={"person": "9$"})


@query(f"with {_GRAPH} select node_id, node_type from j where not noise and node_id not in (from listed)")
def pruned_nodes(spark, sf):
    return _pruned(spark, sf)[0].select("node_id", "node_type")


@query(f"with {_GRAPH} select src, dst from e where src not in (from listed) and dst not in (from listed)")
def pruned_edges(spark, sf):
    return _pruned(spark, sf)[1]


@query(f"with {fx.LINKS_SQL}, {_GRAPH} select doc, node_id from links where node_id like 's%' and node_id not in (from listed) and node_id not in (select node_id from j where noise)")
def pruned_links(spark, sf):
    return _pruned(spark, sf)[2].select("doc", "node_id")


_LETTERS = "l as (select event_id doc_id, event_id % 4 retries, value v from events where event_type = 'error' or value > 50)"


@query(f"with {_LETTERS} select doc_id, (case when retries < 3 then retries + 1 else retries end)::int retries from l where retries >= 3 or v > 100")
def failed_again(spark, sf):
    """Events as dead letters: the work still fails for great values."""
    letters = fx.table(spark, sf, "events").where("event_type = 'error' or value > 50").select(F.col("event_id").alias("doc_id"), F.col("value").alias("v"), (F.col("event_id") % 4).cast("int").alias("retries"), F.lit("old").alias("error"))
    return jobs.retry(letters, lambda b: b.withColumn("error", F.when(F.col("v") > 100, "too great")))[1].select("doc_id", "retries")
