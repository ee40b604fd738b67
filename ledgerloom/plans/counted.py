"""Registered queries of queues, progress, capped and grouped counts, neighbourhoods with a fallback, and totals of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import graph, ledger, taxonomy
from ledgerloom.plans import fixtures as fx
from ledgerloom.plans.registered import query
from ledgerloom.streaming import jobs

_QUEUE = """c as (select l.doc_id, d.source node_id, 'File ' || d.source || '.' || d.lang "name", case when quality = 1 then 'qualified' else 'rejected' end status, 1 - (l.doc_id % 20) / 100.0 confidence, toxic = 0 verified, lang from labels l join documents d on d.doc_id = l.doc_id),
q as (select doc_id, node_id, "name", confidence from c where status = 'qualified' and confidence >= 0.9 and verified and contains(lower("name"), 'src1') and (lang is null or lang <> 'fr') and doc_id not in (select page_id from pages where page_id % 3 = 0))"""


def _queue(spark, sf):
    """Documents with a quality as candidates; French ones are reviewed, and those with a page of a number by three are evaluated."""
    d = fx.table(spark, sf, "documents").select("doc_id", "source", "lang")
    c = fx.table(spark, sf, "labels").join(d, "doc_id")
    name = F.concat(F.lit("File "), "source", F.lit("."), "lang")
    own = c.select("doc_id", F.col("source").alias("node_id"), name.alias("name"), F.when(F.col("quality") == 1, "qualified").otherwise("rejected").alias("status"), F.round(1 - (F.col("doc_id") % 20) / 100, 4).alias("confidence"), (F.col("toxic") == 0).alias("verified"), "lang")
    seen = fx.table(spark, sf, "pages").where("page_id % 3 = 0").select(F.col("page_id").alias("doc_id")).join(own, "doc_id")
    return taxonomy.review_queue(own, own.where("lang = 'fr'"), seen, ["qualified"], 0.9, "SRC1").select("doc_id", "node_id", "name", "confidence")


@query(f"with {_QUEUE} select doc_id, node_id, \"name\", confidence::double confidence from q order by confidence desc, doc_id limit 20 offset 3")
def review_page(spark, sf):
    return taxonomy.review_page(_queue(spark, sf), 3, 20)[0]


@query(f"with {_QUEUE} select count(*) total from q")
def review_total(spark, sf):
    return taxonomy.review_page(_queue(spark, sf), 3, 20)[1]


def _evolved(spark, sf):
    p = fx.table(spark, sf, "part")
    return p.select(F.col("p_type").alias("category"), F.when(F.col("p_size") > 25, "2").when(F.col("p_size") > 10, "1").alias("version"), (F.col("p_size") < 20).alias("requeue"))


@query("select p_type category, count(*) docs, sum((p_size > 25)::int)::bigint migrated, sum((p_size < 20)::int)::bigint pending, round(100 * sum((p_size > 25)::int) / count(*), 2) migrated_pct from part group by rollup(p_type)")
def evolution_progress(spark, sf):
    return taxonomy.evolution_progress(_evolved(spark, sf), "2")


@query("select case when p_size > 25 then '2' when p_size > 10 then '1' end \"version\", count(*) docs from part group by all")
def version_counts(spark, sf):
    return taxonomy.version_counts(_evolved(spark, sf))


@query("select o_orderstatus status, count(*) docs from orders group by rollup(o_orderstatus)")
def status_counts(spark, sf):
    return ledger.status_counts(fx.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status")))


@query("select source root, count(*) locations, count(distinct sha256(text)) contents from documents group by all")
def root_counts(spark, sf):
    return ledger.root_counts(fx.table(spark, sf, "documents").select(F.col("source").alias("root"), F.sha2("text", 256).alias("sha256_hash")))


@query(f"with {fx.LINKS_SQL} select node_id, s_name \"name\", docs from (select node_id, count(*) docs from links group by all) join supplier on node_id = 's' || s_suppkey order by docs desc, node_id limit 15")
def top_suppliers(spark, sf):
    return ledger.top_entities(fx.links(spark, sf), fx.nodes(spark, sf), "supplier", 15)


_STATS = f"""{fx.LINKS_SQL}, {fx.EDGES_SQL}, n as (select 'p' || p_partkey node_id, 'part' node_type, p_name "name" from part union all select 's' || s_suppkey, 'supplier', s_name from supplier),
g as (select node_id, count(*) degree from (select src node_id from edges union all select dst from edges) group by all), k as (select node_id, count(*) docs from links group by all), st as (select n.*, coalesce(degree, 0) degree, coalesce(docs, 0) docs from n left join g using (node_id) left join k using (node_id))"""


def _stats(spark, sf):
    return graph.node_stats(fx.nodes(spark, sf), fx.edges(spark, sf), fx.links(spark, sf))


@query(f"with {_STATS} select node_id, degree, docs from st where node_type = 'part' and (docs > 0 or degree > 0)")
def verified_parts(spark, sf):
    return graph.verified_nodes(_stats(spark, sf), "part").select("node_id", "degree", "docs")


@query(f"with {_STATS}, r as (select *, row_number() over (partition by node_type order by docs desc, \"name\", node_id) r from st) select node_type, count(*) nodes, list(\"name\" order by r) filter (r <= 8) as names from r group by all")
def grouped_entities(spark, sf):
    return graph.grouped_entities(_stats(spark, sf), 8)


@query("select o_orderpriority theme, count(*) kept, sum((o_orderstatus = 'F')::int)::bigint hits from (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) r from orders) where r <= 500 group by all")
def capped_counts(spark, sf):
    o = fx.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("theme"), "o_totalprice", "o_orderkey", "o_orderstatus")
    return graph.capped_counts(o, "theme", [F.desc("o_totalprice"), F.col("o_orderkey")], 500, F.col("o_orderstatus") == "F")


_KIN = f"""{fx.LINKS_SQL}, {fx.EDGES_SQL}, ed as (select * from edges where weight > 2), seeds as (select 's' || s_suppkey node_id from supplier where s_acctbal < 0 union select 'p' || p_partkey from part where p_size = 1),
both_ as (select distinct src x, dst y from ed union select dst, src from ed), h1 as (select node_id seed, y node_id from seeds join both_ on x = node_id), h as (select seed, node_id, min(hop)::int hop from (select seed, node_id, 1 hop from h1 union all select seed, y, 2 from h1 join both_ on x = h1.node_id) where seed <> node_id group by all),
alone as (select node_id from seeds where node_id not in (select x from both_)), sh as (select a.node_id seed, b.node_id, count(*) shared from links a join links b using (doc) where a.node_id in (from alone) and a.node_id <> b.node_id group by all)"""


@query(f"with {_KIN} select seed, node_id, hop, null::bigint shared from h union all select seed, node_id, null, shared from sh")
def kin_or_shared(spark, sf):
    """Around suppliers in debt and the smallest parts, over frequent deliveries; nodes without one through shared orders."""
    seeds = fx.table(spark, sf, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node_id")).union(fx.table(spark, sf, "part").where("p_size = 1").select(F.concat(F.lit("p"), "p_partkey")))
    return graph.neighbourhood_or_shared(fx.edges(spark, sf).where("weight > 2"), fx.links(spark, sf), seeds).select("seed", "node_id", "hop", "shared")


@query("select event_type, user_id % 3 tier, count(*) events, round(sum(value), 4) value, sum(length(props))::bigint bytes from events group by all")
def event_totals(spark, sf):
    """Running totals by type and tier, with bytes of the properties."""
    e = fx.table(spark, sf, "events").withColumn("tier", F.col("user_id") % 3)
    return jobs.totals(e, ["event_type", "tier"], {"value": "value", "bytes": "length(props)"}).withColumn("value", F.round("value", 4))
