"""Registered queries of portraits, author graphs and remapped graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import portraits
from ledgerloom.plans import fixtures as fx
from ledgerloom.plans.registered import query


@query(
    f"with {fx.LINKS_SQL}, {fx.EDGES_SQL}, s as (select 's' || s_suppkey node_id from supplier), e as (select dst node_id, src ref, '<supplied_by' detail, weight from edges), "
    "ep as (select node_id, 'edge' section, row_number() over (partition by node_id order by weight desc, ref, detail) place, ref, detail from e join s using (node_id)), own as (select distinct node_id, doc from links join s using (node_id)), "
    "a as (select node_id, doc, case o_orderstatus when 'O' then 'pending' when 'F' then 'completed' else 'dismissed' end status, o_orderdate + interval 30 day due from own join orders on doc = o_orderkey), "
    "ap as (select node_id, 'action', row_number() over (partition by node_id order by status <> 'pending', not (status = 'pending' and due < timestamp '1998-06-01'), due, doc desc), doc::varchar, status from a), "
    "dp as (select node_id, 'document', row_number() over (partition by node_id order by o_orderdate desc, doc), doc::varchar, strftime(o_orderdate, '%Y-%m-%d') from own join orders on doc = o_orderkey) "
    "select node_id, section, place::int place, ref, detail from (select * from ep union all select * from ap union all select * from dp) where place <= 10"
)
def portrait_facts(spark, sf):
    """Edges, orders to do and latest orders of every supplier."""
    o = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("doc_date"))
    todo = fx.actions(spark, sf).withColumn("doc", F.col("action_id"))
    focus = fx.nodes(spark, sf).where("node_type = 'supplier'")
    return portraits.facts(focus, fx.edges(spark, sf), fx.links(spark, sf), todo, o, F.lit("1998-06-01 00:00:00").cast("timestamp"))


_AUTHORS = """l as (select d.doc_id doc, d.source node_id, case when quality = 1 then 'author' else 'mention' end "role", (d.doc_id % 100) / 100.0 confidence, toxic, quality from documents d left join labels b on b.doc_id = d.doc_id where d.doc_id is not null),
j as (select node_id, doc, confidence, case when toxic = 1 then 'rejected' when "role" = 'author' then 'approved' else 'pending' end decision from l where source_ok(node_id)),
a as (select node_id, 'Person ' || node_id as "name", count(*) documents, sum((decision = 'approved')::int)::bigint approved, sum((decision = 'pending')::int)::bigint pending, sum((decision = 'rejected')::int)::bigint rejected from j group by all having sum((decision = 'approved')::int) > 0),
f as (select * from a order by documents desc, lower("name"), node_id limit 15)""".replace("source_ok(node_id)", "not contains(node_id, '7')")


def _authors(spark, sf):
    d = fx.table(spark, sf, "documents").where("doc_id is not null").select(F.col("doc_id").alias("doc"), F.col("source").alias("node_id"))
    b = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("doc"), "quality", "toxic")
    links = d.join(b, "doc", "left").select("doc", "node_id", F.when(F.col("quality") == 1, "author").otherwise("mention").alias("role"), ((F.col("doc") % 100) / 100).alias("confidence"))
    nodes = d.select("node_id").distinct().select("node_id", F.when(F.col("node_id").contains("7"), "organization").otherwise("person").alias("node_type"), F.concat(F.lit("Person "), "node_id").alias("name"))
    reviews = d.join(b.where("toxic = 1"), "doc").select("doc", "node_id", F.lit("rejected").alias("status"))
    return portraits.author_graph(links, nodes, reviews, "approved", 15, 12)


@query(f"with {_AUTHORS} select * from f")
def author_nodes(spark, sf):
    return _authors(spark, sf)[0]


@query(f"with {_AUTHORS} select node_id, doc, decision, confidence::double confidence, place from (select j.*, row_number() over (partition by node_id order by confidence desc, doc)::int place from j semi join f using (node_id) where decision = 'approved') where place <= 12")
def author_edges(spark, sf):
    return _authors(spark, sf)[1]


_REMAPPED = f"""{fx.LINKS_SQL}, {fx.EDGES_SQL}, m as (select 's' || s_suppkey alias, 'n' || s_nationkey canonical, s_name from supplier where s_acctbal > 0), g as (select 'p' || p_partkey node_id from part where p_size < 5)"""


def _remapped(spark, sf):
    """Suppliers in credit become one with their nation; small parts are purged."""
    mapping = fx.table(spark, sf, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("alias"), F.concat(F.lit("n"), "s_nationkey").alias("canonical"))
    purged = fx.table(spark, sf, "part").where("p_size < 5").select(F.concat(F.lit("p"), "p_partkey").alias("node_id"))
    return portraits.remap(fx.nodes(spark, sf), fx.edges(spark, sf), fx.links(spark, sf), mapping, purged)


@query(f"with {_REMAPPED} select 'p' || p_partkey node_id, 'part' node_type, p_name \"name\" from part where p_size >= 5 union all select 's' || s_suppkey, 'supplier', s_name from supplier where not (s_acctbal > 0) union all select canonical, 'supplier', min_by(s_name, alias) from m group by canonical")
def remapped_nodes(spark, sf):
    return _remapped(spark, sf)[0]


@query(f"with {_REMAPPED} select src, coalesce(canonical, dst) dst, max(weight) weight from edges left join m on dst = alias where src not in (from g) group by all")
def remapped_edges(spark, sf):
    return _remapped(spark, sf)[1].select("src", "dst", "weight")


@query(f"with {_REMAPPED} select distinct doc, coalesce(canonical, node_id) node_id from links left join m on node_id = alias where node_id not in (from g)")
def remapped_links(spark, sf):
    return _remapped(spark, sf)[2].select("doc", "node_id")
