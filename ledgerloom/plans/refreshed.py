"""Registered queries of the refresh jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import refresh, retrieval
from ledgerloom.plans import fixtures as fx
from ledgerloom.plans.registered import query


@query(
    """with p as (select doc_id, list_transform(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\n{2,}'), lambda p: list_filter(regexp_split_to_array(p, '\\s+'), lambda w: w <> '')) ps from documents),
w as (select doc_id, flatten(list_transform(list_filter(ps, lambda p: len(p) > 0), lambda p: list_append(p, chr(10) || chr(10)))) w from p),
c as (select doc_id, w, unnest(range(0, len(w), 520)) i from w),
t as (select doc_id, (i // 520)::int chunk_index, list_distinct(regexp_extract_all(lower(array_to_string(w[i + 1 : i + 600], ' ')), '[\\p{L}\\p{N}_]+')) t from c),
h as (select doc_id, chunk_index, len(list_distinct(list_transform(t, lambda x: ('0x' || substr(sha256(x), 1, 8))::bigint % 64))) filled from t)
select h.doc_id, chunk_index, vec_id is not null kept, coalesce(len(list_filter(embedding, lambda x: x <> 0)), filled)::int filled from h left join embeddings on vec_id = h.doc_id and chunk_index = 0"""
)
def refreshed_embeddings(spark, sf):
    """Given vectors stand for those of first chunks; every other chunk gets a hashed one."""
    chunks = retrieval.chunks(fx.table(spark, sf, "documents"))
    vectors = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_index"), "embedding")
    return refresh.refresh_embeddings(chunks, vectors).select("doc_id", "chunk_index", "kept", F.size(F.filter("embedding", lambda x: x != 0)).alias("filled"))


@query(
    "with old as (select distinct l_orderkey doc, 's' || l_suppkey node_id from lineitem where l_linenumber = 1), "
    "e as (select l_orderkey doc, 's' || l_suppkey node_id, max(l_quantity) c from lineitem group by all), "
    "g as (select o_orderkey doc, 'location_r' || (o_custkey % 5) node_id, max(0.5) c from orders where o_custkey % 7 < 5 group by all) "
    "select doc::varchar doc_id, node_id, 'supplied_by' \"role\", 1.0::double confidence from old union all select doc::varchar, node_id, 'supplied_by', c::double from e where (doc, node_id) not in (from old) union all select doc::varchar, node_id, 'LOCATED_IN', c::double from g"
)
def mirrored_table_links(spark, sf):
    """Suppliers of an order's first line are linked already; the rest comes from edges, and regions from places."""
    items = fx.table(spark, sf, "lineitem")
    doc, node = F.col("l_orderkey").cast("string"), F.concat(F.lit("s"), "l_suppkey")
    links = items.where("l_linenumber = 1").select(doc.alias("doc_id"), node.alias("node_id"), F.lit("supplied_by").alias("role"), F.lit(1.0).alias("confidence")).distinct()
    edges = items.select(F.concat(F.lit("doc_"), doc).alias("src"), node.alias("dst"), F.lit("supplied_by").alias("relation"), F.col("l_quantity").alias("weight"))
    orders = fx.table(spark, sf, "orders")
    placed = orders.where("o_custkey % 7 < 5").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.concat(F.lit("R"), F.col("o_custkey") % 5).alias("geo_id"), F.lit(0.5).alias("confidence"))
    regions = fx.table(spark, sf, "region").select(F.concat(F.lit("location_r"), "r_regionkey").alias("node_id"), F.lit("{}").alias("properties"))
    nodes = fx.table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node_id"), F.lit("{}").alias("properties")).unionByName(regions)
    return refresh.mirror_links(links, edges, placed, nodes, orders.select(F.col("o_orderkey").cast("string").alias("doc_id")), fx.link_parts(spark, sf))
