"""Registered queries of names: aliases, paths of statutes, parts of file names, canonical candidates, links by id or property."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import features as X
from ledgerloom.operators import actions, dedup, graph, ledger, retrieval, review
from ledgerloom.plans import fixtures as fx
from ledgerloom.plans.registered import query
from ledgerloom.sources import files


@query(
    "with p as (select p_name party, p_partkey from part), a as (select p_partkey org_id, lower(case when p_partkey % 2 = 0 then split_part(p_name, ' ', 1) else p_name || ' gmbh' end) alias from part where p_partkey % 5 = 0) "
    "select party, min(org_id) org_id from p join a on contains(' ' || lower(party) || ' ', ' ' || alias || ' ') or contains(' ' || alias || ' ', ' ' || lower(party) || ' ') group by party"
)
def alias_organisations(spark, sf):
    """Parts as parties; every fifth one's first word, or its name with a suffix, as an alias."""
    parts = fx.table(spark, sf, "part")
    alias = F.when(F.col("p_partkey") % 2 == 0, F.split("p_name", " ")[0]).otherwise(F.concat("p_name", F.lit(" gmbh")))
    return actions.resolve_aliases(parts.select(F.col("p_name").alias("party")), parts.where("p_partkey % 5 = 0").select(alias.alias("alias"), F.col("p_partkey").alias("org_id")))


@query(
    "with n as (select page_id, case page_id % 3 when 0 then 'laws/SR-' || (page_id % 900) || '-x-DE.xml' when 1 then 'laws/SR_' || (page_id % 900) || '/IT/a.xml' else 'laws/RS-' || (page_id % 900) || '.1-y-fr.xml' end path from pages) "
    "select page_id, case page_id % 3 when 2 then (page_id % 900) || '.1' else (page_id % 900)::varchar end code, case page_id % 3 when 0 then 'de' when 1 then 'it' else 'fr' end lang from n"
)
def statute_paths(spark, sf):
    number = (F.col("page_id") % 900).cast("string")
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("laws/SR-"), number, F.lit("-x-DE.xml"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("laws/SR_"), number, F.lit("/IT/a.xml"))).otherwise(F.concat(F.lit("laws/RS-"), number, F.lit(".1-y-fr.xml")))
    found = fx.table(spark, sf, "pages").select("page_id", files.code_and_language(path).alias("c"))
    return found.select("page_id", "c.code", "c.lang")


@query("select s_suppkey, len(list_filter(regexp_split_to_array(regexp_replace(lower(regexp_replace(s_name || 'CamelCase7', '([a-z])([A-Z])', '\\1 \\2', 'g')), '([a-z])([0-9])', '\\1 \\2', 'g'), '[^a-z0-9]+'), lambda x: len(x) > 0)) tokens from supplier")
def name_parts(spark, sf):
    return fx.table(spark, sf, "supplier").select("s_suppkey", F.size(X.name_tokens(F.concat("s_name", F.lit("CamelCase7")))).alias("tokens"))


_DATED = "case when l_linenumber = 1 then 0.9 when l_linenumber = 2 then 0.5 else 0.3 end"


@query(f"with c as (select l_orderkey query_id, l_partkey doc_id, round(0.5 * l_discount::double * 10 + 0.4 * {_DATED} + 0.1 * (l_returnflag = 'R')::int, 6)::double score from lineitem) select query_id, min_by(doc_id, (-score, doc_id)) doc_id, max(score) score from c group by all")
def canonical_candidates(spark, sf):
    """Parts of an order as candidates of a query."""
    lines = fx.table(spark, sf, "lineitem")
    maturity = F.when(F.col("l_linenumber") == 1, 0.9).when(F.col("l_linenumber") == 2, 0.5).otherwise(0.3)
    rows = lines.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), (F.col("l_discount").cast("double") * 10).alias("similarity"), maturity.alias("maturity"), (F.col("l_returnflag") == "R").alias("is_primary"))
    return dedup.canonical_candidate(rows).select("query_id", "doc_id", "score")


@query("select o_orderkey doc, case when o_custkey % 2 = 0 then 'c' || o_custkey else 'loc' || o_custkey end node_id from orders join customer on o_custkey = c_custkey")
def links_by_id_or_property(spark, sf):
    """Orders name an even customer by its id and an odd one by a property."""
    t = lambda name: fx.table(spark, sf, name)
    own = F.col("c_custkey").cast("string")
    nodes = t("customer").select(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("c"), own)).otherwise(F.concat(F.lit("loc"), own)).alias("node_id"), F.when(F.col("c_custkey") % 2 == 1, F.concat(F.lit('{"geo_id": "c'), own, F.lit('"}'))).otherwise("{}").alias("properties"))
    return graph.mirror_by_slug_or_property(t("orders").select(F.col("o_orderkey").alias("doc"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("key")), nodes)


@query(
    "with f as (select l_orderkey query_id, l_partkey doc_id from lineitem group by all) "
    "select query_id, count(case when p_size > 25 then 1 end) large, count(case when doc_id % 2 = 0 then 1 end) even, coalesce(sum(len(p_name)), 0) >= 80 grounded from f left join part on doc_id = p_partkey group by query_id"
)
def signal_counts(spark, sf):
    """Parts of an order as a query's fused documents, the large and the even ones as the lists, names as chunks."""
    fused = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id")).distinct()
    parts = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), "p_size", F.length("p_name").alias("chars"))
    large = fused.join(parts.where("p_size > 25"), "doc_id", "left_semi")
    return retrieval.signal_counts(fused, {"large": large, "even": fused.where("doc_id % 2 = 0")}, parts.select("doc_id", "chars"))


@query("select o_orderkey doc_id, l_linenumber chunk_index, l_partkey part from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus <> 'F' union all select o_orderkey, 0, o_custkey from orders where o_orderstatus = 'F'")
def replaced_chunks(spark, sf):
    """Finished orders get one new chunk in place of their lines."""
    orders = fx.table(spark, sf, "orders")
    old = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("chunk_index"), F.col("l_partkey").alias("part"))
    new = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("chunk_index"), F.col("o_custkey").alias("part"))
    known = old.join(orders.select(F.col("o_orderkey").alias("doc_id")), "doc_id", "left_semi")
    return ledger.replace_children(known, new, "doc_id")


@query("select item_id, len(list_distinct(regexp_extract_all(text || ' see \"Plan B\" and \"Plan B\" or a_' || item_id || '.PDF', '\"([^\"]+)\"', 1))) + 1 terms from benchmark")
def quoted_terms(spark, sf):
    text = F.concat("text", F.lit(' see "Plan B" and "Plan B" or a_'), F.col("item_id").cast("string"), F.lit(".PDF"))
    return fx.table(spark, sf, "benchmark").select("item_id", F.size(review.quoted_terms(text)).alias("terms"))
