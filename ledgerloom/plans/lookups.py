"""Registered queries of lookups, statistics, classification by phrases and precedence, and obligations from text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import features as X
from ledgerloom.operators import actions as A
from ledgerloom.operators import dedup, ledger, taxonomy
from ledgerloom.plans import catalogue as C
from ledgerloom.plans import fixtures as fx
from ledgerloom.plans.registered import query, values


@query("select page_id, url path from pages where url in (select url from pages where page_id in (select doc_id from labels where toxic = 1))")
def location_by_path(spark, sf):
    pages = fx.table(spark, sf, "pages").select("page_id", F.col("url").alias("path"))
    asked = pages.join(fx.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id")), "page_id", "left_semi")
    return ledger.location_of(pages, asked).select("page_id", "path")


@query("select doc_id, md5(case when length(trim(text)) > 30 then text else coalesce(source, '') end) text_md5 from documents")
def best_texts(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", F.md5(ledger.best_text(F.col("text"), F.col("source"))).alias("text_md5"))


_RECENT = "recent as (select o_orderkey k from orders order by o_orderdate desc, o_orderkey desc limit 500)"


def _requeued(spark, sf):
    docs = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("processed"))
    chunks = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_index"))
    return ledger.requeue(docs, chunks, ledger.recently_processed(docs, 500))


@query(f"with {_RECENT} select o_orderkey doc_id, case when o_orderkey in (from recent) then 'pending' else o_orderstatus end status from orders")
def requeued_documents(spark, sf):
    return _requeued(spark, sf)[0].select("doc_id", "status")


@query(f"with {_RECENT} select l_orderkey doc_id, l_linenumber chunk_index from lineitem where l_orderkey not in (from recent)")
def chunks_after_requeue(spark, sf):
    return _requeued(spark, sf)[1]


@query("select conv_id doc_id, turn chunk_index, row_number() over (partition by conv_id order by turn)::int place from conversations where conv_id in (select doc_id from labels where quality = 1)")
def document_chunks(spark, sf):
    chunks = fx.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"))
    return ledger.chunks_of(chunks, fx.table(spark, sf, "labels").where("quality = 1")).select("doc_id", "chunk_index", "place")


@query(f"with {fx.LINKS_SQL}, n as (select 'p' || p_partkey node_id, 'part' node_type, p_name as \"name\" from part union all select 's' || s_suppkey, 'supplier', s_name from supplier), r as (select doc, node_id, node_type, \"name\", case node_type when 'part' then 'item' else 'by' end \"role\" from links join n using (node_id) where doc in (select o_orderkey from orders where o_orderpriority = '1-URGENT')) select *, row_number() over (partition by doc order by \"role\", \"name\", node_id)::int place from r")
def document_entities(spark, sf):
    asked = fx.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("doc"))
    links = fx.links(spark, sf).withColumn("role", F.when(F.col("node_id").startswith("p"), "item").otherwise("by"))
    return ledger.entities_of(links, fx.nodes(spark, sf), asked, fx.link_parts(spark, sf))


@query("select o_orderstatus status, count(*) entries, count(distinct o_custkey) docs from orders group by all union all select 'chunks', count(*), count(distinct l_orderkey) from lineitem")
def queue_stats(spark, sf):
    queue = fx.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("doc_id"))
    return ledger.queue_stats(queue, fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id")))


@query("with c as (select n_name category, r_name parent from nation join region on n_regionkey = r_regionkey union all select r_name, null from region), d as (select n_name category, count(*) docs from customer join nation on c_nationkey = n_nationkey group by all) select category, parent, coalesce(docs, 0) docs, parent is null is_root from c left join d using (category)")
def category_counts(spark, sf):
    n, r, c = (fx.table(spark, sf, t) for t in ("nation", "region", "customer"))
    categories = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("category"), F.col("r_name").alias("parent")).unionByName(r.select(F.col("r_name").alias("category"), F.lit(None).cast("string").alias("parent")))
    return taxonomy.category_counts(categories, c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("n_name").alias("category")))


@query("with t as (select lower(p_name) t, lower(string_split(p_name, ' ')[-1]) leaf from part) select case when leaf in ('ring', 'bolt') then leaf when leaf = 'rod' then 'ring' when contains(t, 'gear') then 'moving' else 'unclassified' end theme, count(*) docs from t group by all")
def theme_distribution(spark, sf):
    """Parts by the last word of their names: rings and bolts are roots, rods lie below rings, and the word gear is a cue."""
    docs = fx.table(spark, sf, "part").select(F.lower("p_name").alias("doc_type"))
    leaf = F.element_at(F.split("doc_type", " "), -1)
    parents = docs.distinct().select(F.col("doc_type").alias("category"), leaf.alias("parent")).where("category <> parent").unionByName(spark.createDataFrame([("rod", "ring"), ("anvil", "widget"), ("widget", "anvil")], "category string, parent string"))
    themes = taxonomy.theme_of(docs, parents, spark.createDataFrame([("no such", "ring")], "alias string, category string"), ["ring", "bolt"], [("gear", "moving")])
    return taxonomy.theme_counts(docs.join(themes, "doc_type"))


@query("select regexp_extract(url, '\\.([a-z]+)/', 1) category, count(*) locations, count(distinct page_id) docs from pages where contains(lower(url), '/e') group by all")
def path_counts(spark, sf):
    pages = fx.table(spark, sf, "pages").select(F.col("url").alias("path"), F.regexp_extract("url", r"\.([a-z]+)/", 1).alias("category"), F.col("page_id").alias("doc_id"))
    return ledger.path_counts(pages, "/E")


@query(f"with {C._LINKS} select parent_doc, child_doc, relationship from links order by child_doc desc, parent_doc desc limit 50")
def recent_chains(spark, sf):
    return dedup.recent_links(C.version_chains(spark, sf), [F.desc("child_doc"), F.desc("parent_doc")], 50).select("parent_doc", "child_doc", "relationship")


@query("select 'r' || r_regionkey node_id, r_name as \"name\", 0 priority from region union all select 'c' || c_custkey, c_name, 1 from customer union all select 's' || s_suppkey, s_name, 2 from supplier")
def node_universe(spark, sf):
    named = lambda t, letter, key, name: fx.table(spark, sf, t).select(F.concat(F.lit(letter), key).alias("node_id"), F.col(name).alias("name"))
    return ledger.prioritised([named("region", "r", "r_regionkey", "r_name"), named("customer", "c", "c_custkey", "c_name"), named("supplier", "s", "s_suppkey", "s_name")])


_RAW = ledger.RAW_NAME.replace("'", "''")


@query(f"with n as (select doc_id, sha256(text) h, case when doc_id % 3 = 0 then 'scan_' || doc_id || '.pdf' else {fx.FILE_NAME} end fn from documents), l as (select h, min_by(fn, doc_id) fn from n where h is not null group by h), r as (select h, min(fn) own from n where not regexp_matches(fn, '{_RAW}') group by h) select h sha256_hash, case when regexp_matches(fn, '{_RAW}') then coalesce(own, fn) else fn end as \"name\" from l left join r using (h)")
def upgraded_names(spark, sf):
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("scan_"), "doc_id", F.lit(".pdf"))).otherwise(F.col("filename"))
    files = fx.documents(spark, sf).select("doc_id", F.sha2("text", 256).alias("sha256_hash"), name.alias("name")).where("sha256_hash is not null")
    first = files.groupBy("sha256_hash").agg(F.min_by("name", "doc_id").alias("name"))
    return ledger.upgrade_names(first, files)


PHRASES = [("pair_en", "in the", False), ("pair_en", "of the", False), ("pair_de", "und der", False), ("pair_es", "que para", True), ("word_fr", "avec", False), ("pair_en", "the", True)]


@query(f"with k(category, keyword, is_child) as (values {values(PHRASES)}), d as (select doc_id, ' ' || array_to_string({C._WORDS}, ' ') || ' ' run from documents) select doc_id, category, count(*) hits from d join k on contains(run, ' ' || keyword || ' ') group by doc_id, category, is_child")
def phrase_hits(spark, sf):
    kw = spark.createDataFrame(PHRASES, "category string, keyword string, is_child boolean")
    return taxonomy.keyword_hits(fx.table(spark, sf, "documents"), kw).select("doc_id", "category", "hits")


def _precedence_sql() -> str:
    quoted = lambda x: x.replace("'", "''")
    cases = " ".join(f"when regexp_matches(fn, '(^|[^\\p{{L}}\\p{{N}}])({'|'.join(n)})([^\\p{{L}}\\p{{N}}]|$)') or {' + '.join(f'contains(low, {chr(39)}{quoted(x)}{chr(39)})::int' for x in p)} >= 2 then '{c}'" for c, n, p in RULES)
    return f"select doc_id, case {cases} end category from (select doc_id, lower({fx.FILE_NAME}) fn, coalesce(lower(text), '') low from documents)"


RULES = [*taxonomy.PRECEDENCE, ("noted", ("note", "draft"), ("and the", "que les")), ("english", ("none such",), (" and ", " the ", " was "))]


@query(_precedence_sql())
def precedence_classes(spark, sf):
    return fx.documents(spark, sf).select("doc_id", taxonomy.precedence(F.col("filename"), F.col("text"), RULES).alias("category"))


_LETTERS = """letters as (select o_orderkey doc_id, case o_orderkey % 5 when 0 then 'Invoice of EUR ' || printf('%.2f', o_totalprice) when 1 then 'Rechnung, zahlbar bis ' || strftime(o_orderdate, '%Y-%m-%d') when 2 then 'Please sign, due date: ' || strftime(o_orderdate, '%d.%m.%Y') when 3 then 'an invoice only' else 'nothing due' end t from orders)"""


@query(f"with {_LETTERS}, r as (select doc_id, lower(t) low, nullif(regexp_extract(t, 'EUR ([0-9.]+)', 1), '')::decimal(18,2) amount, coalesce(try_strptime(regexp_extract(t, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), '%Y-%m-%d'), try_strptime(regexp_extract(t, '([0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{4}})', 1), '%d.%m.%Y'))::date due from letters) select doc_id, case when contains(low, 'sign') then 'signature' else 'payment' end action_type, amount::double amount, due::varchar due from r where contains(low, 'sign') or ((contains(low, 'invoice') or contains(low, 'rechnung')) and (amount is not null or due is not null))")
def text_obligations(spark, sf):
    """Orders written out as letters, one of five kinds each."""
    o, kind = fx.table(spark, sf, "orders"), F.col("o_orderkey") % 5
    letter = F.when(kind == 0, F.concat(F.lit("Invoice of EUR "), F.format_string("%.2f", F.col("o_totalprice").cast("double")))).when(kind == 1, F.concat(F.lit("Rechnung, zahlbar bis "), F.date_format("o_orderdate", "yyyy-MM-dd")))
    letter = letter.when(kind == 2, F.concat(F.lit("Please sign, due date: "), F.date_format("o_orderdate", "dd.MM.yyyy"))).when(kind == 3, F.lit("an invoice only")).otherwise("nothing due")
    return A.obligations(o.select(F.col("o_orderkey").alias("doc_id"), letter.alias("text"))).select("doc_id", "action_type", F.col("amount").cast("double").alias("amount"), F.col("due").cast("string").alias("due"))


_PAPERS = """papers as (select l_orderkey * 10 + l_linenumber doc_id, l_orderkey o, l_linenumber n, floor(l_extendedprice)::bigint price, l_suppkey s from lineitem)"""


@query(f"with {_PAPERS}, k as (select doc_id action_id, doc_id source_doc, case n when 1 then 'payment' when 2 then 'signature' else 'reply' end rule, case n when 1 then '#' || price else 'supplier' || s || 'x' || price % 50 end key from papers where n <= 3), d as (select doc_id, '#' || price key, 'payment' rule from papers where n % 3 = 1 union all select doc_id, 'supplier' || s || 'x' || price % 50, 'signature' from papers where n % 3 = 2 union all select doc_id, 'supplier' || s || 'x' || price % 50, 'reply' from papers where n % 3 = 0) select distinct action_id, doc_id, rule from k join d using (key, rule) where doc_id <> source_doc")
def fulfilment_rules(spark, sf):
    """Lines as papers that pay a price, sign or answer; the first three of an order are obligations."""
    papers = fx.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), F.col("l_linenumber").alias("n"), F.floor("l_extendedprice").cast("long").alias("price"), F.concat(F.lit("supplier"), "l_suppkey", F.lit("x"), F.floor("l_extendedprice").cast("long") % 50).alias("party"))
    kind = F.when(F.col("n") == 1, "payment").when(F.col("n") == 2, "signature").otherwise("reply")
    asked = papers.where("n <= 3").select(F.col("doc_id").alias("action_id"), F.col("doc_id").alias("source_doc"), kind.alias("action_type"), "party", F.col("price").alias("amount"))
    part = F.col("n") % 3
    text = F.when(part == 1, F.concat(F.lit("paid "), "price")).when(part == 2, F.concat(F.lit("signed for "), "party")).otherwise(F.concat(F.lit("answer, re: "), "party"))
    return A.fulfilment_candidates(asked, papers.select("doc_id", text.alias("text")))


@query("with c as (select c_custkey, c_name as \"name\" from customer) select c_custkey, length(\"name\") between 3 and 60 and regexp_matches(\"name\", '\\p{Lu}') and not regexp_matches(\"name\", '[!?;:|<>{}]|\\.\\s') shown from c")
def entity_names(spark, sf):
    return fx.table(spark, sf, "customer").select("c_custkey", X.is_entity_name(F.col("c_name")).alias("shown"))


@query("with l as (select l_orderkey parent, l_partkey child from lineitem) select o_orderkey doc_id, len(list_distinct(list(child)))::int children from orders join l on parent = o_orderkey group by all")
def document_families(spark, sf):
    links = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("long").alias("parent_doc"), (F.lit(-1) - F.col("l_partkey")).cast("long").alias("child_doc"))
    docs = fx.table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("doc_id"))
    return ledger.with_family(docs, links).select("doc_id", F.size("children").alias("children")).where("children > 0")
