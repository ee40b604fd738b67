"""Registered queries of ledger pages, scan reports and the closure of exported subsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import ledger
from ledgerloom.plans import fixtures as fx
from ledgerloom.plans.registered import query


def _ledger(spark, sf):
    """Documents as a ledger: one row per content, dated by its smallest doc_id if that is even, and all files."""
    d = fx.documents(spark, sf).where("text is not null").withColumnRenamed("filename", "name").withColumn("sha256_hash", F.sha2("text", 256)).withColumn("mtime", F.timestamp_seconds(F.col("doc_id") * 100))
    first = ledger.latest(d, ["sha256_hash"], [F.asc("doc_id")])
    dated = F.when(F.col("doc_id") % 2 == 0, F.timestamp_seconds(F.col("doc_id") + 5))
    docs = first.select("sha256_hash", "doc_id", "name", F.col("lang").alias("category"), F.when(F.col("n_chars") > 400, "processed").otherwise("pending").alias("status"), dated.alias("doc_date"), F.lit(None).cast("timestamp").alias("created"))
    return docs, d.select("sha256_hash", "mtime")


_PAGE = f"""n as (select sha256(text) h, doc_id, lang, n_chars, {fx.FILE_NAME} name from documents where text is not null), c as (select h, count(*) copies, max(doc_id) newest from n group by all),
d as (select *, row_number() over (partition by h order by doc_id) r from n), m as (select name, doc_id, copies, case when doc_id % 2 = 0 then doc_id + 5 else newest * 100 end::bigint effective from d join c using (h) where r = 1 and lang in ('en', 'fr') and n_chars > 400 and contains(lower(name), 'src'))"""


@query(f"with {_PAGE} select name, doc_id, copies, effective from m order by effective desc, doc_id limit 40 offset 10")
def ledger_page(spark, sf):
    docs, files = _ledger(spark, sf)
    page = ledger.listing(docs, files, "SRC", False, [F.desc("effective"), F.col("doc_id")], 10, 40, ["processed"], ["en", "fr"])
    return page.select("name", "doc_id", "copies", F.unix_timestamp("effective").alias("effective"))


@query(f"with {_PAGE} select count(*) total, sum((copies > 1)::int)::bigint duplicated from m")
def ledger_total(spark, sf):
    """How many documents the filters of ledger_page leave."""
    docs, files = _ledger(spark, sf)
    return ledger.matching(docs, files, "SRC", False, ["processed"], ["en", "fr"]).agg(F.count(F.lit(1)).alias("total"), F.sum((F.col("copies") > 1).cast("long")).alias("duplicated"))


@query(
    "with f as (select doc_id, source root, lang, sha256(text) h, row_number() over (partition by sha256(text) order by doc_id) r from documents), k as (select distinct h from f where lang = 'de' and h is not null), "
    "s as (select root, case when h is null then 'error' when lang = 'de' then 'unchanged' when h in (from k) or r > 1 then 'exact_duplicate' else 'new' end status from f) "
    "select root, count(*) scanned, sum((status = 'new')::int)::bigint ingested, sum((status = 'exact_duplicate')::int)::bigint duplicates, sum((status = 'unchanged')::int)::bigint \"unchanged\", sum((status = 'error')::int)::bigint errors, "
    "case when grouping(root) = 1 then 1 else 0 end::bigint offline from s group by rollup(root) union all select 'tape', 0, 0, 0, 0, 0, 1"
)
def scan_totals(spark, sf):
    """A second scan: German files are known as they are, files without a text cannot be read, and one root is offline."""
    d = fx.table(spark, sf, "documents").select(F.col("source").alias("root"), "lang", F.sha2("text", 256).alias("sha256_hash"), F.col("doc_id").alias("mtime"), F.col("doc_id").cast("string").alias("path"))
    known = d.where("lang = 'de' and sha256_hash is not null")
    judged = ledger.ingest_decisions(d.where("sha256_hash is not null"), known, known).select("root", F.col("decision").alias("status"))
    failed = d.where("sha256_hash is null").select("root", F.lit("error").alias("status"))
    roots = d.select("root", F.lit(True).alias("online")).distinct().union(spark.createDataFrame([("tape", False)], "root string, online boolean"))
    return ledger.scan_report(judged.unionByName(failed), roots)


_SUBSET = f"{fx.EDGES_SQL}, ids as (select 'p' || p_partkey id from part where p_size > 45 union select 's' || s_suppkey from supplier where s_acctbal > 0), e as (select src, dst, case when weight > 1 then 'often' else 'once' end relation, weight from edges where src in (from ids) and dst in (from ids)), x as (select * from e order by relation <> 'once', weight desc, src, dst limit 2000)"


def _subset(spark, sf):
    ids = [fx.table(spark, sf, "part").where("p_size > 45").select(F.concat(F.lit("p"), "p_partkey").alias("id")), fx.table(spark, sf, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))]
    edges = fx.edges(spark, sf).withColumn("relation", F.when(F.col("weight") > 1, "often").otherwise("once"))
    out = ledger.subset_export(ids, {"nodes": (fx.nodes(spark, sf), "node_id"), "links": (fx.links(spark, sf), "node_id")}, edges, 2000, ["once", "often"])
    return out, ids[0].union(ids[1])


@query(f"with {_SUBSET} select src, dst, relation, weight from x")
def subset_by_class(spark, sf):
    """Single deliveries first, then frequent ones, each the heaviest first."""
    return _subset(spark, sf)[0]["edges"].select("src", "dst", "relation", "weight")


@query(f"with {_SUBSET}, {fx.LINKS_SQL} select 'nodes' \"table\", count(*) \"rows\", 0::bigint dangling from ids union all select 'links', count(*), 0 from links where node_id in (from ids) union all select 'edges', count(*), 0 from x")
def subset_closure(spark, sf):
    out, ids = _subset(spark, sf)
    return ledger.dangling({"nodes": (out["nodes"], ["node_id"]), "links": (out["links"], ["node_id"]), "edges": (out["edges"], ["src", "dst"])}, ids)
