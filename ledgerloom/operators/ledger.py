"""Ledger tables: merges, listings, statistics, lookups, exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.durable import dealt


def upsert(old: DataFrame, new: DataFrame, keys: list[str], sequence: str, keep_old: tuple[str, ...] = ()) -> DataFrame:
    """Last writer wins by `sequence` per key; columns in keep_old keep their last value that is not null."""
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    pick = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(sequence))) if c in keep_old else F.max_by(c, sequence)
    return both.groupBy(*keys).agg(*[pick(c).alias(c) for c in rest]).select(both.columns)


def replace_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the touched keys are replaced by the new ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"))


def set_single_theme(links: DataFrame, themed: DataFrame) -> DataFrame:
    """Replace the theme links (doc, node_id, role) of documents that get a new one, so each has exactly one."""
    stale = (F.col("role") == "theme") & F.col("_t").isNotNull()
    marked = links.join(themed.select("doc").distinct().withColumn("_t", F.lit(1)), "doc", "left")
    return marked.where(~F.coalesce(stale, F.lit(False))).drop("_t").unionByName(themed)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def changes(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Files that are new or differ in time or size from the known locations (path, mtime, size)."""
    return listing.join(known.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")


def ingest_decisions(files: DataFrame, ledger: DataFrame, locations: DataFrame | None = None) -> DataFrame:
    """unchanged, new or exact_duplicate per file (path, sha256_hash, mtime).

    A file is unchanged if the known locations (path, mtime, sha256_hash) hold it as it is, a duplicate if its content
    is in the ledger or in an earlier file of the batch. The first file of a content is found by an aggregation, so
    copies are never gathered in one task.
    """
    first = files.groupBy("sha256_hash").agg(F.min(F.struct("mtime", "path")).alias("_first"))
    known = ledger.select("sha256_hash", F.lit(True).alias("_known")).distinct()
    judged = files.join(first.join(known, "sha256_hash", "left"), "sha256_hash")
    decision = F.when(F.col("_known") | (F.struct("mtime", "path") != F.col("_first")), "exact_duplicate").otherwise("new")
    if locations is not None:
        same = locations.select("path", "mtime", "sha256_hash", F.lit(True).alias("_same")).distinct()
        judged = judged.join(same, ["path", "mtime", "sha256_hash"], "left")
        decision = F.when(F.col("_same"), "unchanged").otherwise(decision)
    return judged.withColumn("decision", decision).select(*files.columns, "decision")


#: Names that scanners and cameras give: letters such as scan or img with numbers only, or numbers alone.
RAW_NAME = r"(?i)^(?:scan|scanned|img|image|dsc|doc|document|file|photo|untitled)?[\s_-]*[0-9]*(?:[_-][0-9]+)*\.[a-z0-9]+$"


def upgrade_names(ledger: DataFrame, files: DataFrame, raw: str = RAW_NAME) -> DataFrame:
    """The ledger (sha256_hash, name, ...) where a raw scanner name gives way to the first real name of a copy (sha256_hash, name)."""
    real = files.where(~F.col("name").rlike(raw)).groupBy("sha256_hash").agg(F.min("name").alias("_real"))
    name = F.when(F.col("name").rlike(raw), F.coalesce("_real", "name")).otherwise(F.col("name"))
    return ledger.join(real, "sha256_hash", "left").withColumn("name", name).drop("_real")


def location_of(locations: DataFrame, paths: DataFrame) -> DataFrame:
    """The known location of each asked path (path)."""
    return locations.join(paths.select("path").distinct(), "path", "left_semi")


def best_text(full: Column, snippet: Column, least: int = 30) -> Column:
    """The full text if it has more than `least` characters without the white space around it, else the snippet, else ""."""
    return F.coalesce(F.when(F.length(F.trim(full)) > least, full), snippet, F.lit(""))


def requeue(documents: DataFrame, chunks: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks): the chosen documents (doc_id) are pending again, without an error, and lose their chunks."""
    ids = chosen.select("doc_id").distinct()
    marked = documents.join(ids.withColumn("_again", F.lit(True)), "doc_id", "left")
    again = marked.withColumn("status", F.when(F.col("_again"), "pending").otherwise(F.col("status"))).drop("_again")
    return again, chunks.join(ids, "doc_id", "left_anti")


def recently_processed(documents: DataFrame, n: int) -> DataFrame:
    """The n most recently processed documents (doc_id, processed); ties to the larger id."""
    return documents.where("processed is not null").orderBy(F.desc("processed"), F.desc("doc_id")).limit(n)


def chunks_of(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """The chunks of each asked document (doc_id) with their place in order."""
    own = chunks.join(asked.select("doc_id").distinct(), "doc_id", "left_semi")
    return own.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index")))


def entities_of(links: DataFrame, nodes: DataFrame, asked: DataFrame, parts: int | None = None) -> DataFrame:
    """Entities of each asked document (doc): doc, node_id, node_type, name, role and the link's place by role, then name.

    Without a column role in links, the role is null and the name alone decides. The nodes are hashed, so no links are sorted
    by node; with `parts` the entities are dealt into so many partitions by document, where they are made distinct and placed.
    """
    links = links if "role" in links.columns else links.withColumn("role", F.lit(None).cast("string"))
    own = links.join(asked.select("doc").distinct(), "doc", "left_semi").join(nodes.hint("shuffle_hash"), "node_id")
    order = Window.partitionBy("doc").orderBy(F.asc_nulls_last("role"), "name", "node_id")
    return dealt(own.select("doc", "node_id", "node_type", "name", "role"), parts, "doc").distinct().withColumn("place", F.row_number().over(order))


def queue_stats(queue: DataFrame, chunks: DataFrame) -> DataFrame:
    """Queue entries by status, and one row "chunks" with the number of chunks and of documents that have one."""
    by_status = queue.groupBy("status").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("doc_id").alias("docs"))
    whole = chunks.agg(F.lit("chunks").alias("status"), F.count(F.lit(1)).alias("entries"), F.countDistinct("doc_id").alias("docs"))
    return by_status.unionByName(whole)


def ledger_stats(locations: DataFrame) -> DataFrame:
    """Locations, distinct contents and copies saved per root and over all (root null), of locations (root, sha256_hash)."""
    n, unique = F.count(F.lit(1)), F.countDistinct("sha256_hash")
    return locations.rollup("root").agg(n.alias("locations"), unique.alias("unique_docs"), F.greatest(F.lit(0).cast("long"), n - unique).alias("saved"))


def path_counts(locations: DataFrame, part: str) -> DataFrame:
    """Categories of the locations (path, category, doc_id) whose path holds a text, case ignored: rows and distinct documents."""
    hit = locations.where(F.lower("path").contains(part.lower()))
    return hit.groupBy("category").agg(F.count(F.lit(1)).alias("locations"), F.countDistinct("doc_id").alias("docs"))


def prioritised(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts (node_id, name), each with the number of its part as priority, earlier parts first."""
    numbered = [p.select("node_id", "name", F.lit(i).alias("priority")) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, numbered)


def scan_summary(decisions: DataFrame, statuses: list[str]) -> DataFrame:
    return decisions.groupBy("root").pivot("status", statuses).agg(F.count(F.lit(1))).na.fill(0)


def scan_report(decisions: DataFrame, roots: DataFrame) -> DataFrame:
    """Per root and over all (root null): files scanned, ingested, duplicates, unchanged, errors, and roots that are offline.

    decisions: root and status (new, exact_duplicate, unchanged or error). roots: root, online; one without a file has a row of
    zeros, and the row over all counts those that are offline.
    """
    is_ = lambda s: F.sum((F.col("status") == s).cast("long"))
    names = {"ingested": "new", "duplicates": "exact_duplicate", "unchanged": "unchanged", "errors": "error"}
    own = decisions.groupBy("root").agg(F.count(F.lit(1)).alias("scanned"), *[is_(v).alias(k) for k, v in names.items()])
    both = roots.select("root", (~F.col("online")).cast("long").alias("offline")).join(own, "root", "full").na.fill(0)
    return both.rollup("root").agg(*[F.sum(c).alias(c) for c in ("scanned", *names, "offline")])


def matching(docs: DataFrame, locations: DataFrame, text_filter: str | None = None, only_duplicates: bool = False, statuses: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """Documents that a listing shows, with number of copies and effective date (own, else newest file, else creation).

    Filters: a part of the name in any case, contents with several copies, and any of the given statuses and categories.
    """
    if statuses is not None:
        docs = docs.where(F.col("status").isin(statuses))
    if categories is not None:
        docs = docs.where(F.col("category").isin(categories))
    if text_filter:
        docs = docs.where(F.lower("name").contains(text_filter.lower()))
    copies = locations.groupBy("sha256_hash").agg(F.count(F.lit(1)).alias("copies"), F.max("mtime").alias("newest"))
    page = docs.join(copies, "sha256_hash", "left").withColumn("effective", F.coalesce("doc_date", "newest", "created"))
    return page.where("copies > 1") if only_duplicates else page


def listing(docs: DataFrame, locations: DataFrame, text_filter: str | None, only_duplicates: bool, sort: list[Column], offset: int, limit: int, statuses: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """A page of the ledger: rows offset to offset + limit of matching(), sorted."""
    return matching(docs, locations, text_filter, only_duplicates, statuses, categories).orderBy(*sort).offset(offset).limit(limit)


def with_family(docs: DataFrame, links: DataFrame) -> DataFrame:
    """Each document with its parents and children of the lineage (parent_doc, child_doc), as sorted arrays."""
    side = lambda key, of, out: links.groupBy(F.col(key).alias("doc_id")).agg(F.array_sort(F.collect_set(of)).alias(out))
    both = docs.join(side("child_doc", "parent_doc", "parents"), "doc_id", "left").join(side("parent_doc", "child_doc", "children"), "doc_id", "left")
    none = F.array().cast("array<bigint>")
    return both.withColumns({"parents": F.coalesce("parents", none), "children": F.coalesce("children", none)})


def with_locations(docs: DataFrame, locations: DataFrame) -> DataFrame:
    """Each document with its locations nested, primary first, then newest."""
    order = lambda a, b: F.when(a["is_primary"] != b["is_primary"], F.when(a["is_primary"], -1).otherwise(1)).when(a["mtime"] > b["mtime"], -1).when(a["mtime"] < b["mtime"], 1).when(a["path"] < b["path"], -1).otherwise(1)
    nested = locations.groupBy("sha256_hash").agg(F.array_sort(F.collect_list(F.struct("path", "mtime", "is_primary")), order).alias("locations"))
    return docs.join(nested, "sha256_hash", "left")


def subset_export(anchors: list[DataFrame], tables: dict[str, tuple[DataFrame, str]], edges: DataFrame, limit: int, classes: list[str] = ()) -> dict[str, DataFrame]:
    """Consistent subset: the union of anchor ids (id), each table reduced to them by its key, edges inside them.

    The edges are those of the earliest relation in `classes` first (others after them), then the heaviest, up to limit.
    """
    ids = reduce(DataFrame.union, [a.select("id") for a in anchors]).distinct()
    out = {n: t.join(ids.withColumnRenamed("id", c), c, "left_semi") for n, (t, c) in tables.items()}
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    rank = []  # without classes no column at all: a bare number would be read as a place in the select list
    for i, name in reversed(list(enumerate(classes))):
        rank = [F.when(F.col("relation") == name, F.lit(i)).otherwise(rank[0] if rank else F.lit(len(classes)))]
    return out | {"edges": inside.orderBy(*rank, F.desc("weight"), "src", "dst").limit(limit)}


def dangling(tables: dict[str, tuple[DataFrame, list[str]]], ids: DataFrame) -> DataFrame:
    """(table, rows, dangling): rows of each table, and those with a key (any of its columns) that is no known id."""
    known = ids.select("id").distinct()
    parts = []
    for name, (table, keys) in tables.items():
        open_ = reduce(DataFrame.union, [table.select(F.col(k).alias("id")) for k in keys]).join(known, "id", "left_anti")
        parts.append(table.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")).crossJoin(F.broadcast(open_.agg(F.count(F.lit(1)).alias("dangling")))))  # one row each
    return reduce(DataFrame.unionByName, parts)


def audit_trail(events: DataFrame, order: list[Column], limit: int = 100) -> DataFrame:
    """The latest events of an audit log by `order`; a top-k, so no more than `limit` rows of a task are kept."""
    return events.orderBy(*order).limit(limit)


def folder_topology(paths: DataFrame, depth: int = 2) -> DataFrame:
    """(folder, docs): documents below each folder of `depth` levels, of paths with or without a scheme, query and mark."""
    plain = F.regexp_replace(F.regexp_replace("path", "^[a-z]+://", ""), "[?#].*$", "")
    return paths.groupBy(F.array_join(F.slice(F.split(plain, "/"), 1, depth), "/").alias("folder")).agg(F.count(F.lit(1)).alias("docs"))


def status_counts(docs: DataFrame) -> DataFrame:
    """Documents by status, and of all (status null)."""
    return docs.rollup("status").agg(F.count(F.lit(1)).alias("docs"))


def root_counts(locations: DataFrame) -> DataFrame:
    """Locations and distinct contents of each storage root (root, sha256_hash)."""
    return locations.groupBy("root").agg(F.count(F.lit(1)).alias("locations"), F.countDistinct("sha256_hash").alias("contents"))


def top_entities(links: DataFrame, nodes: DataFrame, node_type: str, limit: int) -> DataFrame:
    """The nodes of a type in most documents: node_id, name, docs."""
    docs = links.groupBy("node_id").agg(F.countDistinct("doc").alias("docs"))
    return nodes.where(F.col("node_type") == node_type).join(docs, "node_id").select("node_id", "name", "docs").orderBy(F.desc("docs"), "node_id").limit(limit)
