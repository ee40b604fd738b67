"""Property graph as tables: nodes(node_id, node_type, name), edges(src, dst, relation, weight), links(doc, node_id, role, confidence)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.durable import Workspace, dealt, few, parts_for


def degrees(edges: DataFrame) -> DataFrame:
    """In plus out degree: endpoints are unioned, so no disjunctive join is needed."""
    ends = edges.select(F.col("src").alias("node_id")).unionAll(edges.select(F.col("dst").alias("node_id")))
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def node_stats(nodes: DataFrame, edges: DataFrame, links: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """nodes with degree and distinct documents; 0 where there is none. With dates (doc, doc_date) also the latest one."""
    counted = [F.countDistinct("doc").alias("docs")]
    if dates is not None:
        links = links.join(dates.groupBy("doc").agg(F.max("doc_date").alias("doc_date")), "doc", "left")
        counted.append(F.max("doc_date").alias("latest"))
    docs = links.groupBy("node_id").agg(*counted)
    return nodes.join(degrees(edges), "node_id", "left").join(docs, "node_id", "left").na.fill(0, ["degree", "docs"])


def cooccurrence(left: DataFrame, right: DataFrame, key: str, relation: str) -> DataFrame:
    """Edges between entities of two types that share a document, with the number of shared documents as weight.

    Both sides are dealt by document, the pairs by their ends, into as many partitions as their rows ask for. The number of
    pairs is reckoned from the documents' average size, without making them.
    """
    spark, rows = left.sparkSession, (left.count(), right.count())
    docs = left.agg(F.approx_count_distinct(key).alias("n")).first()["n"]
    by_doc, by_pair = parts_for(spark, sum(rows)), parts_for(spark, rows[0] * rows[1] // max(1, docs))
    pairs = dealt(left, by_doc, key).distinct().join(dealt(right, by_doc, key).distinct(), key).select("src", "dst")
    return dealt(pairs, by_pair, "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")).withColumn("relation", F.lit(relation))


def shared_neighbours(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes that share documents with seed nodes (node_id), themselves no seeds: seed, node_id, shared."""
    own = links.join(seeds, "node_id", "left_semi").select(F.col("node_id").alias("seed"), "doc").distinct()
    others = links.join(seeds, "node_id", "left_anti").select("node_id", "doc").distinct()
    return own.join(others, "doc").groupBy("seed", "node_id").agg(F.count(F.lit(1)).alias("shared"))


def bridging_documents(links: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Documents linked to a node of each set."""
    return links.join(a, "node_id", "left_semi").select("doc").distinct().join(links.join(b, "node_id", "left_semi").select("doc").distinct(), "doc")


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """Nodes within `hops` edges of each seed (seed, node_id, hop = the smallest), both directions, seeds left out.

    Each hop's front is written, and a small one broadcast, so that the edges are read where they lie; equal edges fold with
    the front that they reach, never as a whole.
    """
    both = edges.select(F.col("src").alias("x"), F.col("dst").alias("y")).unionAll(edges.select(F.col("dst").alias("x"), F.col("src").alias("y")))
    with Workspace(edges.sparkSession, "neighbourhood") as work:
        front = work.keep(seeds.select(F.col("node_id").alias("seed"), F.col("node_id")))
        found = []
        for hop in range(1, hops + 1):
            near = F.broadcast(front) if few(front) else front
            front = work.keep(both.join(near, F.col("node_id") == F.col("x")).select("seed", F.col("y").alias("node_id")).distinct())
            found.append(front.withColumn("hop", F.lit(hop)))
        return work.result(reduce(DataFrame.unionByName, found).where("seed <> node_id").groupBy("seed", "node_id").agg(F.min("hop").alias("hop")))


def induced_subgraph(edges: DataFrame, kept: DataFrame, limit: int | None = 3000) -> DataFrame:
    """Edges inside a node set, heaviest first up to a limit."""
    inside = edges.join(kept.select(F.col("node_id").alias("src")), "src", "left_semi").join(kept.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    return inside.orderBy(F.desc("weight"), "src", "dst").limit(limit) if limit else inside


def stratified_nodes(stats: DataFrame, quota: int) -> DataFrame:
    """The best nodes of each type by 2 degree + 5 docs, at most `quota` a type."""
    score = F.col("degree") * 2 + F.col("docs") * 5
    order = Window.partitionBy("node_type").orderBy(F.desc("score"), "node_id")
    return stats.withColumn("score", score).withColumn("r", F.row_number().over(order)).where(F.col("r") <= quota)


def sampled_nodes(stats: DataFrame, quota: int, limit: int) -> DataFrame:
    """The best `limit` of the nodes within their type's quota by 2 degree + 3 docs + 10 a year of the latest date since 2005.

    stats has the column `latest`; without a date a node counts as of 2005. Ties go to the smaller node_id.
    """
    years = F.coalesce(F.year("latest"), F.lit(2005)) - 2005
    kept = stratified_nodes(stats, quota).withColumn("overall", F.col("degree") * 2 + F.col("docs") * 3 + years * 10)
    return kept.orderBy(F.desc("overall"), "node_id").limit(limit).drop("r")


def stratified_documents(docs: DataFrame, per_theme: int) -> DataFrame:
    """One document per (theme, name), pending ones first, and at most per_theme of them a theme."""
    first = Window.partitionBy("theme", "name").orderBy(F.desc("pending"), "doc_id")
    of_theme = Window.partitionBy("theme").orderBy(F.desc("pending"), "doc_id")
    return docs.withColumn("r", F.row_number().over(first)).where("r = 1").withColumn("r", F.row_number().over(of_theme)).where(F.col("r") <= per_theme)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge."""
    return nodes.join(degrees(edges).select("node_id"), "node_id", "left_anti")


def low_degree_candidates(stats: DataFrame, degree: int = 1, docs: int = 2) -> DataFrame:
    return stats.where((F.col("degree") <= degree) & (F.col("docs") <= docs))


def consolidate(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with alias nodes replaced by canonical ones (alias, canonical); self-loops go, equal edges merge."""
    moved = edges
    for end in ("src", "dst"):
        m = mapping.select(F.col("alias").alias(end), F.col("canonical").alias(f"_{end}"))
        moved = moved.join(m, end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    return moved.where("src <> dst").groupBy("src", "dst", "relation").agg(F.max("weight").alias("weight"))


def consolidate_links(links: DataFrame, mapping: DataFrame, parts: int | None = None) -> DataFrame:
    """Links (doc, node_id) with alias nodes replaced by canonical ones (alias, canonical), each once.

    The mapping is hashed, so no links are sorted; with `parts` they are dealt into so many partitions by document.
    """
    moved = links.select("doc", "node_id").join(mapping.select(F.col("alias").alias("node_id"), "canonical").hint("shuffle_hash"), "node_id", "left")
    return dealt(moved.select("doc", F.coalesce("canonical", "node_id").alias("node_id")), parts, "doc").distinct()


def first_edges(edges: DataFrame, order: str) -> DataFrame:
    """One edge per (src, dst, relation), the first by `order`; of equal places the one of the smallest weight."""
    return edges.groupBy("src", "dst", "relation").agg(F.min_by("weight", F.struct(order, "weight")).alias("weight"))


def mirror_by_slug_or_property(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (doc, key) to nodes by node_id or by a property: two equi-joins and a union instead of an OR."""
    by_id = links.join(nodes.select("node_id", F.col("node_id").alias("key")), "key").select("doc", "node_id")
    by_property = links.join(nodes.select("node_id", F.get_json_object("properties", "$.geo_id").alias("key")), "key").select("doc", "node_id")
    return by_id.union(by_property).distinct()


def noisy_name(name: Column) -> Column:
    """Whether a name has a line break, under 2 or over 60 characters."""
    return name.rlike(r"[\n\r]") | ~F.length(name).between(2, 60)


def prune(nodes: DataFrame, edges: DataFrame, links: DataFrame, bad: Column, places: DataFrame, contracts: list[str], blacklist: dict[str, str], dry_run: bool = False, parties=("party", "organization", "person")):
    """Deterministic pruning of a graph by four rules, judged on each node in this order.

    Contract types that name no contract become document categories; parties named like a place (name) become locations;
    nodes that are `bad` and without an edge go, with their links; what remains of a type with a blacklist and matches it
    goes with its edges and links. contracts: parts of the names of true contract types; blacklist: per node type a pattern
    of names that are none. Returns (nodes, edges, links), or with dry_run one row of counts.
    """
    low = F.lower(F.trim("name"))
    named = places.select(F.lower(F.trim("name")).alias("_place")).distinct()
    alone = orphans(nodes, edges).select("node_id", F.lit(True).alias("_alone"))
    is_contract = F.exists(F.array(*[F.lit(c) for c in contracts]), lambda c: F.replace(low, F.lit(" "), F.lit("_")).contains(c))
    judged = nodes.join(named, low == F.col("_place"), "left").join(alone, "node_id", "left")
    judged = judged.withColumn("_retyped", F.col("node_type").isin(*parties) & F.col("_place").isNotNull()).withColumn("_recategorised", (F.col("node_type") == "contract_type") & ~F.coalesce(is_contract, F.lit(False)))
    judged = judged.withColumn("node_type", F.when(F.col("_retyped"), "location").when(F.col("_recategorised"), "document_category").otherwise(F.col("node_type")))
    judged = judged.withColumn("_noise", F.col("_alone").isNotNull() & F.coalesce(bad, F.lit(False)))
    listed = reduce(lambda a, b: a | b, [(F.col("node_type") == t) & low.rlike(p) for t, p in blacklist.items()], F.lit(False))
    judged = judged.withColumn("_listed", ~F.col("_noise") & F.coalesce(listed, F.lit(False)))
    if dry_run:
        count = lambda flag: F.coalesce(F.sum(F.col(flag).cast("long")), F.lit(0))
        return judged.select(count("_recategorised").alias("recategorised"), count("_retyped").alias("retyped"), count("_noise").alias("dropped"), count("_listed").alias("blacklisted"))
    gone = judged.where("_noise or _listed").select("node_id")
    left = edges
    for end in ("src", "dst"):
        left = left.join(gone.select(F.col("node_id").alias(end)), end, "left_anti")
    return judged.where("not _noise and not _listed").select(nodes.columns), left.select(edges.columns), links.join(gone, "node_id", "left_anti")


def descendants(table: DataFrame, root: str) -> DataFrame:
    """A region and all below it from (geo_id, parent_id): geo_id, level (the smallest).

    Level by level; a node met before is left out, so cycles end and no depth is too great. Each level is written once, and
    only whether it is empty reaches the driver.
    """
    below = table.select("geo_id", "parent_id").where("parent_id is not null").distinct()
    with Workspace(table.sparkSession, "descendants") as work:
        front = work.keep(table.where(F.col("geo_id") == F.lit(root)).select("geo_id").distinct().withColumn("level", F.lit(0)))
        found, level = front, 0
        while not front.isEmpty():
            level += 1
            met = front.select(F.col("geo_id").alias("parent_id")).join(below, "parent_id").select("geo_id").distinct()
            front = work.keep(met.join(found.select("geo_id"), "geo_id", "left_anti").withColumn("level", F.lit(level)))
            found = found.unionByName(front)
        return work.result(found)


def range_topics(articles: DataFrame, ranges: DataFrame, overrides: DataFrame, bin_size: int = 64) -> DataFrame:
    """Topic of each numbered article: an exact override, else the first range (lo, hi, topic, seq) that holds it.

    A range is listed under each bin of numbers that it touches, so articles and ranges meet by equality.
    """
    binned = ranges.select("*", F.explode(F.sequence(F.floor(F.col("lo") / bin_size), F.floor(F.col("hi") / bin_size))).alias("_bin"))
    own = articles.withColumn("_bin", F.floor(F.col("number") / bin_size))
    hit = own.join(binned, "_bin", "left").withColumn("_in", F.col("number").between(F.col("lo"), F.col("hi")))
    first = hit.groupBy("article_id", "number").agg(F.min_by("topic", F.when(F.col("_in"), F.col("seq"))).alias("ranged"))
    return first.join(overrides.select("number", F.col("topic").alias("own")), "number", "left").select("article_id", "number", F.coalesce("own", "ranged").alias("topic"))


def graph_stats(stats: DataFrame) -> DataFrame:
    """Nodes, degree and the most documents of a node, by type, of node_stats's result."""
    return stats.groupBy("node_type").agg(F.count(F.lit(1)).alias("nodes"), F.sum("degree").alias("degree"), F.max("docs").alias("most_docs"))


def relation_counts(edges: DataFrame) -> DataFrame:
    """Edges and their weight by relation."""
    return edges.groupBy("relation").agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight"))


def mirror_document_edges(edges: DataFrame, nodes: DataFrame, docs: DataFrame, prefix: str = "doc_") -> DataFrame:
    """Edges that start at a document (prefix + its id) as links (doc, node_id), where both ends exist."""
    own = edges.where(F.col("src").startswith(prefix)).select(F.expr(f"substring(src, {len(prefix) + 1})").alias("doc"), F.col("dst").alias("node_id"))
    return own.join(nodes.select("node_id"), "node_id", "left_semi").join(docs.select(F.col("doc").cast("string").alias("doc")), "doc", "left_semi").distinct()


#: The relation of two nodes of which one has a type, the first that fits.
BRIDGES = (("location", "LOCATED_IN"), ("statute", "SUBJECT_TO"), ("currency", "DENOMINATED_IN"), ("financial_pillar", "INVOLVES_PAYMENT"))


def bridge_isolated(nodes: DataFrame, edges: DataFrame, links: DataFrame, bridges=BRIDGES, other: str = "CO_OCCURS", best_only: bool = True) -> DataFrame:
    """Edges from each node without one to the linked node that shares most documents with it (ties to the smaller id), or
    to all that share one if best_only is False.

    The relation follows from the two types by `bridges`, else it is `other`; the weight is the number of shared documents.
    """
    alone = orphans(nodes, edges).select("node_id")
    near = shared_neighbours(links, alone)
    best = near.groupBy("seed").agg(F.min_by("node_id", F.struct(-F.col("shared"), "node_id")).alias("dst"), F.max("shared").alias("weight"))
    typed = (best if best_only else near.select("seed", F.col("node_id").alias("dst"), F.col("shared").alias("weight"))).withColumnRenamed("seed", "src")
    for end in ("src", "dst"):
        typed = typed.join(nodes.select(F.col("node_id").alias(end), F.col("node_type").alias(f"_{end}")), end, "left")
    relation = F.lit(other)
    for node_type, name in reversed(bridges):
        relation = F.when((F.col("_src") == node_type) | (F.col("_dst") == node_type), name).otherwise(relation)
    return typed.select("src", "dst", relation.alias("relation"), "weight")


def representativity(total: DataFrame, rendered: DataFrame, key: str) -> DataFrame:
    """Rows, rendered rows, percentage and whether a cap applied, per cluster."""
    a = total.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    b = rendered.groupBy(key).agg(F.count(F.lit(1)).alias("rendered"))
    both = a.join(b, key, "left").na.fill(0, ["rendered"])
    return both.withColumn("pct", F.round(100 * F.col("rendered") / F.col("total"), 1)).withColumn("capped", F.col("rendered") < F.col("total"))


def part_of_edges(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(child, parent, relation): an edge from each administrative unit (name, parent_id) to the one it lies in (id, name)."""
    above = parents.select(F.col("id").alias("_id"), F.col("name").alias("parent"))
    return children.join(above, F.col("parent_id") == F.col("_id")).select(F.col("name").alias("child"), "parent", F.lit("part_of").alias("relation"))


def neighbourhood_or_shared(edges: DataFrame, links: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(seed, node_id, hop, shared): neighbourhood() of each seed (node_id), shared null; a seed without an edge has the nodes
    that share documents (links: doc, node_id) with it instead, hop null and the number of documents in shared."""
    near = neighbourhood(edges, seeds, hops).withColumn("shared", F.lit(None).cast("long"))
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select(F.col("dst").alias("node_id"))).distinct()
    alone = seeds.select("node_id").distinct().join(ends, "node_id", "left_anti")
    own = links.join(alone, "node_id", "left_semi").select(F.col("node_id").alias("seed"), "doc").distinct()
    met = own.join(links.select("node_id", "doc").distinct(), "doc").where("seed <> node_id").groupBy("seed", "node_id").agg(F.count(F.lit(1)).alias("shared"))
    return near.unionByName(met.withColumn("hop", F.lit(None).cast("int")))


def verified_nodes(stats: DataFrame, node_type: str | None = None) -> DataFrame:
    """Nodes of node_stats's result, of a type if given, that a document or an edge bears out."""
    own = stats if node_type is None else stats.where(F.col("node_type") == node_type)
    return own.where("docs > 0 or degree > 0")


def grouped_entities(stats: DataFrame, most: int) -> DataFrame:
    """(node_type, nodes, names): number of nodes of each type, and the names of the `most` of them in most documents, in that order."""
    order = Window.partitionBy("node_type").orderBy(F.desc("docs"), "name", "node_id")
    first = stats.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    listed = first.groupBy("node_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "name"))), lambda x: x["name"]).alias("names"))  # at most `most` a type
    return stats.groupBy("node_type").agg(F.count(F.lit(1)).alias("nodes")).join(listed, "node_type")


def capped_counts(docs: DataFrame, theme: str, order: list[Column], cap: int, condition: Column) -> DataFrame:
    """Per theme the documents that a cap on each theme leaves, by `order`, and those of them for which a condition holds."""
    kept = docs.withColumn("_hit", F.coalesce(condition, F.lit(False)).cast("long")).withColumn("_r", F.row_number().over(Window.partitionBy(theme).orderBy(*order))).where(F.col("_r") <= cap)
    return kept.groupBy(theme).agg(F.count(F.lit(1)).alias("kept"), F.sum("_hit").alias("hits"))
