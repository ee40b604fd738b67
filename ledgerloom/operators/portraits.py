"""Everything around an entity: its edges, actions and documents; authors with their documents; remapped graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.actions import urgency, with_urgency
from ledgerloom.operators.graph import consolidate, consolidate_links


def facts(focus: DataFrame, edges: DataFrame, links: DataFrame, actions: DataFrame, docs: DataFrame, as_of: Column, most: int = 10) -> DataFrame:
    """(node_id, section, place, ref, detail): the first `most` edges, actions and documents of each focus node (node_id).

    edges: src, dst, relation, weight; both directions, the heaviest first, detail "relation>" or "<relation". links: doc,
    node_id. actions: action_id, doc, status, due; those of the node's documents, most urgent first, detail the status.
    docs: doc, doc_date; the latest first, detail the date. A document or action counts once for a node. Each section is
    cut per node by a window, so a node with very many rows sends no more than `most` of each task on.
    """
    asked = focus.select("node_id").distinct()
    out_ = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("ref"), F.concat("relation", F.lit(">")).alias("detail"), "weight")
    in_ = edges.select(F.col("dst").alias("node_id"), F.col("src").alias("ref"), F.concat(F.lit("<"), "relation").alias("detail"), "weight")
    own = links.join(asked, "node_id", "left_semi").select("node_id", "doc").distinct()
    todo = with_urgency(own.join(actions.select("action_id", "doc", "status", "due"), "doc").select("node_id", "action_id", "status", "due").distinct(), as_of)
    seen = own.join(docs.select("doc", "doc_date"), "doc")

    def section(rows: DataFrame, name: str, order: list, ref: str, detail: Column) -> DataFrame:
        placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("node_id").orderBy(*order))).where(F.col("place") <= most)
        return placed.select("node_id", F.lit(name).alias("section"), "place", F.col(ref).cast("string").alias("ref"), detail.cast("string").alias("detail"))

    parts = [
        section(out_.unionByName(in_).join(asked, "node_id", "left_semi"), "edge", [F.desc("weight"), "ref", "detail"], "ref", F.col("detail")),
        section(todo, "action", urgency(), "action_id", F.col("status")),
        section(seen, "document", [F.desc_nulls_last("doc_date"), "doc"], "doc", F.col("doc_date")),
    ]
    return reduce(DataFrame.unionByName, parts)


def author_graph(links: DataFrame, nodes: DataFrame, reviews: DataFrame, status: str | None = None, authors: int = 100, documents: int = 12) -> tuple[DataFrame, DataFrame]:
    """(authors, edges): persons with their documents, by what was decided about each.

    links: doc, node_id, role, confidence; nodes: node_id, node_type, name; reviews: doc, node_id, status. A document of a person is
    as its review says, else approved if a link has the role author, else pending. authors: node_id, name, documents,
    approved, pending, rejected; the most documents first, then by name; with a status only persons that have one. edges:
    node_id, doc, decision, confidence, place: the first `documents` of each such author, the surest first.
    """
    people = nodes.where("node_type = 'person'").select("node_id", "name")
    per_doc = links.groupBy("doc", "node_id").agg(F.max((F.col("role") == "author").cast("int")).alias("own"), F.max("confidence").alias("confidence"))
    said = reviews.groupBy("doc", "node_id").agg(F.max("status").alias("said"))
    judged = per_doc.join(people, "node_id").join(said, ["doc", "node_id"], "left").withColumn("decision", F.coalesce("said", F.when(F.col("own") == 1, "approved").otherwise("pending")))
    count = lambda s: F.sum((F.col("decision") == s).cast("long"))
    counted = judged.groupBy("node_id", "name").agg(F.count(F.lit(1)).alias("documents"), *[count(s).alias(s) for s in ("approved", "pending", "rejected")])
    shown = counted if status is None else counted.where(F.col(status) > 0)
    first = shown.orderBy(F.desc("documents"), F.lower("name"), "node_id").limit(authors)
    kept = judged if status is None else judged.where(F.col("decision") == status)
    order = Window.partitionBy("node_id").orderBy(F.desc("confidence"), "doc")
    edges = kept.join(first.select("node_id"), "node_id", "left_semi").withColumn("place", F.row_number().over(order)).where(F.col("place") <= documents)
    return first, edges.select("node_id", "doc", "decision", "confidence", "place")


def remap(nodes: DataFrame, edges: DataFrame, links: DataFrame, mapping: DataFrame, purged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, links) with aliases (alias, canonical) made one with their nodes, and purged nodes (node_id) gone.

    Edges and links are turned to the canonical node and merge where they meet; self-loops go. Alias nodes go, and a
    canonical node that has no row takes over the type and name of its first alias. What touches a purged node goes; a
    purged alias is remapped first. The aliases of a mapping are no canonical nodes of it.
    """
    gone = purged.select("node_id").distinct()
    taken = mapping.join(nodes, mapping["alias"] == nodes["node_id"]).groupBy("canonical").agg(F.min(F.struct("alias", "node_type", "name")).alias("a")).select(F.col("canonical").alias("node_id"), "a.node_type", "a.name")
    kept = nodes.select("node_id", "node_type", "name").join(mapping.select(F.col("alias").alias("node_id")), "node_id", "left_anti")
    whole = kept.unionByName(taken.join(kept, "node_id", "left_anti")).join(gone, "node_id", "left_anti")
    end = lambda name: gone.withColumnRenamed("node_id", name)
    moved = consolidate(edges, mapping).join(end("src"), "src", "left_anti").join(end("dst"), "dst", "left_anti")
    return whole, moved, consolidate_links(links, mapping).join(gone, "node_id", "left_anti")
