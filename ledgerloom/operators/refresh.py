"""Whole refresh jobs: embeddings of chunks, re-extraction of a class of files, links mirrored between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.features import hashed_embedding
from ledgerloom.operators import retrieval
from ledgerloom.operators.durable import dealt
from ledgerloom.sources import files


def refresh_embeddings(chunks: DataFrame, vectors: DataFrame, dim: int = 64) -> DataFrame:
    """(doc_id, chunk_index, embedding, kept): every chunk (doc_id, chunk_index, chunk_text) with a vector.

    A usable vector of the old table is kept; a chunk whose vector is missing, null or empty gets a hashed one. Vectors
    without a chunk go. One join on the chunk's key; only chunks that need a vector pay for it.
    """
    key = ["doc_id", "chunk_index"]
    usable = vectors.where(F.size("embedding") > 0).select(*key, F.col("embedding").cast("array<double>").alias("_old")).dropDuplicates(key)
    both = chunks.join(usable, key, "left")
    asked = F.when(F.col("_old").isNull(), F.coalesce("chunk_text", F.lit("")))  # null, which costs nothing, where a vector is kept
    return both.select(*key, F.coalesce("_old", hashed_embedding(asked, dim)).alias("embedding"), F.col("_old").isNotNull().alias("kept"))


def reextracted(locations: DataFrame, found: DataFrame, extension: str) -> DataFrame:
    """(doc_id, text) read anew from the first location (doc_id, path) of each document that has a file of the extension.

    found: path and content of the files at hand. A file that cannot be read gives no row, so its document stays as it is.
    The result is used several times: write it before apply_reextraction.
    """
    own = locations.where(F.lower("path").endswith(f".{extension.lower()}")).join(found.select("path"), "path", "left_semi").groupBy("doc_id").agg(F.min("path").alias("path"))
    read = files.extract(found.join(own.select("path").distinct(), "path", "left_semi")).where("extraction_error is null and text is not null")
    return own.join(read.select("path", "text"), "path").select("doc_id", "text")


def apply_reextraction(docs: DataFrame, chunks: DataFrame, read: DataFrame, size: int = 600, overlap: int = 80) -> tuple[DataFrame, DataFrame]:
    """(docs, chunks): documents read anew take their text, and their chunks are made again; all others stay."""
    new = read.select("doc_id", F.col("text").alias("_text"))
    fresh = docs.join(new, "doc_id", "left").withColumn("text", F.coalesce("_text", "text")).select(*docs.columns)
    made = retrieval.chunks(read, size, overlap)
    return fresh, chunks.join(new.select("doc_id"), "doc_id", "left_anti").select(*made.columns).unionByName(made)


def mirror_links(links: DataFrame, edges: DataFrame, placed: DataFrame, nodes: DataFrame, docs: DataFrame, parts: int | None = None) -> DataFrame:
    """links (doc_id, node_id, role, confidence) and, where absent, those that the other tables know.

    edges (src, dst, relation, weight) from doc_<doc_id> to a node give links of that role; placed (doc_id, geo_id,
    confidence) give LOCATED_IN links to the node location_<geo_id> and to nodes whose properties hold the geo_id. Only
    known documents and nodes are linked; of several confidences the highest counts, and null stands for 1.

    Nodes are hashed, so no links are sorted by node, of which a few may have most; with `parts` links and documents are
    dealt once by doc_id, and all that follows stays in those partitions.
    """
    from_edges = edges.where(F.col("src").startswith("doc_")).select(F.substring("src", 5, 1 << 20).alias("doc_id"), F.col("dst").alias("node_id"), F.col("relation").alias("role"), F.col("weight").cast("double").alias("confidence"))
    by_id = placed.select("doc_id", F.concat(F.lit("location_"), F.regexp_replace(F.lower("geo_id"), "[- ]", "_")).alias("node_id"), F.col("confidence").cast("double").alias("confidence"))
    property_ = nodes.select("node_id", F.get_json_object("properties", "$.geo_id").alias("geo_id")).where("geo_id is not null")
    by_property = placed.join(property_, "geo_id").select("doc_id", "node_id", F.col("confidence").cast("double").alias("confidence"))
    from_places = by_id.unionByName(by_property).select("doc_id", "node_id", F.lit("LOCATED_IN").alias("role"), "confidence")
    key = ["doc_id", "node_id", "role"]
    known = from_edges.unionByName(from_places).join(nodes.select("node_id").hint("shuffle_hash"), "node_id", "left_semi")
    known = dealt(known, parts, "doc_id").join(dealt(docs.select("doc_id"), parts, "doc_id"), "doc_id", "left_semi")
    new = known.groupBy(*key).agg(F.max(F.coalesce("confidence", F.lit(1.0))).alias("confidence"))
    links = links.select(*key, "confidence")
    there = dealt(links.select(*key), parts, "doc_id").distinct()
    return links.unionByName(new.join(there, key, "left_anti").select(*links.columns))


def embedding_health(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dims and filled: length of each vector (embedding), and its places that are not zero."""
    return vectors.select("vec_id", "label", F.size("embedding").alias("dims"), F.size(F.filter("embedding", lambda x: x != 0)).alias("filled"))


def embedding_status(vectors: DataFrame) -> DataFrame:
    """(label, vectors, empty): vectors of each label, and those without a direction."""
    return embedding_health(vectors).groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.col("filled") == 0).alias("empty"))
