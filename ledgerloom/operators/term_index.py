"""A stored keyword index: postings in blocks with their best score, and top-k searches that read few blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.features import words
from ledgerloom.operators.durable import Workspace, dealt, few, parts_for, small_batches
from ledgerloom.operators.retrieval import indexed_text, inverse_frequency, ranked, saturation

K1, B = 1.2, 0.75
BUCKETS = 64
DOCS_PER_GROUP = 256
#: Scores are rounded to six places, so bounds leave that much room.
SLACK = 2e-6


_HELD = pa.list_(pa.struct([("doc_id", pa.int64()), ("tf", pa.int64()), ("len", pa.int32())]))
_BLOCKS = "term string, grp long, n long, best double, held array<struct<doc_id: long, tf: long, len: int>>"


def _blocks_of(batch: pa.Table, avg_len: float) -> pa.RecordBatch:
    """The blocks of whole groups (grp, doc_id, w), words counted as arrays; of a doc_id's rows the first one's length counts."""
    grp, ids = batch["grp"].to_numpy(), batch["doc_id"].to_numpy()
    docs, first, doc = np.unique(ids, return_index=True, return_inverse=True)
    listed = batch["w"].combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    known = listed.flatten().dictionary_encode()
    groups, group = np.unique(grp, return_inverse=True)
    place = np.repeat(np.arange(len(ids)), sizes)
    word = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key, tf = np.unique((group[place] * len(known.dictionary) + word) * len(docs) + doc[place], return_counts=True)
    block, at = np.divmod(key, max(1, len(docs)))
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
    length = sizes[first][at]
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_len)) if len(tf) else np.zeros(0)
    group, word = np.divmod(block[starts], max(1, len(known.dictionary)))
    held = pa.StructArray.from_arrays([pa.array(docs[at], pa.int64()), pa.array(tf, pa.int64()), pa.array(length, pa.int32())], fields=list(_HELD.value_type))
    ends = np.r_[starts, len(block)]
    best = np.maximum.reduceat(part, starts) if len(starts) else part
    columns = [known.dictionary.take(pa.array(word)), pa.array(groups[group], pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(best, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held)]
    return pa.RecordBatch.from_arrays(columns, ["term", "grp", "n", "best", "held"])


def _blocks(batches: Iterator[pa.RecordBatch], avg_len: float) -> Iterator[pa.RecordBatch]:
    """The blocks of rows (grp, doc_id, w) that come sorted by grp; the last group of a batch waits for the next batch."""
    left = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
        cut = int(np.searchsorted(rows["grp"].to_numpy(), rows["grp"][-1].as_py()))
        left = rows.slice(cut)
        if cut:
            yield _blocks_of(rows.slice(0, cut), avg_len)
    if left is not None:
        yield _blocks_of(left, avg_len)


@dataclass
class TermIndex:
    """A stored index: `blocks` by bucket of the term, and `stats` (n documents, their avg_len and doc groups), one row."""

    spark: SparkSession
    path: str

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema("term string, grp long, n long, best double, held array<struct<doc_id: long, tf: long, len: int>>, bucket int").parquet(f"{self.path}/blocks")

    @property
    def stats(self) -> dict:
        return self.spark.read.parquet(f"{self.path}/stats").first().asDict()


def _bucket(buckets: int = BUCKETS):
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def build(docs: DataFrame, path: str, docs_per_group: int = DOCS_PER_GROUP) -> TermIndex:
    """Write the index of docs (doc_id, text and filename if there is one) to a folder: one row per word and group of documents.

    Documents are dealt by hash into groups of about docs_per_group, so a block of a common word is as small as any other.
    A block has its documents with their counts and lengths, and `best`, the greatest part of a score that one of them
    gives. The texts are dealt by group once, and a group's words are counted where it lies, as arrays; the blocks, several times
    the texts as rows, are written from there and never shuffled. They lie in folders by a hash of the word, in each file sorted by word and
    group, so a search opens the folders of its words and Parquet's statistics pass over the rest. Rows without a doc_id are left out; of a doc_id that repeats each
    row is a posting of its own.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null")
    size = F.coalesce(F.size(words(indexed_text(docs))), F.lit(0))
    stats = docs.select(F.when(size < 0, 0).otherwise(size).alias("len")).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    stats = stats.withColumn("groups", F.greatest(F.lit(1), F.ceil(F.col("n") / docs_per_group)))
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    known = TermIndex(spark, path).stats
    grp = F.pmod(F.xxhash64("doc_id"), F.lit(known["groups"]))
    avg_len = known["avg_len"] or 1.0  # no word, no block
    small_batches(spark)
    listed = docs.select(grp.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), indexed_text(docs).alias("_text"))
    parts = parts_for(spark, 32 * known["n"])  # some 15,000 documents a task, whose blocks it can sort in memory
    sorted_ = dealt(listed, parts, "grp") if parts else listed.repartition("grp")
    sorted_ = sorted_.sortWithinPartitions("grp").select("grp", "doc_id", words(F.col("_text")).alias("w"))
    blocks = sorted_.mapInArrow(lambda batches: _blocks(batches, avg_len), _BLOCKS).withColumn("bucket", _bucket())
    blocks.sortWithinPartitions("bucket", "term", "grp").write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/blocks")
    return TermIndex(spark, path)


def search(index: TermIndex, terms: DataFrame, limit: int = 5, all_terms: bool = True, first_groups: int = 4) -> tuple[DataFrame, DataFrame]:
    """(top, reads): the rows of retrieval.bm25_terms for terms (query_id, term), and per query the blocks it read and has.

    The bounds of the blocks come first, without the postings: the sum of a query's best parts in a group of documents is
    the most that one of them can score (nothing, with all_terms, if the group lacks a word). The first_groups most
    promising groups of a query are read and give its limit-th score so far; then only groups whose bound reaches it
    are. So no document that belongs to the top is missed, and the rest of the postings is never read.
    """
    known = index.stats
    with Workspace(index.spark, "search") as work:
        asked = work.keep(terms.select("query_id", "term").where("term is not null").distinct().withColumn("bucket", _bucket()))
        names = work.keep(asked.select("bucket", "term").distinct())
        small = lambda t: F.broadcast(t) if few(t) else t
        heads = work.keep(index.blocks.select("bucket", "term", "grp", "n", "best").join(small(names), ["bucket", "term"], "left_semi"))
        df = heads.groupBy("term").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("blocks"))
        weighed = work.keep(asked.join(df, "term", "left").withColumn("idf", inverse_frequency(F.lit(known["n"]), F.col("df"))))
        need = work.keep(weighed.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"), F.count("df").alias("known"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks")))
        queries = need.count()
        found_terms = weighed.where("df is not null").select("bucket", "term", "query_id", "idf")

        def by_group(table: DataFrame, rows: int) -> DataFrame:
            parts = parts_for(index.spark, rows)
            return dealt(table, parts, "grp") if parts else table.repartition("grp")

        bounds = by_group(heads, queries * known["groups"]).join(small(found_terms), ["bucket", "term"]).groupBy("query_id", "grp").agg(F.sum(F.col("idf") * F.col("best")).alias("bound"), F.count(F.lit(1)).alias("held"))
        bounds = bounds.join(F.broadcast(need.select("query_id", "need")) if few(need) else need.select("query_id", "need"), "query_id")
        ordered = work.keep((bounds.where("held = need") if all_terms else bounds).select("query_id", "grp", "bound", "held", "need"))
        order = ranked(ordered.select("query_id", F.col("grp").alias("doc_id"), F.col("bound").alias("score")), first_groups)
        first = work.keep(order.select("query_id", F.col("doc_id").alias("grp")))

        def best(groups: DataFrame) -> DataFrame:
            """The best `limit` documents (query_id, doc_id, score) of (query_id, grp) pairs.

            Blocks and a group's queries meet in partitions of groups, by the group alone, before a block is paired with the
            queries of its word; a document's score is summed and ranked there, so neither blocks of queries nor pairs of query
            and document are shuffled.
            """
            pairs = groups.count() * (-(-known["n"] // known["groups"]))
            read = index.blocks.select("bucket", "term", "grp", "held").join(small(names), ["bucket", "term"], "left_semi")
            where = groups.select("grp").distinct()
            read = read.join(F.broadcast(where), "grp", "left_semi") if few(where) else read
            asking = by_group(groups.select("query_id", "grp"), pairs).groupBy("grp").agg(F.collect_set("query_id").alias("_asking"))
            own = by_group(read, pairs).join(asking.hint("shuffle_hash"), "grp").join(small(found_terms), ["bucket", "term"]).where(F.array_contains("_asking", F.col("query_id")))
            part = F.col("idf") * saturation(F.lit(known["avg_len"]), K1, B)
            each = own.select("query_id", "grp", "idf", F.explode("held").alias("h")).select("query_id", "grp", "idf", "h.doc_id", "h.tf", "h.len")
            each = each.groupBy("query_id", "grp", "doc_id").agg(F.sum(part).alias("s"), F.count(F.lit(1)).alias("found"))
            each = each.join(F.broadcast(need) if few(need) else need, "query_id").where("found = need") if all_terms else each
            return work.keep(ranked(each.select("query_id", "doc_id", F.round("s", 6).alias("score")), limit))

        found = best(first)
        floor = found.where(F.col("rank") == limit).select(F.col("query_id").alias("_q"), F.col("score").alias("floor"))
        open_ = ordered.join(floor, F.col("query_id") == F.col("_q"), "left").where(F.col("floor").isNull() | (F.col("bound") + SLACK >= F.col("floor"))).select("query_id", "grp", "held")
        later = work.keep(open_.join(first, ["query_id", "grp"], "left_anti"))
        top = ranked(found.drop("rank").unionByName(best(later).drop("rank")), limit)
        visited = first.join(ordered.select("query_id", "grp", "held"), ["query_id", "grp"]).unionByName(later.select("query_id", "grp", "held")).groupBy("query_id").agg(F.sum("held").alias("read"))
        reads = need.where("blocks > 0").join(visited, "query_id", "left").select("query_id", "blocks", F.coalesce("read", F.lit(0)).alias("read"))
        return work.result(top.select("query_id", "doc_id", "score", "rank")), work.result(reads)
