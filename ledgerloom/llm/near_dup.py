"""Near-duplicate classes by ProbMinHash signatures of weighted shingles, banding and verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import U64, Workspace, components, materialise, mix64, word_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
SALTS = 64
SKETCH_SCHEMA = "doc_id long, content binary, salt int, bands array<long>, shingles array<int>"
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], U64)


def shingle_hashes(texts: list[str], k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each text and their text's index; a text of fewer words is one shingle."""
    words, owner = word_hashes(texts)
    if not len(words):
        return words, owner
    counts = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    n = np.where(counts > 0, np.maximum(counts - k + 1, 1), 0)
    own = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + first[own]
    end = (first + counts)[own]
    total = np.zeros(len(own), U64)
    for j in range(k):
        inside = at + j < end
        total += np.where(inside, mix64(words[np.minimum(at + j, len(words) - 1)] + U64(j + 1)) * _STEPS[j % 8], U64(0))
    return mix64(total), own


def weigh(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, hash) pairs, sorted, with their number of occurrences."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    return hashes[at], owner[at], np.diff(np.append(at, len(hashes)))


def prob_min_hash(hashes: np.ndarray, owner: np.ndarray, weights: np.ndarray, n: int, m: int) -> np.ndarray:
    """ProbMinHash signatures, n rows of m registers: the element whose arrival is earliest in each register.

    Every element is a Poisson process with its weight as the rate; each arrival falls on a register drawn at random.
    All randomness is hashed from the element, so equal elements arrive alike in all texts, and registers of two texts
    agree with the probability Jaccard of their weights. Rounds advance all elements of a batch by one arrival; an
    element stops once it is later than every register of its text, which ends most after one round.
    """
    times, winners = np.full(n * m, np.inf), np.zeros(n * m, U64)
    clock, live, turn = np.zeros(len(hashes)), np.arange(len(hashes)), 0
    while len(live):
        turn += 1
        drawn = mix64(hashes[live] + np.full(1, turn, U64) * U64(0xD1342543DE82EF95))
        clock[live] += -np.log(((drawn >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[live]
        slot = owner[live] * m + (mix64(drawn) % U64(m)).astype(np.int64)
        np.minimum.at(times, slot, clock[live])
        won = times[slot] == clock[live]
        winners[slot[won]] = hashes[live[won]]
        latest = times.reshape(n, m).max(axis=1)
        live = live[clock[live] < latest[owner[live]]]
    return winners.reshape(n, m)


def content_of(text: Column) -> Column:
    """128-bit key of a whole text; null for null."""
    return F.unhex(F.md5(text.cast("string").cast("binary")))


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, content (hash of the exact text), bands (a hash per band of registers) and the distinct shingles.

    A shingle of count c weighs 1.25 - 0.25 / c: repeats count, but a line that one copy repeats a hundred times and another
    twice does not hide what they share, as plain counts would, since links are judged by distinct shingles. Shingles are
    kept as sorted 32-bit hashes: among n of them about n / 2^33 fall together, which moves a similarity by less than
    0.00001 for texts of up to 40,000 words. Null texts have null content and no bands; texts without a word have no
    bands and no shingles, and match exact copies only. salt deals the rows of equal texts over SALTS parts.
    """
    seeds = mix64(np.arange(1, bands + 1, dtype=U64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 512):
                batch = whole.iloc[start : start + 512]
                texts = [t or "" for t in batch["text"]]
                hashes, owner, counts = weigh(*shingle_hashes(texts, k))
                signature = prob_min_hash(hashes, owner, 1.25 - 0.25 / counts, len(texts), bands * rows)
                keys = np.zeros((len(texts), bands), U64)
                for r in range(rows):
                    keys = mix64(keys + signature[:, r::rows] + U64(r + 1))
                keys = mix64(keys + seeds).view(np.int64)
                low = (hashes & U64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
                sets = [np.unique(x) for x in np.split(low, ends[:-1])]
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None),
                    "content": batch["content"],
                    "salt": np.arange(start, start + len(batch), dtype=np.int32) % SALTS,
                    "bands": [keys[i] if len(s) else keys[i][:0] for i, s in enumerate(sets)],
                    "shingles": sets,
                })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), content_of(F.col("text")).alias("content")).mapInPandas(run, SKETCH_SCHEMA)


def verified(pairs: DataFrame, shingles: DataFrame, per_group: int = 128) -> DataFrame:
    """Exact Jaccard `j` of pairs (a, b) from shingles (doc_id, shingles).

    b may be a hub of very many pairs: its pairs are dealt into groups of about per_group by a hash of a, and its
    shingles are copied once per group, so no task gets all pairs of a hub.
    """
    groups = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / per_group).alias("groups"))
    dealt = pairs.join(groups, "b").withColumn("g", F.pmod(F.xxhash64("a"), F.col("groups")))
    left = dealt.select("a", "b", "g").join(shingles.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    right = shingles.join(groups, shingles["doc_id"] == groups["b"]).select("b", "shingles", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("g"))
    both = left.join(right.withColumnRenamed("shingles", "sb"), ["b", "g"])
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("j"))


def _links(nodes: DataFrame, sketched: DataFrame, similarity: float, work: Workspace) -> DataFrame:
    """Pairs (a, b) of nodes (content, rep, bands, node) that share a band and whose Jaccard is at least `similarity`,
    as many as their components need."""
    buckets = nodes.select(F.col("node").alias("doc_id"), F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    inside = work.keep(buckets.join(shared, "bucket"), "buckets")
    central = inside.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    hubs = inside.join(central, "doc_id").groupBy("bucket").agg(F.max_by("doc_id", F.struct("weight", -F.col("doc_id"))).alias("hub"))
    spokes = work.keep(inside.join(hubs, "bucket").select("bucket", "doc_id", "hub"), "spokes")
    involved = nodes.select("rep", "content", "node").join(inside.select(F.col("doc_id").alias("node")).distinct(), "node", "left_semi")
    own = sketched.select(F.col("doc_id").alias("rep"), "content", "shingles").join(involved, ["rep", "content"])
    shingles = work.keep(own.select(F.col("node").alias("doc_id"), "shingles").dropDuplicates(["doc_id"]), "shingles")
    tested = work.keep(verified(spokes.where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct(), shingles), "tested")
    links = tested.where(F.col("j") >= similarity).select("a", "b")
    labels = components(links, work)

    # Texts of one bucket in different components so far. Distances to the hub bound the distance between two of them,
    # and so do the shingles that no other text of these buckets has: they are in no intersection.
    seen = spokes.join(tested, (spokes["doc_id"] == tested["a"]) & (spokes["hub"] == tested["b"]), "left").select("bucket", "doc_id", "hub", "j").where("doc_id <> hub")
    seen = work.keep(seen.join(labels, seen["doc_id"] == labels["node"], "left").select("bucket", "doc_id", "j", F.coalesce("label", "doc_id").alias("label")), "seen")
    contested = seen.join(seen.where(F.col("j") < similarity).select("bucket").distinct(), "bucket", "left_semi")
    sets = shingles.join(contested.select("doc_id").distinct(), "doc_id", "left_semi")
    unique = sets.select("doc_id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("owner")).where("n = 1").groupBy("owner").agg(F.count(F.lit(1)).alias("own"))
    sizes = sets.select("doc_id", F.size("shingles").alias("n")).join(unique, F.col("doc_id") == F.col("owner"), "left").select(F.col("doc_id").alias("id"), "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common"))
    open_ = contested.join(sizes.where(F.col("common") + 1e-9 >= similarity * F.col("n")), F.col("doc_id") == F.col("id")).drop("id")
    of_text = open_.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("bucket").alias("buckets"))  # as many as bands at most
    open_ = work.keep(open_.join(of_text, F.col("doc_id") == F.col("id")).drop("id"), "open")
    work.drop(inside, seen)

    # A bucket's texts are dealt into groups; each group meets the whole bucket, so no task compares all with all.
    groups = open_.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / 128).alias("groups"))
    grouped = open_.join(groups, "bucket")
    x = grouped.where(F.col("j") < similarity).withColumn("g", F.pmod(F.xxhash64("doc_id"), F.col("groups"))).alias("x")
    y = grouped.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).alias("y")
    most = F.least("x.common", "y.common")
    slack = 1 - similarity + 1e-9
    possible = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.g") == F.col("y.g")) & (F.col("x.label") != F.col("y.label")) & (F.abs(F.col("x.j") - F.col("y.j")) <= slack) & (most + 1e-9 >= similarity * (F.col("x.n") + F.col("y.n") - most))
    possible = possible & (F.array_min(F.array_intersect("x.buckets", "y.buckets")) == F.col("x.bucket"))  # once, not once a bucket
    rest = x.join(y, possible).select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
    rest = work.keep(verified(rest, shingles).where(F.col("j") >= similarity).select("a", "b"), "rest")
    return links.union(rest)


def _classes(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, similarity: float = SIMILARITY, k: int = SHINGLE_WORDS) -> DataFrame:
    """near_duplicates's rows with the key of their text, from tables of its own that are gone afterwards."""
    work = Workspace(docs.sparkSession, "near-duplicates")
    whole = work.keep(sketch(docs, bands, rows, k), "sketch")
    sketched = whole.where("doc_id is not null and content is not null")
    texts = work.keep(sketched.groupBy("content").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "texts")
    several = work.keep(texts.groupBy("rep").agg(F.min("content").alias("main"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "several")
    ambiguous = not several.isEmpty()
    nodes = texts.withColumn("node", F.col("rep"))
    if ambiguous:  # a doc_id that is the first of several texts numbers one of them; the others get numbers of their own
        other = F.col("main").isNotNull() & (F.col("main") != F.col("content"))
        nodes = work.keep(texts.join(several, "rep", "left").withColumn("node", F.when(other, F.xxhash64("content", "rep")).otherwise(F.col("rep"))).drop("main"), "nodes")
    labels = components(_links(nodes, sketched, similarity, work), work)
    found = nodes.select("content", "rep", "node").join(labels.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("content", "rep", F.coalesce("label", "node").alias("class_id"))
    if ambiguous:
        least = found.groupBy(F.col("class_id").alias("_c")).agg(F.min("rep").alias("least"))
        found = found.join(least, F.col("class_id") == F.col("_c")).select("content", "rep", F.col("least").alias("class_id"))
    # A text's class goes to its parts, at most SALTS of them, and from there to the rows: no task gets all copies of a text.
    parts = sketched.select("content", "salt").distinct().join(found, "content")
    classed = sketched.select("doc_id", "content", "salt").join(parts, ["content", "salt"]).select("doc_id", "content", "class_id", F.col("rep").alias("copy_of"))
    alone = whole.where("doc_id is null or content is null").select("doc_id", "content", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"))
    out = materialise(classed.unionByName(alone), "classes")
    work.close()
    return out


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class), copy_of (that of its exact text).

    Two different texts are linked if they share a band of ProbMinHash registers and the Jaccard similarity of their
    distinct five-word shingles is at least 0.8; classes are the connected components of texts. options: similarity,
    bands, rows, k. A pair at the limit is missed by all 20 bands of 4 rows with a probability near 3e-5 if repeats are
    alike, 2e-4 if half of what they share recurs often in one text only, and 8e-4 if either text repeats another half.

    The work is keyed by text, by a 128-bit hash: copies are folded first. In each bucket of a band every text is
    compared with the bucket's hub, the text that shares most buckets; this decides all but few pairs. The rest are
    compared too, but only where the triangle inequality of the Jaccard distance leaves a link between two components
    possible. So no candidate is left out and no group of copies is expanded into its pairs. Null texts are classes of
    their own, all empty texts are copies of each other, and a null doc_id has a null class. Repeated rows share their
    class; rows of one doc_id with different texts each have their own text's class. Other columns are not read.
    """
    return _classes(docs, **options).drop("content")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without those whose class has a smaller doc_id.

    Repeated rows stay if one stays; of one doc_id with several texts each row is judged by its own text.
    """
    gone = _classes(docs, **options).where("class_id < doc_id").select(F.col("doc_id").alias("_id"), F.col("content").alias("_content")).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col("_id")) & (content_of(F.col("text")) == F.col("_content")), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
