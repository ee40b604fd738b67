"""I-Match fingerprints over a band of inverse document frequencies with randomised lexicon subsets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import U64, mix64, word_hashes

LOW_SHARE, HIGH_SHARE = 0.0005, 0.1
SUBSETS = 32
NO_KEY = -(2**63)


def distinct_terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct term hashes of each text and the text's index."""
    hashes, owner = word_hashes(texts)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], owner[fresh]


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df) over all documents, terms as 64-bit hashes; each task adds up its own texts before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            terms = np.concatenate([t for t, _ in held])
            unique, at = np.unique(terms, return_inverse=True)
            return unique, np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        for batch in batches:
            for start in range(0, len(batch), 1000):
                terms, n = np.unique(distinct_terms([t or "" for t in batch["text"].iloc[start : start + 1000]])[0], return_counts=True)
                held.append((terms, n))
                size += len(terms)
                if size > 2_000_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1_000_000:  # memory stays bounded; Spark adds the parts up
                        yield pd.DataFrame({"term": held[0][0].view(np.int64), "n": held[0][1]})
                        held, size = [], 0
        if held:
            terms, n = merged()
            yield pd.DataFrame({"term": terms.view(np.int64), "n": n})

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(count, "term long, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("df"))


def lexicon(docs: DataFrame, low: float = LOW_SHARE, high: float = HIGH_SHARE) -> np.ndarray:
    """Sorted hashes of the terms whose inverse document frequency lies between ln(1/high) and ln(1/low).

    Each term is in at least a share `low` of the documents, so there are at most (mean distinct terms a document) / low
    of them, however many documents there are: that bounds what the driver gets and broadcasts.
    """
    n = docs.count()
    rows = document_frequencies(docs).where((F.col("df") >= max(1.0, low * n)) & (F.col("df") <= max(1.0, high * n))).select("term").toPandas()
    return np.sort(rows["term"].to_numpy(np.int64).view(U64))


def fingerprints(texts: list[str], known: np.ndarray, subsets: int = SUBSETS) -> list[str]:
    """A fingerprint per text: for two scales s, the hash of the text's terms in each of `subsets` random lexicon subsets.

    A subset of scale s holds each term with probability 2^-s, so that a text of n terms has one to two of them in a
    subset of its first scale, floor(log2 n), and half as many in its second. Written as "scale:hashes" twice; a subset
    without a term is "----". A text without a term in the band has none of that: its fingerprint is "-" and a hash of
    its whole, so that it is like equal texts only. Equal texts have equal fingerprints whatever stands beside them.
    """
    terms, owner = distinct_terms(texts)
    at = np.searchsorted(known, terms)
    inside = known[np.minimum(at, len(known) - 1)] == terms if len(known) else np.zeros(len(terms), bool)
    terms, owner = terms[inside], owner[inside]
    n = np.bincount(owner, minlength=len(texts))
    scale = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
    starts = np.cumsum(n) - n
    full = np.flatnonzero(n)
    out = np.zeros((len(texts), 2, subsets), np.uint16)
    some = np.zeros((len(texts), 2, subsets), bool)
    masks = [(U64(1) << (scale + i).astype(U64)) - U64(1) for i in (0, 1)]
    for k in range(subsets):
        drawn = mix64(terms ^ mix64(np.full(1, k + 1, U64)))
        value = mix64(drawn)
        for i in (0, 1):
            member = (drawn & masks[i][owner]) == 0
            if len(full):
                total = np.add.reduceat(np.where(member, value, U64(0)), starts[full])
                out[full, i, k] = (mix64(total) >> U64(48)).astype(np.uint16)
                some[full, i, k] = np.add.reduceat(member.astype(np.int64), starts[full]) > 0
    result = []
    for j in range(len(texts)):
        if not n[j]:
            result.append("-" + hashlib.sha256(texts[j].encode("utf-8", "replace")).hexdigest()[:32])
            continue
        parts = []
        for i in (0, 1):
            written = out[j, i].astype(">u2").tobytes().hex()
            parts.append(f"{scale[j] + i}:" + "".join(written[4 * k : 4 * k + 4] if some[j, i, k] else "----" for k in range(subsets)))
        result.append(";".join(parts))
    return result


def likeness(a: str, b: str) -> float:
    """Share of the subsets in which either text has terms where both hashes agree, at the first scale that both have.

    0 beside a text without a term in the band, unless the texts are equal.
    """
    if a == b:
        return 1.0
    if a[0] == "-" or b[0] == "-":
        return 0.0
    left, right = (dict(p.split(":") for p in x.split(";")) for x in (a, b))
    common = [s for s in left if s in right]
    if not common:
        return 0.0
    x, y = left[common[0]], right[common[0]]
    cells = [(x[i : i + 4], y[i : i + 4]) for i in range(0, len(x), 4)]
    either = [p for p in cells if p != ("----", "----")]
    return sum(p == q for p, q in either) / len(either) if either else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last third of code points replaced by as many (or all) first ones of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def next_documents(docs: DataFrame, rows_per_part: int = 4096) -> DataFrame:
    """Rows (part, key, doc_id, text, head) so that each part, read in order, holds runs of documents by descending doc_id.

    The order is cut into ranges by quantiles of doc_id; each range also gets a copy of the document that follows it
    (head = 1), the first of the next range or, after the last, of the first. Only one number per range reaches the
    driver. A null doc_id comes after all others; equal ids are ordered by text.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_KEY)).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = docs.count()
    parts = max(1, min(10_000, -(-n // rows_per_part)))
    cuts = np.array(sorted(set(keyed.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], 10 * parts + 100)).first()[0] or [])), np.int64)

    @F.pandas_udf("int")
    def part_of(keys: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, keys.to_numpy(np.int64), side="left"), dtype="int32")

    heads = {r["part"]: r["key"] for r in keyed.select("key", part_of("key").alias("part")).groupBy("part").agg(F.max("key").alias("key")).collect()}
    order = sorted(heads)
    before = [(heads[p], p, order[i - 1]) for i, p in enumerate(order)]
    table = docs.sparkSession.createDataFrame(before, "_key long, _part int, _to int")
    placed = keyed.withColumn("part", part_of("key")).join(F.broadcast(table), (F.col("key") == F.col("_key")) & (F.col("part") == F.col("_part")), "left")
    copies = F.when(F.col("_to").isNull(), F.array(F.struct("part", F.lit(0).alias("head")))).otherwise(F.array(F.struct("part", F.lit(0).alias("head")), F.struct(F.col("_to").alias("part"), F.lit(1).alias("head"))))
    spread = placed.withColumn("copy", F.explode(copies)).select("copy.part", "copy.head", "key", "doc_id", "text")
    dealt = spread.repartitionById(len(cuts) + 1, F.col("part")) if hasattr(spread, "repartitionById") else spread.repartition(len(cuts) + 1, "part")
    return dealt.sortWithinPartitions("part", "head", F.desc("key"), "text")


def match_edited(docs: DataFrame, low: float = LOW_SHARE, high: float = HIGH_SHARE, subsets: int = SUBSETS) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with the likeness to it and to the next document.

    Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null text counts
    as empty; of repeated rows each is a document; one document alone is followed by itself; an empty table gives an
    empty result. Other columns are not read. The texts are shuffled once; tasks read their sorted part as a stream.
    """
    known = docs.sparkSession.sparkContext.broadcast(lexicon(docs, low, high))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def finish(rows: list[tuple]) -> pd.DataFrame:
            """rows: (doc_id, text, following text or None); a following text is the next row's own if that is here."""
            ends = [edited(t, f) for _, t, f in rows]
            size = len(rows)
            prints = fingerprints([t for _, t, _ in rows] + ends + [rows[-1][2]], known.value, subsets)
            own, of_edited, last = prints[:size], prints[size : 2 * size], prints[2 * size]
            following = []
            for i, (_, _, text) in enumerate(rows):
                chained = i + 1 < size and rows[i + 1][1] is text
                following.append(own[i + 1] if chained else last if i + 1 == size else fingerprints([text], known.value, subsets)[0])
            return pd.DataFrame({
                "doc_id": pd.array([d for d, _, _ in rows], dtype="Int64"),
                "n_chars": [len(t) for _, t, _ in rows],
                "edited_sha256": [hashlib.sha256(e.encode("utf-8", "replace")).hexdigest() for e in ends],
                "fingerprint": own,
                "edited_fingerprint": of_edited,
                "near_edited": [likeness(a, b) for a, b in zip(own, of_edited, strict=True)],
                "near_next": [likeness(a, b) for a, b in zip(own, following, strict=True)],
            })

        held, ready, size, part, closed = None, [], 0, None, False
        for batch in batches:
            for own_part, head, doc_id, text in zip(batch["part"], batch["head"], batch["doc_id"], batch["text"], strict=True):
                if own_part != part:
                    part, held, closed = own_part, None, False
                if closed:  # of several heads with one key only the first follows
                    continue
                if held is not None:
                    ready.append((held[0], held[1], text))
                    size += len(held[1])
                held, closed = (None if pd.isna(doc_id) else int(doc_id), text), bool(head)
                if size > 2_000_000 or len(ready) >= 1000:
                    yield finish(ready)
                    ready, size = [], 0
        if ready:
            yield finish(ready)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return next_documents(docs).select("part", "head", "doc_id", "text").mapInPandas(run, schema)
