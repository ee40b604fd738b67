"""Best-fit packing of tokenised documents by minimum bin slack."""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise, number_in_order, number_within

CAPACITY = 1024
ROUNDS = 64
END_ID = 2
VOCABULARY = "byte_bpe_50k"
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"

_coders: dict[str, Coder] = {}


class Coder:
    """Ids of a byte-level vocabulary of public_tokenizers; control strings in a text are ordinary text.

    The rank file of the vocabulary holds the same ids as its JSON file and encodes several times faster. Its pattern gives
    up on runs of several 100,000 white-space characters; those texts are encoded by the JSON file's own tokenizer.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._path, self._whole = public_tokenizers.path(f"{vocabulary}.json"), None

    def encode(self, text: str) -> np.ndarray:
        try:
            return self._fast.encode_to_numpy(text)
        except ValueError:
            return self.encode_whole(text)

    def encode_whole(self, text: str) -> np.ndarray:
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self._path)
            self._whole.encode_special_tokens = True
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return self._fast.decode_bytes(ids.tolist()).decode("utf-8")


def encoder(vocabulary: str) -> Coder:
    """The coder of a vocabulary, kept for the life of the worker."""
    if vocabulary not in _coders:
        _coders[vocabulary] = Coder(vocabulary)
    return _coders[vocabulary]


def piece_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of n ids: only a longer document is cut, and then only its first piece may be shorter."""
    if n <= capacity:
        return [n]
    first = n % capacity
    return [first] * (first > 0) + [capacity] * (n // capacity)


def cut_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, keep_ids: bool = False, order: Column | None = None) -> DataFrame:
    """Tokenise whole documents and cut them: a row (doc_id, piece, start, length, ids_crc32[, ids][, place]) per piece.

    No shuffle. A null text counts as empty and gives one piece that holds the end id alone. Every row is a document
    of its own, so repeated rows give repeated pieces. Other columns are not read. order: a long per document, kept as place.
    """
    given = [] if order is None else [order.cast("long").alias("place")]
    more = ["ids"] * keep_ids + ["place"] * len(given)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, *place in zip(*(batch[c] for c in batch.columns), strict=True):
                ids = np.append(coder.encode(text or ""), np.uint32(END_ID)).astype("<u4")
                start = 0
                for piece, length in enumerate(piece_lengths(len(ids), capacity)):
                    own = ids[start : start + length]
                    out.append((doc_id, piece, start, length, zlib.crc32(own.tobytes())) + ((own.astype(np.int32),) if keep_ids else ()) + tuple(place))
                    start += length
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", *more])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *given).mapInPandas(cut, PIECE_SCHEMA + ", ids array<int>" * keep_ids + ", place long" * len(given))


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Plan bins for counts[length] items: a list of (items of one bin by length, number of equal bins).

    Each bin takes the longest remaining length and then the fullest feasible combination of the others, found by
    subset sums in the bits of one integer (bounded multiplicities split into powers of two). The combination is
    removed as often as the counts allow, since the next search would find the same one.
    """
    left = {length: n for length, n in counts.items() if n > 0 and 0 < length <= capacity}
    if any(n > 0 and not 0 < length <= capacity for length, n in counts.items()):
        raise ValueError("every length must lie between 1 and the capacity")
    order = sorted(left, reverse=True)
    plan = []
    while left:
        order = [length for length in order if length in left]
        longest = order[0]
        room = capacity - longest
        mask, reach, steps = (1 << (room + 1)) - 1, 1, []
        for length in order:
            if length > room or reach >> room & 1:
                continue
            copies, size = min(left[length] - (length == longest), room // length), 1
            while copies > 0 and not reach >> room & 1:
                size = min(size, copies)
                steps.append((length, size, reach))
                reach |= reach << length * size & mask
                copies -= size
                size *= 2
        total = reach.bit_length() - 1
        need = {longest: 1}
        for length, size, before in reversed(steps):
            if not before >> total & 1:
                need[length] = need.get(length, 0) + size
                total -= length * size
        times = min(left[length] // n for length, n in need.items())
        plan.append((need, times))
        for length, n in need.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return plan


def spread(plan: list[tuple[dict[int, int], int]], rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """The same bins in another order: the equal bins of every entry dealt evenly over the rounds.

    Bins of a round then take the same part of the pieces of each of their lengths, to about one round. Entries of few
    bins begin at different rounds.
    """
    out = []
    for r in range(rounds):
        for e, (need, times) in enumerate(plan):
            shift = e * 0.6180339887498949 % 1
            low, high = (min(times, max(0, math.ceil(x * times / rounds - shift))) if 0 < x < rounds else times * (x > 0) for x in (r, r + 1))
            if high > low:
                out.append((need, high - low))
    return out


def _places(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first item numbers of the plan's entries, items in a bin, first sequence, first offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for need, times in plan:
        offset = 0
        for length, n in need.items():
            rows.setdefault(length, []).append((used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {length: tuple(np.array(x, np.int64) for x in zip(*own, strict=True)) for length, own in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: str | None = None) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32, ...).

    Only the histogram of lengths, at most `capacity` rows whatever the input, reaches the driver, where the plan is
    made; the plan says where the n-th piece of each length goes. Pieces are numbered within their length by salted
    sub-groups, then placed by a search in the plan. An empty table gives an empty result; ties go by any order.

    order: a long column with the place of a piece's document. Pieces are then numbered within their length by (order,
    piece), bins take pieces of about the same place, and sequences are numbered by the first place that they hold.
    """
    sizes = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("rows"))
    counts = {int(r["length"]): int(r["rows"]) for r in sizes.collect()}
    plan = minimum_bin_slack(counts, capacity)
    places = _places(plan if order is None else spread(plan))
    sizes = pieces.sparkSession.createDataFrame(list(counts.items()), "length long, rows long")
    numbered = number_within(pieces, "length", ["doc_id", "piece", "ids_crc32"], sizes, "nth") if order is None else number_in_order(pieces, "length", order, ["piece"], "nth")
    names = pieces.columns

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths, nth = batch["length"].to_numpy(np.int64), batch["nth"].to_numpy(np.int64)
            sequences, offsets = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                first, n, sequence, offset = places[int(length)]
                entry = np.searchsorted(first, nth[at], side="right") - 1
                within = nth[at] - first[entry]
                sequences[at] = sequence[entry] + within // n[entry]
                offsets[at] = offset[entry] + within % n[entry] * length
            yield batch[names].assign(sequence_id=sequences, offset=offsets)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    placed = numbered.mapInPandas(place, f"{fields}, sequence_id long, offset long")
    if order is None:
        return placed
    placed = materialise(placed, "placed")
    bins = placed.groupBy("sequence_id").agg(F.min(F.struct(F.col(order).alias("place"), "piece")).alias("_at")).select(F.lit(0).alias("_all"), F.col("sequence_id").alias("_bin"), "_at.place", "_at.piece")
    ranked = number_in_order(bins, "_all", "place", ["piece"], "_rank").select("_bin", "_rank")
    return placed.join(ranked, placed["sequence_id"] == ranked["_bin"]).select(*[placed[f"`{c}`"] for c in names], F.col("_rank").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, keep_ids: bool = False, order: Column | None = None) -> DataFrame:
    """Tokenise, cut and pack documents (doc_id, text) into sequences of at most `capacity` ids; a row per piece.

    order: the place of a document, unique to its row; sequences follow it as far as the lengths allow.
    """
    pieces = materialise(cut_pieces(docs, vocabulary, capacity, keep_ids, order), "pieces")
    return pack(pieces, capacity) if order is None else pack(pieces, capacity, "place").drop("place")
