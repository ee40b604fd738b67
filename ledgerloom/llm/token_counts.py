"""Token counts by a two-tier lookup of pre-token lengths on the map side."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import without
from ledgerloom.llm.packing import VOCABULARY

FREQUENT = 1 << 16
SAMPLE_DOCS = 4096
CACHE = 1 << 18
KEY_CHARS = 64
LAZY_CHARS = 1 << 20
LIMIT = 512
ADDED = ["n_bytes", "n_tokens", "over_limit"]


class PreTokens:
    """The pre-tokens of texts as a JSON vocabulary of public_tokenizers makes them, found by a pattern.

    A pre-token is encoded by itself, whatever surrounds it, so a text's tokens are the sum over its pre-tokens. Special
    strings are cut out first, as the library does by default. The pattern's Unicode tables may be newer than the
    library's: a character is asked about once per worker, and a text with one on which the two part ways goes to the
    library whole.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        self._find = regex.compile(public_tokenizers.PATTERN)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self._cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self._agreed: set[str] = set()
        self._parted: set[str] = set()

    def encoded_length(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def agrees(self, text: str) -> bool:
        if text.isascii():
            return True
        found = set(text)
        for c in found - self._agreed - self._parted:
            probe = f"a{c}b 1{c}2 .{c}! {c}{c} x"
            theirs = [probe[i:j] for _, (i, j) in self.library.pre_tokenizer.pre_tokenize_str(probe)]
            (self._agreed if theirs == self._find.findall(probe) else self._parted).add(c)
        return found.isdisjoint(self._parted)

    def of(self, text: str) -> tuple[Iterable[str], int]:
        """The pre-tokens of a text, in order, and the number of special strings; a very long text's come one by one."""
        parts = self._cut.split(text) if self._cut is not None else [text]
        if len(text) > LAZY_CHARS:
            found = chain.from_iterable(map(itemgetter(0), self._find.finditer(p)) for p in parts)
        else:
            found = chain.from_iterable(map(self._find.findall, parts)) if len(parts) > 1 else self._find.findall(text)
        return found, len(parts) - 1


class CompactTable:
    """A hash table of short strings and small counts in four flat arrays: open addressing over hashes of the keys.

    Its size is at most n * (4 * KEY_CHARS + 15) bytes for n keys, whatever the corpus, so it may be broadcast.
    """

    def __init__(self, lengths: dict[str, int]):
        keys = sorted(lengths)
        raw = [k.encode() for k in keys]
        self.blob = b"".join(raw)
        self.ends = np.cumsum([len(r) for r in raw], dtype=np.uint32)
        self.lengths = np.array([lengths[k] for k in keys], np.uint16)
        self.slots = np.zeros(1 << max(1, (2 * len(keys)).bit_length()), np.uint32)  # place in the arrays + 1; 0 is free
        for i, r in enumerate(raw):
            at = self._slot(r)
            while self.slots[at]:
                at = (at + 1) % len(self.slots)
            self.slots[at] = i + 1

    def _slot(self, key: bytes) -> int:
        h = 0xCBF29CE484222325
        for byte in key:
            h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return (h ^ h >> 32) % len(self.slots)

    def key(self, i: int) -> bytes:
        return self.blob[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])]

    def get(self, key: str) -> int | None:
        raw = key.encode()
        at = self._slot(raw)
        while place := int(self.slots[at]):
            if self.key(place - 1) == raw:
                return int(self.lengths[place - 1])
            at = (at + 1) % len(self.slots)
        return None

    def __len__(self) -> int:
        return len(self.ends)

    @property
    def nbytes(self) -> int:
        return len(self.blob) + self.ends.nbytes + self.lengths.nbytes + self.slots.nbytes


class CachedLengths(dict):
    """A worker's cache of pre-token lengths: a key it lacks is looked up in the broadcast table, then encoded.

    Both answers stay in the cache, so the table's probing and the encoder run once per pre-token and worker. A full
    cache starts anew; keys of more than KEY_CHARS characters are encoded each time and never kept.
    """

    def __init__(self, table: CompactTable, encode: Callable[[str], int], limit: int):
        super().__init__()
        self._table, self._encode, self._limit = table, encode, max(1, limit)

    def __missing__(self, key: str) -> int:
        if len(key) > KEY_CHARS:
            return self._encode(key)
        n = self._table.get(key)
        if n is None:
            n = self._encode(key)
        if len(self) >= self._limit:
            self.clear()
        self[key] = n
        return n


_workers: dict[str, PreTokens] = {}


def pre_tokens(vocabulary: str) -> PreTokens:
    """The pre-tokeniser of a vocabulary, kept for the life of the worker."""
    if vocabulary not in _workers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _workers[vocabulary] = PreTokens(vocabulary)
    return _workers[vocabulary]


def text_length(text: str, splitter: PreTokens, lengths: dict[str, int]) -> int:
    """Tokens of one text: the sum over its pre-tokens, and one for each special string."""
    if not splitter.agrees(text):
        return splitter.encoded_length(text)
    found, specials = splitter.of(text)
    return sum(map(lengths.__getitem__, found)) + specials


def frequent_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, frequent: int = FREQUENT, sample_docs: int = SAMPLE_DOCS) -> CompactTable:
    """Lengths of the pre-tokens that are most frequent in a sample of at most sample_docs whole texts, spread by hash.

    The sample decides only which lengths every worker has from the start; a pre-token outside it costs a worker one
    encoding, and no count depends on it. One task counts the sample, with at most 4 * frequent keys in memory, and the
    driver sees at most `frequent` short strings.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    every = max(1, docs.count() // max(1, sample_docs))
    sampled = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).limit(sample_docs)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter, seen = pre_tokens(vocabulary), Counter()
        for batch in batches:
            for text in batch["text"]:
                for key in splitter.of(text)[0]:
                    if len(key) <= KEY_CHARS:
                        seen[key] += 1
                        if len(seen) > 4 * frequent:
                            seen = Counter(dict(seen.most_common(frequent)))
        yield pd.DataFrame({"key": [k for k, _ in seen.most_common(frequent)]}, dtype=object)

    splitter = pre_tokens(vocabulary)
    keys = [r["key"] for r in sampled.mapInPandas(count, "key string").limit(frequent).collect()]
    return CompactTable({k: n for k, e in zip(keys, splitter.library.encode_batch(keys, add_special_tokens=False), strict=True) if (n := len(e.ids)) < 1 << 16})


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, frequent: int = FREQUENT, sample_docs: int = SAMPLE_DOCS, cache: int = CACHE) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens (long) and over_limit (n_tokens > limit) of every whole text.

    Counts equal the library's for the JSON vocabulary: no begin, end or added tokens, special strings as its default
    (one token), no truncation. A null text counts as empty: 0 bytes, 0 tokens, not over the limit. Every row is a
    document of its own, so repeated rows give repeated counts; an empty table stays empty; input columns named like
    the added ones give way, all others stay.

    No shuffle: a text stays in its task, and only the text column goes to Python. Lengths of frequent pre-tokens are
    broadcast as one compact table of bounded size; a miss is encoded once per worker and kept in its bounded cache. A
    text of any length is walked pre-token by pre-token, so memory does not grow with it beyond the text itself.
    """
    docs = without(docs, ADDED)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, vocabulary, frequent, sample_docs))

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        splitter = pre_tokens(vocabulary)
        lengths = CachedLengths(table.value, splitter.encoded_length, cache)
        for texts in batches:
            yield pd.Series([text_length(t, splitter, lengths) for t in texts], dtype="int64")

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = docs.withColumn("n_bytes", F.octet_length(text).cast("long")).withColumn("n_tokens", tokens(text))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
