"""Many phrases in many texts: each text is read once, whatever the number of phrases."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of phrases that one automaton holds at most; some 100 bytes a character in a worker.
SHARD_CHARS = 4_000_000
_built: dict[int, ahocorasick.Automaton] = {}


def automaton(phrases: Iterable[str]) -> ahocorasick.Automaton:
    """Aho-Corasick automaton of phrases; a hit gives the phrase."""
    out = ahocorasick.Automaton()
    for phrase in phrases:
        out.add_word(phrase, phrase)
    out.make_automaton()
    return out


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def count_hits(machine: ahocorasick.Automaton, text: str) -> dict[str, list[int]]:
    """Per phrase within a text: occurrences as whole words, other occurrences, place of the first of all.

    An occurrence is whole if no word goes on beyond either end of it. Occurrences may overlap.
    """
    found: dict[str, list[int]] = {}
    if not len(machine):
        return found
    last = len(text) - 1
    for end, phrase in machine.iter(text):
        start = end - len(phrase) + 1
        cut = (start > 0 and _in_word(text[start]) and _in_word(text[start - 1])) or (end < last and _in_word(text[end]) and _in_word(text[end + 1]))
        counts = found.get(phrase)
        if counts is None:
            counts = found[phrase] = [0, 0, start]
        counts[cut] += 1
        if start < counts[2]:
            counts[2] = start
    return found


def phrase_hits(docs: DataFrame, text: Column, phrases: DataFrame, key: str = "doc_id", shard_chars: int = SHARD_CHARS, as_written: bool = False) -> DataFrame:
    """(key, phrase, whole, within, first): the phrases that each text holds, in any case unless as_written, with numbers of occurrences.

    phrases: a column phrase; nulls, empty ones and repeats do not count. whole: occurrences as whole words, within:
    the others, first: place of the first one, from 0, in the text as it was read (lower-cased unless as_written). A null text holds nothing; repeated rows
    give repeated results.

    The phrases travel as a broadcast of at most shard_chars characters, from which each worker builds one automaton. Of a longer
    list a broadcast of hash bits goes instead: the same single pass finds what may be a phrase, which a join with the list
    confirms. So the cost of the pass does not depend on the number of phrases, no pair of text and phrase is ever formed, and
    no text is shuffled.
    """
    read_as = (lambda c: c) if as_written else F.lower
    read = docs.select(F.col(key).alias("_key"), read_as(text).alias("_text")).where(F.col("_text").isNotNull())
    kind = docs.schema[key].dataType.simpleString()
    schema = f"_key {kind}, phrase string, whole long, within long, first long"
    asked = phrases.select(read_as(F.col("phrase")).alias("phrase")).where("phrase <> ''").distinct()
    sizes = {r["size"]: r["n"] for r in asked.groupBy(F.length("phrase").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(size * n for size, n in sizes.items()) <= shard_chars:
        found = _phrase_pass(read, sorted(r["phrase"] for r in asked.collect()), schema)
    else:
        found = _hashed_pass(read, asked, sizes, schema).join(asked, "phrase", "left_semi").select("_key", "phrase", "whole", "within", "first")
    return found.withColumnRenamed("_key", key)


def shards_of(table: DataFrame, column: str, shard_chars: int = SHARD_CHARS) -> Iterator[list[str]]:
    """The distinct non-empty strings of a column in shards of about shard_chars characters, dealt by hash; at least one."""
    asked = table.select(column).where(F.col(column) != "").distinct()
    size = asked.agg(F.coalesce(F.sum(F.length(column)), F.lit(0)).alias("chars")).first()["chars"]
    shards = max(1, -(-size // shard_chars))
    for i in range(shards):
        part = asked if shards == 1 else asked.where(F.pmod(F.xxhash64(column), F.lit(shards)) == i)
        yield sorted(r[column] for r in part.collect())


def word_lists(docs: DataFrame, spaced: Column, tokens: DataFrame, how: str = "is", key: str = "doc_id", shard_chars: int = SHARD_CHARS, least: int = 0) -> DataFrame:
    """(key, len, terms, tfs), a row per text: its length in words and the words that a token (token) is, begins or is in, by
    `how` (is, begins or in), each with its number of occurrences. A token of under `least` characters stands for itself only.

    spaced: the text's words in lower case with a space between. Tokens travel as in phrase_hits; a worker judges each
    distinct word once and keeps the judgement in a bounded cache. With tokens of several shards keys must be unique.
    """
    read = docs.select(F.col(key).alias("_key"), F.coalesce(spaced, F.lit("")).alias("_text"))
    schema = f"_key {docs.schema[key].dataType.simpleString()}, len long, terms array<string>, tfs array<long>"
    passes = [_word_pass(read, part, how, least, schema) for part in shards_of(tokens, "token", shard_chars)]
    out = passes[0]
    if len(passes) > 1:  # tokens of several shards may select one word
        each = _exploded(reduce(DataFrame.unionByName, passes)).groupBy("_key", "term").agg(F.max("tf").alias("tf"), F.max("len").alias("len"))
        own = F.sort_array(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf"))))
        out = each.groupBy("_key").agg(F.max("len").alias("len"), own.alias("own")).select("_key", "len", F.col("own.term").alias("terms"), F.col("own.tf").alias("tfs"))
    return out.withColumnRenamed("_key", key)


def _exploded(lists: DataFrame, key: str = "_key") -> DataFrame:
    none = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf")))
    held = F.zip_with("terms", "tfs", lambda w, n: F.struct(w.alias("term"), n.alias("tf")))
    return lists.select(key, F.explode(F.concat(none, held)).alias("h"), "len").select(key, "h.term", "h.tf", "len")


def word_matches(docs: DataFrame, spaced: Column, tokens: DataFrame, how: str = "is", key: str = "doc_id", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(key, term, tf, len): word_lists with a row per word. One more row per text, with a null term and tf 0, carries its
    length in words, so that statistics of all texts come from the same pass."""
    return _exploded(word_lists(docs, spaced, tokens, how, key, shard_chars), key)


CACHED_WORDS = 1 << 20


def _word_pass(read: DataFrame, tokens: list[str], how: str, least: int, schema: str) -> DataFrame:
    sent = read.sparkSession.sparkContext.broadcast(json.dumps(tokens))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = set(json.loads(sent.value))
        wide = {t for t in asked if len(t) >= least}
        machine = automaton(wide) if how == "in" and wide else None
        sizes = sorted({len(t) for t in wide})
        fits = {"is": asked.__contains__, "begins": lambda w: w in asked or any(w[:n] in wide for n in sizes if n <= len(w)), "in": lambda w: w in asked or (machine is not None and next(machine.iter(w), None) is not None)}[how]
        judged: dict[str, bool] = {}
        for batch in batches:
            rows = []
            for text in batch["_text"]:
                held = text.split(" ") if text else []
                terms, tfs = [], []
                for word, n in Counter(held).items():
                    good = judged.get(word)
                    if good is None:
                        if len(judged) >= CACHED_WORDS:
                            judged.clear()
                        good = judged[word] = fits(word)
                    if good:
                        terms.append(word)
                        tfs.append(n)
                rows.append((len(held), terms, tfs))
            yield _frame(batch, list(batch["_key"]), rows, ["len", "terms", "tfs"])

    return read.mapInPandas(scan, schema)


def _frame(batch: pd.DataFrame, keys: list, rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    out.insert(0, "_key", pd.Series(keys, dtype=batch["_key"].dtype if keys else object))
    return out


def _phrase_pass(read: DataFrame, phrases: list[str], schema: str) -> DataFrame:
    sent = read.sparkSession.sparkContext.broadcast(json.dumps(phrases))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = hash(sent.value)
        if number not in _built:
            if len(_built) > 1:
                _built.clear()
            _built[number] = automaton(json.loads(sent.value))
        machine = _built[number]
        for batch in batches:
            keys, rows = [], []
            for key, text in zip(batch["_key"], batch["_text"], strict=True):
                for phrase, counts in count_hits(machine, text).items():
                    keys.append(key)
                    rows.append((phrase, *counts))
            yield _frame(batch, keys, rows, ["phrase", "whole", "within", "first"])

    return read.mapInPandas(scan, schema)


#: Bits of the broadcast hashes for each phrase, and of all at most (64 MB); characters that are hashed at once.
BITS_A_PHRASE, MOST_BITS, CHARS_AT_ONCE = 32, 1 << 29, 1 << 20


def _mixed(a: np.ndarray, b: np.ndarray | int = 0, salt: int = 0) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(salt)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _windows(text: str, top: int) -> Iterator[tuple[int, np.ndarray]]:
    """For k up to top: the hashes of all windows of 2^k characters, each from two of half the size."""
    h = _mixed(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64), 0, 1)
    for k in range(top + 1):
        yield k, h
        half = 1 << k
        if len(h) <= half:
            return
        h = _mixed(h[:-half], h[half:], 2)


def _whole(h: np.ndarray, at: np.ndarray, size: int, k: int) -> np.ndarray:
    """Hashes of the pieces of size characters at some places, from the windows of 2^k at their two ends."""
    return _mixed(h[at], h[at + size - (1 << k)], 3 + size)


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    most = np.uint64(64 * len(bits) - 1)
    one, two = h & most, (h >> np.uint64(32)) * np.uint64(0x9E3779B1) & most
    test = lambda at: bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) != 0
    found = test(one)
    found[found] = test(two[found])
    return found


def _bits_of(phrases: list[str], count: int) -> pd.DataFrame:
    """The words and bits of a table of count bits that phrases set: for the window at the beginning of each and for the whole."""
    sizes = np.array([len(p) for p in phrases])
    starts, classes, found = np.cumsum(sizes) - sizes, np.frexp(sizes)[1] - 1, [np.zeros(0, np.uint64)]
    for k, h in _windows("".join(phrases), int(classes.max(initial=0))):
        for size in np.unique(sizes[classes == k]):
            at = starts[sizes == size]
            found += [_mixed(h[at], 0, k), _whole(h, at, int(size), k)]
    h, most = np.concatenate(found), np.uint64(count - 1)
    at = np.unique(np.concatenate([h & most, (h >> np.uint64(32)) * np.uint64(0x9E3779B1) & most]))
    words, first = np.unique(at >> np.uint64(6), return_index=True)
    set_ = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
    return pd.DataFrame({"word": words.astype(np.int64), "bits": set_.view(np.int64)})


def _pieces(text: str, sizes: dict[int, list[int]], bits: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Places of pieces of a size whose hashes are set, for each size (by class k) in turn."""
    for k, h in _windows(text, max(sizes)):
        if k in sizes:
            at = np.flatnonzero(_has(bits, _mixed(h, 0, k)))
            for size in sizes[k]:
                fit = at[at + size <= len(text)]
                yield fit[_has(bits, _whole(h, fit, size, k))], size


def _hashed_pass(read: DataFrame, asked: DataFrame, sizes: dict[int, int], schema: str) -> DataFrame:
    """The rows of _phrase_pass for any number of phrases, and some for pieces that only share the hash bits of phrases."""
    spark, most = read.sparkSession, max(BITS_A_PHRASE * sum(sizes.values()), 1 << 16)
    count = min(1 << (most - 1).bit_length(), MOST_BITS)

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _bits_of(list(batch["phrase"]), count)

    set_ = asked.mapInPandas(marked, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(count // 64, np.uint64)
    table[set_["word"].to_numpy()] = set_["bits"].to_numpy().view(np.uint64)
    sent = spark.sparkContext.broadcast(table.tobytes())
    by_class: dict[int, list[int]] = {}
    for size in sorted(sizes):
        by_class.setdefault(size.bit_length() - 1, []).append(size)

    def found(texts: list[str], bits: np.ndarray) -> dict[tuple[int, str], list[int]]:
        """Of texts that lie one behind the other: counts by text and piece."""
        joined, ends = "".join(texts), np.cumsum([len(t) for t in texts])
        counts: dict[tuple[int, str], list[int]] = {}
        for places, size in _pieces(joined, by_class, bits):
            of = np.searchsorted(ends, places, "right")
            own = places + size <= ends[of]  # not beyond the end of its text
            for at, n in zip(places[own].tolist(), of[own].tolist(), strict=True):
                text, start = texts[n], at - int(ends[n]) + len(texts[n])
                end = start + size - 1
                cut = (start > 0 and _in_word(text[start]) and _in_word(text[start - 1])) or (end < len(text) - 1 and _in_word(text[end]) and _in_word(text[end + 1]))
                held = counts.setdefault((n, text[start : end + 1]), [0, 0, start])
                held[cut] += 1
                held[2] = min(held[2], start)
        return counts

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.frombuffer(sent.value, np.uint64)
        for batch in batches:
            texts, own = list(batch["_text"]), list(batch["_key"])
            first, chars = 0, 0
            for i, text in enumerate(texts):
                chars += len(text)
                if chars >= CHARS_AT_ONCE or i == len(texts) - 1:
                    counts = found(texts[first : i + 1], bits) if chars else {}
                    yield _frame(batch, [own[first + n] for n, _ in counts], [(piece, *c) for (_, piece), c in counts.items()], ["phrase", "whole", "within", "first"])
                    first, chars = i + 1, 0

    return read.mapInPandas(scan, schema)
