"""Column functions on names and texts: fingerprints, dates, maturity, slugs, vectors."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable
from functools import reduce
from itertools import repeat
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """Lower-cased words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


# Fingerprints -----------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\w+")
_ROWS = 1 << 17
_row_of: dict[str | int, int] = {}
_votes = np.zeros((0, 64), np.float32)


def _rows(tokens: list, spelled: Callable[[Any], str] = str) -> np.ndarray:
    """Rows of the worker's table of votes (+1 or -1 for each hash bit) for distinct tokens; the table starts anew when full."""
    global _votes
    if not len(_votes):
        _votes = np.zeros((_ROWS, 64), np.float32)
    if len(_row_of) + len(tokens) > len(_votes):
        _row_of.clear()
        if len(tokens) > len(_votes):
            _votes = np.zeros((2 * len(tokens), 64), np.float32)
    rows = np.fromiter(map(_row_of.get, tokens, repeat(-1)), np.int64, len(tokens))
    at = np.flatnonzero(rows < 0)
    if len(at):
        new, first = [tokens[i] for i in at], len(_row_of)
        raw = np.frombuffer(b"".join(hashlib.md5(spelled(t).encode()).digest()[:8] for t in new), np.uint8).reshape(-1, 8)
        rows[at] = np.arange(first, first + len(new))
        _votes[first : first + len(new)] = 2.0 * np.unpackbits(raw, axis=1) - 1
        _row_of.update(zip(new, rows[at].tolist(), strict=True))
    return rows


def _cast(tokens: list, counts: np.ndarray, spelled: Callable[[Any], str] = str) -> np.ndarray:
    """The 64 sums of votes of distinct tokens; single precision holds them where they stay below 2^24."""
    rows = _rows(tokens, spelled)
    return counts.astype(np.float32 if counts.sum() < 1 << 24 else np.float64) @ _votes[rows]


#: Bits of a code point; three fill a positive long.
_POINT = 21


def _letters(gram: int) -> str:
    return chr(gram >> 2 * _POINT) + chr(gram >> _POINT & (1 << _POINT) - 1) + chr(gram & (1 << _POINT) - 1)


def simhash_of(text: str | None, n: int = 3) -> int:
    """64-bit SimHash over words and character n-grams of the text without separators; 0 for a text without words.

    A token's hash is the first 8 bytes of its MD5; every occurrence votes on every bit and a bit needs a majority. Three
    letters are counted as one number, as arrays.
    """
    held = _TOKEN.findall((text or "").lower())
    if not held:
        return 0
    counts, compact = Counter(held), "".join(held)
    if n != 3:
        counts.update(map("".join, zip(*(compact[i:] for i in range(n)))))
    votes = _cast(list(counts), np.fromiter(counts.values(), np.int64, len(counts)))
    if n == 3 and len(compact) > 2:
        points = np.frombuffer(compact.encode("utf-32-le"), np.uint32).astype(np.int64)
        grams, times = np.unique(points[:-2] << 2 * _POINT | points[1:-1] << _POINT | points[2:], return_counts=True)
        votes = votes.astype(np.float64) + _cast(grams.tolist(), times, _letters)
    return int(np.packbits(votes > 0).view(">i8")[0])


@F.pandas_udf(T.LongType())  # workers import this module without a session, so the type is no DDL string
def simhash(texts: pd.Series) -> pd.Series:
    """SimHash as a signed long; 64 counters a text would shuffle every shingle if exploded, so it is an Arrow UDF."""
    return texts.map(simhash_of).astype("int64")


simhash = simhash.asNondeterministic()  # it is not, but a filter on its result must not make it run a second time


def simhash_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(distance: Column) -> Column:
    return F.round(1 - distance / 64.0, 4)


# Names ------------------------------------------------------------------------------------------------------------


def slug(kind: Column, name: Column) -> Column:
    """Node id: lower-cased name without punctuation, spaces and hyphens as underscores, with the kind as its prefix."""
    body = F.regexp_replace(F.regexp_replace(F.trim(F.lower(name)), r"[^\p{L}\p{N}_\s-]", ""), r"[\s-]+", "_")
    prefix = F.concat(kind, F.lit("_"))
    return F.when(body.startswith(prefix), body).otherwise(F.concat(prefix, body))


def name_tokens(name: Column) -> Column:
    """Lower-cased parts of a file name, also cut inside CamelCase and between letters and digits."""
    cut = F.regexp_replace(F.regexp_replace(name, r"([a-z])([A-Z])", "$1 $2"), r"([A-Za-z])([0-9])", "$1 $2")
    return F.filter(F.split(F.lower(cut), r"[^a-z0-9]+"), lambda w: F.length(w) > 0)


#: Small words inside names of persons, titles that are no part of a name.
PARTICLES = ["de", "del", "della", "der", "den", "di", "da", "du", "la", "le", "van", "von", "zu", "y", "e"]
TITLES = ["mr", "mrs", "ms", "dr", "prof", "herr", "frau", "monsieur", "madame", "sir"]


def looks_like_person(name: Column) -> Column:
    """Two to six capitalised words without digits; particles may be small, and a title makes it no plain name."""
    parts = F.filter(F.split(F.trim(name), r"\s+"), lambda p: p != "")
    bare = F.transform(parts, lambda p: F.regexp_replace(F.lower(p), r"\.$", ""))
    own = F.filter(parts, lambda p: ~F.lower(p).isin(PARTICLES))
    return F.size(parts).between(2, 6) & (F.size(own) >= 2) & ~F.arrays_overlap(bare, F.array(*[F.lit(t) for t in TITLES])) & F.forall(own, lambda p: p.rlike(r"^\p{Lu}[\p{L}'.-]*$"))


def is_clean_party(name: Column, places: list[str], blacklist: tuple[str, ...] = ()) -> Column:
    """A party's name has 3 to 55 characters, no line break or tab, no punctuation at an edge, and is no place or listed word."""
    low = F.lower(F.trim(name))
    return F.length(name).between(3, 55) & ~name.rlike(r"[\n\r\t]") & ~name.rlike(r"^[.,;:!?-]|[,;:!?-]$") & ~low.isin([p.lower() for p in (*places, *blacklist)])


def is_entity_name(name: Column, bad_starts: tuple[str, ...] = ("the", "a", "an", "and", "der", "die", "das", "le", "la", "les", "und", "et")) -> Column:
    """A name worth showing: 3 to 60 characters with a capital letter, no sentence marks inside, not begun by an article or conjunction."""
    first = F.lower(F.regexp_extract(name, r"^(\S+)", 1))
    return F.length(name).between(3, 60) & name.rlike(r"\p{Lu}") & ~name.rlike(r"[!?;:|<>{}]|\.\s") & ~first.isin(list(bad_starts))


def excerpt(text: Column, word: Column, before: int = 60, after: int = 80) -> Column:
    """Text around the first hit of a word, null without one."""
    at = F.instr(F.lower(text), F.lower(word))
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substring(text, start, at - start + F.length(word) + after))


# Dates ------------------------------------------------------------------------------------------------------------

_DAY, _MONTH, _YEAR = "(0[1-9]|[12][0-9]|3[01])", "(0[1-9]|1[0-2])", "(19[0-9]{2}|20[0-9]{2})"
_SHORT = "(20[0-9]{2}|19[0-9]{2}|[0-9]{2})"
#: (pattern, groups of year, month, day; 0 stands for 01) in order of trust.
NAME_PREFIX = (
    (rf"^{_DAY}[-_.]{_MONTH}[-_.]{_SHORT}(?:[-_\s.]|$)", (3, 2, 1)),
    (rf"^{_YEAR}[-_.]?{_MONTH}[-_.]?{_DAY}(?:[-_\s.]|$)", (1, 2, 3)),
    (rf"^{_DAY}{_MONTH}{_YEAR}(?:[-_\s.]|$)", (3, 2, 1)),
    (rf"^{_YEAR}[-_.]", (1, 0, 0)),
)
IN_TEXT = ((rf"\b{_YEAR}[-/.]{_MONTH}[-/.]{_DAY}\b", (1, 2, 3)), (rf"\b{_DAY}[-/.]{_MONTH}[-/.]{_YEAR}\b", (3, 2, 1)))
IN_NAME = ((rf"(?:^|[\s_.-]){_YEAR}[-_.]?{_MONTH}[-_.]?{_DAY}(?:[\s_.-]|$)", (1, 2, 3)), (rf"(?:^|[\s_.-]){_DAY}[-_.]{_MONTH}[-_.]{_SHORT}(?:[\s_.-]|$)", (3, 2, 1)))


def _dated(source: Column, pattern: str, groups: tuple[int, int, int]) -> Column:
    part = lambda g: F.regexp_extract(source, pattern, g) if g else F.lit("01")
    year = part(groups[0])
    year = F.when(F.length(year) == 2, F.concat(F.when(year > "70", "19").otherwise("20"), year)).otherwise(year)
    return F.try_to_date(F.concat_ws("-", year, part(groups[1]), part(groups[2])), "yyyy-MM-dd")


def document_date(name: Column, text: Column, mtime: Column) -> Column:
    """struct(date, source) from the name's start, the first 4000 characters, anywhere in the name, then the file time.

    A date that does not exist counts as none, so the next source is tried.
    """
    name, head = F.trim(name), F.substring(text, 1, 4000)
    sources = [(name, p, g, "filename_prefix") for p, g in NAME_PREFIX] + [(head, p, g, "content") for p, g in IN_TEXT] + [(name, p, g, "filename") for p, g in IN_NAME]
    found = [F.when(_dated(c, p, g).isNotNull(), F.struct(_dated(c, p, g).alias("date"), F.lit(s).alias("source"))) for c, p, g, s in sources]
    by_time = F.when(mtime.isNotNull(), F.struct(F.to_date(mtime).alias("date"), F.lit("mtime").alias("source")))
    return F.coalesce(*found, by_time, F.struct(F.lit(None).cast("date").alias("date"), F.lit("unknown").alias("source")))


# Maturity ---------------------------------------------------------------------------------------------------------

# Marks of a document's end, of truncation, of signatures, and weights of the score.
END_MARKS = ["unterschrift", "unterzeichnet", r"gez\.", "signature", "signé", "sincerely", "cordialement", "mit freundlichen grüssen", "hochachtungsvoll", "fait à", "ort, datum", "conclusion", r"seite [0-9]+ von [0-9]+", r"page [0-9]+ of [0-9]+"]
CUT_MARKS = [r"\.{4,}", r"\[cut\]", r"\[truncated\]", r"\[suite au prochain\]", "scan error", "unvollständig"]
STAMPS = ["digital signiert", "digitally signed", "elektronische signatur", "beglaubigt", "notar", "notariell", "apostille", "amtlicher stempel", "sceau", "legalisé", "certifié conforme", "qualifizierte elektronische"]
WEAK_SIGNATURE = "unterschrift|signature|gez\\.|signé"
WEIGHTS = {"completeness": 0.35, "signature": 0.25, "date": 0.20, "naming": 0.20}


#: A text holds a run of four or more dots where it holds four.
_AS_TEXT = {r"\.{4,}": "...."}


def _holds(text: Column, pattern: str) -> Column:
    """Whether a pattern occurs in a text; one that stands for itself is looked for as a text, which costs far less."""
    if pattern in _AS_TEXT or re.fullmatch(r"(?:[^\\.\[\]{}()*+?^$|]|\\[.\[\]])*", pattern):
        return text.contains(_AS_TEXT.get(pattern, re.sub(r"\\(.)", r"\1", pattern)))
    return text.rlike(pattern)


def _any(text: Column, patterns: list[str]) -> Column:
    return reduce(Column.__or__, [_holds(text, p) for p in patterns])


def _hits(text: Column, patterns: list[str]) -> Column:
    total = F.lit(0)
    for p in patterns:
        total = total + _holds(text, p).cast("int")
    return total


def _tail(text: Column, n: int) -> Column:
    return F.substring(text, F.greatest(F.lit(1), F.length(text) - n + 1), F.lit(n))


def _unit(value: Column, places: int = 2) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), places)


def is_truncated(text: Column, low: Column | None = None) -> Column:
    return (F.length(F.trim(F.coalesce(text, F.lit("")))) < 50) | _any(F.lower(text) if low is None else low, CUT_MARKS)


def completeness(text: Column, pages: Column, low: Column | None = None, end: Column | None = None) -> Column:
    """low and end (its last 1500 characters or more), here and below, are the lower-cased text where it is at hand as a column:
    a branch of a case works out such a part anew for each mark."""
    low = F.lower(text) if low is None else low
    score = 0.5 + F.least(F.lit(0.35), 0.15 * _hits(_tail(low, 1500) if end is None else end, END_MARKS)) - 0.4 * _any(low, CUT_MARKS).cast("int") + 0.15 * (pages > 1).cast("int")
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) < 50, F.lit(0.1)).otherwise(_unit(score))


def signature_score(text: Column, digital: Column, low: Column | None = None, end: Column | None = None) -> Column:
    low = F.coalesce(F.lower(text) if low is None else low, F.lit(""))
    last = _tail(low if end is None else F.coalesce(end, F.lit("")), 1000)
    stamps = _hits(low, STAMPS)
    return F.when(digital, F.lit(1.0)).when(stamps > 0, _unit(F.least(F.lit(0.9), 0.45 * stamps))).when(_any(last, WEAK_SIGNATURE.split("|")), F.lit(0.4)).otherwise(F.lit(0.0))


_NAME_RULES = (("final|def|definitive|signed|signe|unterschrieben", 0.9, "final"), (r"v[0-9]+(\.[0-9]+)?|rev[0-9]+", 0.7, None), ("draft|brouillon|entwurf|temp|tmp|wip", 0.15, "draft"), ("part|partial|tronque|truncated|copy|copie", 0.2, "partial"))


def naming(name: Column) -> tuple[Column, Column]:
    """(score, version tag) of a file name; the first rule that holds decides."""
    low, score, tag = F.lower(name), F.lit(None).cast("double"), F.lit(None).cast("string")
    for words_, value, label in reversed(_NAME_RULES):
        hit = low.rlike(rf"(_|\b)({words_})(\.|\b)")
        score = F.when(hit, F.lit(value)).otherwise(score)
        tag = F.when(hit, F.lit(label) if label else F.regexp_extract(low, rf"({words_})", 1)).otherwise(tag)
    return F.coalesce(score, F.lit(0.5)), tag


def date_score(name: Column, text: Column, created: Column) -> Column:
    in_name = rf"(20[0-9]{{2}})[-_.]?{_MONTH}[-_.]?{_DAY}"
    in_text = rf"\b(20[0-9]{{2}})[-/.]{_MONTH}[-/.]{_DAY}\b"
    return F.when(F.lower(name).rlike(in_name), 0.8).when(created.isNotNull(), 0.7).when(F.substring(text, 1, 2000).rlike(in_text), 0.6).otherwise(0.4)


def lifecycle(name: Column, maturity: Column, naming_score: Column, signature: Column, truncated: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(truncated | low.contains("partial") | low.contains("tronque"), "truncated")
        .when((naming_score >= 0.8) | (signature >= 0.8) | (maturity >= 0.75), "final")
        .when((naming_score <= 0.3) | low.contains("draft") | low.contains("entwurf") | (maturity < 0.4), "draft")
        .otherwise("review")
    )


def with_maturity(df, name: str = "filename", text: str = "text", pages: Column | None = None, digital: Column | None = None, created: Column | None = None):
    """Add completeness, signature, naming, version_tag, date_score, maturity, truncated and lifecycle columns."""
    n, t = F.col(name), F.col(text)
    score, tag = naming(n)
    low, end = F.col("_low"), F.col("_end")
    out = df.withColumn("_low", F.lower(t)).withColumn("_end", _tail(low, 1500)).withColumns({"completeness": completeness(t, pages if pages is not None else F.lit(1), low, end), "signature": signature_score(t, digital if digital is not None else F.lit(False), low, end), "naming": score, "version_tag": tag, "date_score": date_score(n, t, created if created is not None else F.lit(None)), "truncated": is_truncated(t, low)}).drop("_low", "_end")
    weighted = sum((F.col({"date": "date_score"}.get(k, k)) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    out = out.withColumn("maturity", _unit(weighted, 4))
    return out.withColumn("lifecycle", lifecycle(n, F.col("maturity"), F.col("naming"), F.col("signature"), F.col("truncated")))


# Vectors ----------------------------------------------------------------------------------------------------------


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 if the lengths differ or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


class _Hashes(dict):
    """The worker's first 32 bits of the SHA-256 of words; it starts anew when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        got = self[word] = int.from_bytes(hashlib.sha256(word.encode()).digest()[:4], "big")
        return got


_hashes = _Hashes()


def hashed_vector(spaced: str | None, dim: int) -> np.ndarray | None:
    """hashed_embedding of words with a space between; sums run in the order of the words."""
    if spaced is None:
        return None
    held = spaced.split(" ") if spaced else []
    at = np.fromiter(map(_hashes.__getitem__, held), np.int64, len(held)) % dim
    raw = np.bincount(at, 1 / (1 + 0.05 * np.arange(len(held))), dim)
    norm = np.sqrt(np.cumsum(raw * raw)[-1])
    return raw / norm if norm else raw


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _hashed_vectors(spaced: pd.Series, dims: pd.Series) -> pd.Series:
    return pd.Series([hashed_vector(t, d) for t, d in zip(spaced, dims, strict=True)], dtype=object)


_hashed_vectors = _hashed_vectors.asNondeterministic()  # it is not, but a filter on its result must not make it run a second time


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """Deterministic vector of a text: each word adds 1 / (1 + 0.05 * position) at a hashed place; unit length, null for null.

    An Arrow UDF: a vector as a column expression looks through all words once for each of its places.
    """
    return _hashed_vectors(F.array_join(words(text), " "), F.lit(dim))
