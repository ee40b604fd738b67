"""Personal data with offset-preserving deobfuscation."""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_BREAK = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def find_base(text: str) -> list[tuple[int, int, int]]:
    """Spans (start, kind index, end) of identifiers as written, leftmost and non-overlapping per kind."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and not _LOCAL_BREAK.match(text, start - 1):  # every local part ends at this sign
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# Letters of other scripts that look like Latin ones, in code order of their script.
_LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "ο": "o", "ρ": "p", "υ": "u",
    "Ѕ": "S", "І": "I", "Ј": "J", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w",
}
#: Digit words of four languages by the digit.
_DIGIT_WORDS = {
    "0": "zero oh null cero zéro", "1": "one eins uno un", "2": "two zwei dos deux", "3": "three drei tres trois", "4": "four vier cuatro quatre",
    "5": "five fünf cinco cinq", "6": "six sechs seis", "7": "seven sieben siete sept", "8": "eight acht ocho huit", "9": "nine neun nueve neuf",
}
_DIGIT_OF = {word: digit for digit, words in _DIGIT_WORDS.items() for word in words.split()}
_WORD = "(?:" + "|".join(sorted(_DIGIT_OF, key=lambda w: (-len(w), w))) + ")"
_SPELLED = re.compile(rf"(?:\b(?:plus|mas|más)[\s,-]+)?\b{_WORD}(?:(?:\s+(?:dot|point|punto|punkt)\s+|[\s,-]+){_WORD}){{3,}}\b", re.I)
_SPELLED_HINT = re.compile(rf"\b{_WORD}[\s,-]+(?:(?:dot|point|punto|punkt)\s+)?{_WORD}\b")
_TOKEN = re.compile(r"[^\s,-]+")
# Brackets and what is within; the white space around is taken by position, since a pattern would begin at each of its characters.
_BRACKET_AT = re.compile(r"[(\[{<]\s*(?:at|@|arroba|klammeraffe)\s*[)\]}>]", re.I)
_BRACKET_DOT = re.compile(r"[(\[{<]\s*(?:dot|\.|punto|punkt|point)\s*[)\]}>]", re.I)
# A bare "at" counts before a domain whose dot is spelled too, or behind a word that announces an address; a bare dot word
# other than "dot" counts only in a text that has an at word.
_BARE_AT = re.compile(r"(?<=[A-Za-z0-9])\s+(?:at|arroba|klammeraffe)\s+(?=[A-Za-z0-9-]+(?:\s+(?:dot|punto|punkt|point)\s+|\s*[(\[{]\s*(?:dot|punto|punkt|point)\s*[)\]}]\s*)[A-Za-z0-9])", re.I)
_TOLD_AT = re.compile(r"(?:\b(?:e-?mail|mail|contact|reach|correo|courriel)\b[^\n@]{0,40}?\s[A-Za-z0-9._%+-]+)(\s+at\s+)(?=[A-Za-z0-9-]+\.[A-Za-z])|(?<=[A-Za-z0-9])(\s+(?:arroba|klammeraffe)\s+)(?=[A-Za-z0-9-]+\.[A-Za-z])", re.I)
_BARE_DOT = re.compile(r"(?<=[A-Za-z0-9])\s+dot\s+(?=[A-Za-z0-9])", re.I)
_OTHER_DOT = re.compile(r"(?<=[A-Za-z0-9])\s+(?:punto|punkt|point)\s+(?=[A-Za-z0-9])", re.I)
_AT_WORD = re.compile(r"\s(?:at|arroba|klammeraffe)\s")
_TOLD = re.compile(r"\b(?:e-?mail|mail|contact|reach|correo|courriel)\b")
_ODD = re.compile("[ ­ɐ-\U0010ffff]")


def plain_character(c: str) -> str | None:
    """What a disguised character stands for ('' if it is invisible), or None if it stands for itself."""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    code = ord(c)
    if 0xFF01 <= code <= 0xFF5E:
        return chr(code - 0xFEE0)
    if c in "­​‌‍⁠﻿":
        return ""
    if 0x2010 <= code <= 0x2015 or code == 0x2212:
        return "-"
    if c in "․。｡":
        return "."
    if c == "﹫":
        return "@"
    if code == 0xA0 or code >= 0x1680 and unicodedata.category(c) == "Zs":
        return " "
    if code > 0x24F and (digit := unicodedata.digit(c, None)) is not None:
        return str(digit)
    if 0x1D400 <= code <= 0x1D7FF:
        return unicodedata.normalize("NFKC", c)
    return None


class Mapped:
    """A text and, per character, the source span that it stands for; rewrites compose, so offsets survive all of them."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.changed = text, range(len(text)), range(1, len(text) + 1), bytes(len(text))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans of the present text, given in order; all characters of a replacement stand for its whole span."""
        if not edits:
            return
        text, starts, ends, changed, at = [], [], [], bytearray(), 0
        for begin, end, new in edits:
            text += [self.text[at:begin], new]
            starts += [*self.starts[at:begin], *[self.starts[begin]] * len(new)]
            ends += [*self.ends[at:begin], *[self.ends[end - 1]] * len(new)]
            changed += self.changed[at:begin] + b"\x01" * len(new)
            at = end
        self.text, self.starts, self.ends, self.changed = "".join([*text, self.text[at:]]), [*starts, *self.starts[at:]], [*ends, *self.ends[at:]], bytes(changed + self.changed[at:])


def with_space(pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Spans of the matches with the white space around them, in order and apart; linear in the text."""
    out, free = [], 0
    for m in pattern.finditer(text):
        begin, end = m.span()
        while begin > free and text[begin - 1].isspace():
            begin -= 1
        while end < len(text) and text[end].isspace():
            end += 1
        out.append((begin, end))
        free = end
    return out


def _spelled(match: re.Match) -> str:
    words = [w.lower() for w in _TOKEN.findall(match[0])]
    return "".join(_DIGIT_OF.get(w) or ("+" if w in ("plus", "mas", "más") else ".") for w in words)


def find_disguised(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans, in source offsets, that appear only after the transducers: look-alikes, at and dot, then spelled digits.

    A span counts if it holds a rewritten character and no one base span of its kind contains it wholly; a wider one stays
    beside the base span that is a fragment of it.
    """
    odd = not text.isascii() and _ODD.search(text) is not None
    brackets = "(" in text or "[" in text or "{" in text or "<" in text
    low = text.lower()
    at_word = _AT_WORD.search(low) is not None and ("arroba" in low or "klammeraffe" in low or "dot" in low or "punkt" in low or "point" in low or _TOLD.search(low) is not None)
    if not (odd or brackets or "dot" in low or at_word or _SPELLED_HINT.search(low)):
        return []
    mapped = Mapped(text)
    if odd:
        found = ((m.start(), plain_character(m[0])) for m in _ODD.finditer(text))
        mapped.rewrite([(i, i + 1, new) for i, new in found if new is not None])
    mapped.rewrite([(*span, "@") for span in with_space(_BRACKET_AT, mapped.text)])
    mapped.rewrite([(*m.span(), "@") for m in _BARE_AT.finditer(mapped.text)])
    if at_word:
        mapped.rewrite([(*m.span(m.lastindex), "@") for m in _TOLD_AT.finditer(mapped.text)])
    mapped.rewrite([(*m.span(), _spelled(m)) for m in _SPELLED.finditer(mapped.text)])
    mapped.rewrite([(*span, ".") for span in with_space(_BRACKET_DOT, mapped.text)])
    mapped.rewrite([(*m.span(), ".") for m in _BARE_DOT.finditer(mapped.text)])
    if at_word:
        mapped.rewrite([(*m.span(), ".") for m in _OTHER_DOT.finditer(mapped.text)])
    if 1 not in mapped.changed:
        return []
    out = []
    of_kind = [[(s, e) for s, k, e in base if k == kind] for kind in range(len(KINDS))]  # apart and in order
    for begin, kind, end in find_base(mapped.text):
        if mapped.changed.find(1, begin, end) >= 0:
            span = (mapped.starts[begin], kind, mapped.ends[end - 1])
            before = bisect.bisect_right(of_kind[kind], (span[0], len(text) + 1)) - 1
            if before < 0 or of_kind[kind][before][1] < span[2]:
                out.append(span)
    return out


def find_pii(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text: doc_id, spans as array of (kind, start, end, added), in code points.

    added: the span came from the deobfuscation. A null text counts as empty; repeated rows give repeated results;
    other columns are not read. One pass over each text in an Arrow batch, no shuffle; the time is linear in a text,
    long runs of white space, brackets or signs included.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                base = find_base(text or "")
                extra = find_disguised(text or "", base)
                added = set(extra)
                out.append([{"kind": KINDS[k], "start": s, "end": e, "added": (s, k, e) in added} for s, k, e in sorted([*base, *extra])])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "spans": out})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(scan, "doc_id long, spans array<struct<kind:string,start:int,end:int,added:boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans per kind, the hash of the base spans, and all spans as text, from find_pii's result."""
    base = F.filter("spans", lambda s: ~s["added"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of_kind(k) for k in KINDS]
    return found.withColumn("base", base).select("doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
