"""Statutes in XML: articles with the headings above them, read event by event."""

from __future__ import annotations

import re
import xml.sax
from collections.abc import Iterator
from xml.sax.handler import ContentHandler

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.files import code_and_language

#: Elements above an article whose headings are its own heading, chapter and part, if it lies in them.
LEVELS = {"level": "heading", "marginalNote": "heading", "chapter": "chapter", "subdivision": "chapter", "title": "part", "part": "part"}
FEED_BYTES = 1 << 16
ROWS = "path string, n int, number string, heading string, chapter string, part string, paragraphs array<string>, doc_title string, error string"
_SPACE = re.compile(r"\s+")


class _Walk(ContentHandler):
    """Keeps a stack of open elements with their headings and the article that is open, and nothing else."""

    def __init__(self) -> None:
        super().__init__()
        self.done: list[dict] = []
        self.title = ""
        self._open: list[list[str]] = []  # name and heading
        self._article: dict | None = None
        self._texts: list[tuple[str, list[str]]] = []  # elements whose text is being read: heading, num, p, docTitle
        self._n = 0

    def startElement(self, name: str, attrs) -> None:
        name = name.rpartition(":")[2]
        self._open.append([name, ""])
        if name == "article" and self._article is None:
            above: dict[str, str] = {}
            for tag, heading in reversed(self._open[:-1]):  # the nearest heading of each kind
                if heading and tag in LEVELS:
                    above.setdefault(LEVELS[tag], heading)
            self._article = {"number": None, "own": "", "depth": len(self._open), "paragraphs": [], **{k: above.get(k, "") for k in ("heading", "chapter", "part")}}
        if name in ("heading", "num", "p", "docTitle"):
            self._texts.append((name, []))

    def characters(self, content: str) -> None:
        for _, text in self._texts:
            text.append(content)

    def endElement(self, name: str) -> None:
        name = name.rpartition(":")[2]
        self._open.pop()
        if name in ("heading", "num", "p", "docTitle"):
            text = "".join(self._texts.pop()[1]).strip()
            own, depth = self._article, len(self._open)
            if name == "p" and own is not None and text:
                own["paragraphs"].append(text)
            elif name == "docTitle":
                self.title = self.title or text
            elif own is not None and depth == own["depth"]:  # a child of the article itself
                if name == "num" and own["number"] is None:
                    own["number"] = text
                elif name == "heading" and not own["own"]:
                    own["own"] = text
            elif name == "heading" and self._open and not self._open[-1][1]:
                self._open[-1][1] = text
        elif name == "article" and self._article is not None and len(self._open) == self._article["depth"] - 1:
            own, self._article = self._article, None
            if own["paragraphs"]:
                number = own["number"] if own["number"] is not None else f"Art. {self._n + 1}"
                self.done.append({"n": self._n, "number": _SPACE.sub(" ", number), "heading": own["own"] or own["heading"], "chapter": own["chapter"], "part": own["part"], "paragraphs": own["paragraphs"], "doc_title": self.title})
            self._n += 1


def walk(content: bytes) -> Iterator[dict]:
    """Articles of one file as they end; what was read before a fault in the XML comes out, then the fault."""
    handler = _Walk()
    parser = xml.sax.make_parser()
    parser.setFeature(xml.sax.handler.feature_external_ges, False)
    parser.setContentHandler(handler)
    try:
        for start in range(0, len(content), FEED_BYTES):
            parser.feed(content[start : start + FEED_BYTES])
            yield from handler.done
            handler.done.clear()
        parser.close()
    except xml.sax.SAXException as fault:
        yield from handler.done
        yield {"error": str(fault)}


def article_rows(files: DataFrame) -> DataFrame:
    """ROWS of the articles of statutes (path, content): place, number, headings above, paragraphs; a file that is no XML
    gives a row with its error.

    An article's heading is its own, else that of the nearest level above it; chapter and part are the nearest headings
    of those elements. A heading counts for what follows it. Articles without a paragraph are numbered and left out. A
    file is walked event by event, so memory holds the open elements and one article beside its bytes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "n", "number", "heading", "chapter", "part", "paragraphs", "doc_title", "error"]
        for batch in batches:
            rows: list[dict] = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for row in walk(b"" if content is None else bytes(content)):
                    rows.append({"path": path, **row})
                    if len(rows) == 1000:
                        yield _frame(rows, columns)
                        rows = []
            yield _frame(rows, columns)

    return files.select("path", "content").mapInPandas(run, ROWS)


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame([{c: r.get(c) for c in columns} for r in rows], columns=columns)
    return out.astype({"n": "Int32"}).astype(object).where(lambda df: df.notna(), None) if len(out) else out


def statutes(files: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Articles with code and language of their file, binding key, title and passage text.

    catalogue: code, lang, title, short (short title or null). A statute that it lacks takes its own title, else "SR code".
    Columns: path, n, code, lang, number, binding_key, title, short, heading, chapter, part, paragraphs, passage.
    """
    cl = code_and_language(F.col("path"))
    rows = article_rows(files).where("error is null").withColumn("code", F.coalesce(cl["code"], F.lit("UNKNOWN"))).withColumn("lang", cl["lang"])
    known = catalogue.select(F.col("code").alias("_code"), F.col("lang").alias("_lang"), F.col("title").alias("_title"), "short")
    named = rows.join(known, (F.col("code") == F.col("_code")) & (F.col("lang") == F.col("_lang")), "left")
    title = F.coalesce("_title", F.when(F.col("doc_title") != "", F.col("doc_title")), F.concat(F.lit("SR "), "code"))
    label = F.concat(F.lit(" ("), F.when(F.col("short").isNotNull(), F.concat("short", F.lit(" "))).otherwise(""), F.lit("SR "), "code", F.lit(")"))
    heading = F.when(F.col("heading") != "", F.concat(F.lit(" — "), "heading")).otherwise("")
    passage = F.concat(F.lit("passage: "), title, label, F.lit(", "), "number", heading, F.lit(": "), F.array_join("paragraphs", " "))
    return named.select("path", "n", "code", "lang", "number", F.concat_ws("_", "code", "number").alias("binding_key"), title.alias("title"), "short", "heading", "chapter", "part", "paragraphs", passage.alias("passage"))
