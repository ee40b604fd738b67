"""File scans and document extraction."""

from __future__ import annotations

import email
import email.policy
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from functools import reduce
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("docx", "txt", "md", "eml", "xml")
IGNORED = (r"/~\$", r"\.tmp$", r"\.lock$", r"/\.")
EXTRACT_SCHEMA = "path string, text string, metadata map<string,string>, extraction_error string"


def wanted(path: Column, extensions: tuple[str, ...] = EXTENSIONS, ignored: tuple[str, ...] = IGNORED) -> Column:
    return F.lower(path).rlike(rf"\.({'|'.join(extensions)})$") & ~path.rlike("|".join(ignored))


def scan(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """Files below several roots: root, path, mtime, size, content; content is only read if it is used."""
    parts = [spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p).select(F.lit(n).alias("root"), "path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content") for n, p in roots.items()]
    return reduce(DataFrame.unionByName, parts).where(wanted(F.col("path")))


def is_raw_scan(path: Column) -> Column:
    """A scanner's own file name, which is held back until it is renamed or old."""
    return F.lower(F.element_at(F.split(path, "/"), -1)).rlike(r"^(scan|img|doc)[-_ ]?[0-9]{3,}.*$")


def released(files: DataFrame, now: Column, grace_hours: int = 96) -> DataFrame:
    return files.where(~is_raw_scan(F.col("path")) | (F.col("mtime") <= now - F.make_interval(hours=F.lit(grace_hours))))


def _docx(data: bytes) -> tuple[str, dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p")), {}


def _eml(data: bytes) -> tuple[str, dict]:
    mail = email.message_from_bytes(data, policy=email.policy.default)
    body = mail.get_body(("plain", "html"))
    return (body.get_content() if body else ""), {k: str(mail[k]) for k in ("subject", "from", "to", "date") if mail[k]}


def _xml(data: bytes) -> tuple[str, dict]:
    root = ET.fromstring(data)
    return re.sub(r"\s+", " ", " ".join(root.itertext())).strip(), {"root": root.tag.rpartition("}")[2]}


def _text(data: bytes) -> tuple[str, dict]:
    try:
        return data.decode("utf-8-sig"), {"encoding": "utf-8"}
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace"), {"encoding": "cp1252"}


_READERS = {"docx": _docx, "eml": _eml, "xml": _xml}


def extract(files: DataFrame) -> DataFrame:
    """Text and metadata of each file (path, content); a file that cannot be read gives its error instead of a failure."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    text, meta = _READERS.get(path.rpartition(".")[2].lower(), _text)(bytes(data))
                    rows.append((path, text, meta, None))
                except Exception as problem:  # the row says what went wrong
                    rows.append((path, None, {}, f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(rows, columns=["path", "text", "metadata", "extraction_error"])

    return files.select("path", "content").mapInPandas(run, EXTRACT_SCHEMA)


_TAG = re.compile(r"<(?:!--|(script|style)\b[^<>]*>|[!/?A-Za-z][^<>]*>)", re.I)


def visible(html: str) -> str:
    """Text of a page without comments, scripts, styles and tags; entities are resolved, white space is one blank.

    A tag ends at its sign and never goes beyond the next one's beginning; what a comment, script or style leaves open is
    not shown. Linear in the page, whatever it holds.
    """
    out, at, low = [], 0, html.lower()
    while m := _TAG.search(html, at):
        out.append(html[at : m.start()])
        if m[0] == "<!--":
            end = html.find("-->", m.end())
            at = len(html) if end < 0 else end + 3
        elif m[1]:
            end = low.find(f"</{m[1].lower()}", m.end())
            close = -1 if end < 0 else html.find(">", end)
            at = len(html) if close < 0 else close + 1
        else:
            at = m.end()
    out.append(html[at:])
    return " ".join(unescape(" ".join(out)).split())


def markup_text(pages: DataFrame) -> DataFrame:
    """(page_id, text): visible text of HTML pages (page_id, html); a null page has an empty text."""

    @F.pandas_udf("string")
    def text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield pd.Series([visible(h or "") for h in batch], dtype=object)

    return pages.select("page_id", text("html").alias("text"))


def code_and_language(path: Column) -> Column:
    """struct(code, lang) of a statute's path: from a name like SR-220-...-DE.xml, else from folders like SR_220/DE; lang fr by default."""
    name, folders = F.element_at(F.split(path, "/"), -1), F.split(path, "/")
    own = r"(?i)^(?:RS|SR)[-_]([0-9]+(?:\.[0-9]+)?)[-_].*?[-_](FR|DE|IT|EN)\.xml$"
    lang = F.filter(folders, lambda f: F.upper(f).isin("FR", "DE", "IT", "EN"))
    code = F.filter(F.transform(folders, lambda f: F.regexp_extract(f, r"(?i)^SR[-_]([0-9]+(?:\.[0-9]+)?)$", 1)), lambda c: c != "")
    by_name = F.struct(F.regexp_extract(name, own, 1).alias("code"), F.lower(F.regexp_extract(name, own, 2)).alias("lang"))
    by_folder = F.struct(F.get(code, F.lit(0)).alias("code"), F.coalesce(F.lower(F.get(lang, F.lit(0))), F.lit("fr")).alias("lang"))
    return F.when(name.rlike(own), by_name).otherwise(by_folder)


def reviewed_themes(spark: SparkSession, path: str) -> DataFrame:
    """(category, parent, keywords) of a JSON file {"themes": [{"id", "parent", "keywords"}]}; the last entry of an id counts."""
    raw = spark.read.schema("themes array<struct<id: string, parent: string, keywords: array<string>>>").json(path, multiLine=True)
    rows = raw.select(F.posexplode("themes").alias("n", "t")).where("t.id is not null")
    return rows.groupBy(F.col("t.id").alias("category")).agg(F.max_by("t", "n").alias("t")).select("category", "t.parent", "t.keywords")


def sync_taxonomy(taxonomy: DataFrame, seed: DataFrame, versions: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(taxonomy, versions): seed rows (category, parent, keywords) replace those of their category; the version is registered once."""
    kept = taxonomy.join(seed.select("category"), "category", "left_anti").select("category", "parent", "keywords")
    known = versions.select("version").unionAll(versions.sparkSession.createDataFrame([(version,)], "version string")).distinct()
    return kept.unionByName(seed.select("category", "parent", "keywords")), known
