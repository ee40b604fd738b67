"""Language identification by compression against per-language dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCUMENTS = 256
MAX_LANGUAGES = 256
MIN_MARGIN = 0.004
BLOCK_BYTES = 4096
UNDETERMINED = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_of(text: str | None) -> bytes:
    """A whole text as UTF-8, lower-cased, all that lies between its words of letters as one space; empty without a letter."""
    plain = _NOT_LETTERS.sub(" ", (text or "").lower())
    if not plain.isascii() and not plain.replace(" ", "").isalpha():  # a word of numerals such as fractions has no letter
        plain = " ".join(w for w in plain.split() if any(map(str.isalpha, w)))
    plain = plain.strip()
    return f" {plain} ".encode("utf-8", "replace") if plain else b""


def is_training(doc_id) -> F.col:
    """Whether a document may teach: CRC-32 of its id as text is no multiple of 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def fit(docs: DataFrame, dictionary_bytes: int = DICTIONARY_BYTES, sample_documents: int = SAMPLE_DOCUMENTS, max_languages: int = MAX_LANGUAGES) -> list[tuple[str, int, bytes]]:
    """Learn (language, labelled documents, dictionary) from labelled rows (doc_id, text, lang), most frequent first.

    A dictionary is the raw content of at most sample_documents texts of its language, in the order of a hash of
    doc_id and text, cut at dictionary_bytes: that is the documented bound of the sample, and texts beyond it never reach the
    driver. The counts, which break ties, cover all labelled rows. Rows with a null text or lang or with no letter teach
    nothing.
    """
    known = docs.where("text is not null and lang is not null").select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return []
    shares = docs.sparkSession.createDataFrame([(x, min(1.0, 4 * sample_documents / n)) for x, n in counts.items()], "lang string, share double")
    drawn = F.xxhash64("doc_id", "text", F.lit(5))
    some = known.join(F.broadcast(shares), "lang").withColumn("draw", drawn).where(F.pmod("draw", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    ranked = some.select("lang", "draw", "doc_id", F.substring("text", 1, dictionary_bytes).alias("text")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample_documents)
    letters = F.sum(F.length(F.regexp_replace("text", r"[^\p{L}]+", " "))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    texts: dict[str, list] = {x: [] for x in counts}
    for r in ranked.withColumn("before", F.coalesce(letters, F.lit(0))).where(F.col("before") < 4 * dictionary_bytes).select("lang", "r", "text").collect():  # copies add nothing
        texts[r["lang"]].append((r["r"], r["text"]))
    out = []
    for lang, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        content = b"".join(dict.fromkeys(letters_of(t) for _, t in sorted(texts[lang])))[:dictionary_bytes]
        if len(content) >= 8:
            out.append((lang, n, content))
    return out


def compressors(model: list[tuple[str, int, bytes]]) -> list:
    """One zstandard compressor per language, over its dictionary as raw content, with short matches allowed."""
    import zstandard

    settings = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_GREEDY, min_match=3, search_log=4, hash_log=15, chain_log=15, window_log=17, write_content_size=0, write_checksum=0, write_dict_id=0)
    return [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=settings) for _, _, content in model]


def sizes_of(content: bytes, tools: list, block_bytes: int = BLOCK_BYTES) -> list[int]:
    """Compressed size of a whole content per language, block by block, so that a long text's own history does not take
    the dictionary's place."""
    blocks = [content[i : i + block_bytes] for i in range(0, len(content), block_bytes)]
    return [sum(len(c.compress(b)) for b in blocks) for c in tools]


def classify(docs: DataFrame, model: list[tuple[str, int, bytes]], min_margin: float = MIN_MARGIN) -> DataFrame:
    """Predict the language of every whole text: doc_id, lang_pred, score, rejected.

    score is (second - best) / second of the compressed sizes, from 0 to 1; with one language only it is 1. Equal
    sizes go to the language with more labelled rows. lang_pred is `und` with score 0 if the text is null or has no
    letter, or if the model is empty. rejected: lang_pred is `und` or the score is below min_margin. One pass, no
    shuffle; only doc_id and text are read, so other columns, whatever their names, change nothing. The dictionaries
    that travel with the tasks have a fixed size per language.
    """
    names = [lang for lang, _, _ in model]

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tools = compressors(model)
        for batch in batches:
            preds, scores = [], []
            for text in batch["text"]:
                content = letters_of(text)
                if not content or not tools:
                    preds.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                sizes = sizes_of(content, tools)
                best = min(range(len(sizes)), key=sizes.__getitem__)
                second = min((s for i, s in enumerate(sizes) if i != best), default=0)
                preds.append(names[best])
                scores.append((second - sizes[best]) / second if second else 1.0)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang_pred": preds, "score": scores})

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(predict, "doc_id long, lang_pred string, score double")
    return out.withColumn("rejected", (F.col("lang_pred") == UNDETERMINED) | (F.col("score") < min_margin))


def keep_identified(docs: DataFrame, model: list[tuple[str, int, bytes]], min_margin: float = MIN_MARGIN) -> DataFrame:
    """The documents whose language is not rejected, unchanged, in one pass without a join."""
    columns = [F.col(f"`{c}`") for c in docs.columns]

    @F.pandas_udf("boolean")
    def identified(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tools = compressors(model)
        for batch in texts:
            keep = []
            for text in batch:
                content = letters_of(text)
                sizes = sorted(sizes_of(content, tools)) if content else []
                keep.append(bool(sizes) and (len(sizes) == 1 or (sizes[1] - sizes[0]) / sizes[1] >= min_margin))
            yield pd.Series(keep, dtype=bool)

    return docs.where(identified(F.col("text").cast("string"))).select(*columns)
