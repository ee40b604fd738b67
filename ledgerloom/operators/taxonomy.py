"""Classification by keyword and rule tables, category edits, evolution, author review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.features import words
from ledgerloom.operators.automaton import phrase_hits, word_matches
from ledgerloom.operators.durable import Workspace


def keyword_hits(docs: DataFrame, keywords: DataFrame, longest: int = 3) -> DataFrame:
    """(doc_id, category, is_child, hits): distinct keywords of a category (category, keyword, is_child) that a text holds.

    A keyword is a word or a phrase of up to `longest` words; it must occur as a run of whole words, whatever signs are
    between them. The words of a text are met by one automaton of all keywords.
    """
    spaced = F.array_join(words(F.col("text")), " ")
    asked = keywords.withColumn("keyword", F.lower("keyword")).where(F.size(F.split("keyword", r"\s+")) <= longest).distinct()
    found = phrase_hits(docs, spaced, asked.select(F.col("keyword").alias("phrase"))).where("whole > 0").select("doc_id", F.col("phrase").alias("keyword")).distinct()
    return found.join(asked, "keyword").groupBy("doc_id", "category", "is_child").agg(F.count(F.lit(1)).alias("hits"))


def stem_hits(docs: DataFrame, keywords: DataFrame, stem: int = 6, whole_only: tuple[str, ...] = ()) -> DataFrame:
    """As keyword_hits, over file name, path and text as they are written: a keyword counts as a whole word or phrase, and
    within a longer word too if it has at least `stem` characters and is none of whole_only.

    docs: doc_id, text and, if there are such columns, filename and path.
    """
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("filename", "path", "text") if c in docs.columns]
    asked = keywords.withColumn("keyword", F.lower(F.trim("keyword"))).distinct()
    parts = (F.length("phrase") >= stem) & ~F.col("phrase").isin(*whole_only) if whole_only else F.length("phrase") >= stem
    found = phrase_hits(docs, F.concat_ws("\n", *own), asked.select(F.col("keyword").alias("phrase"))).where((F.col("whole") > 0) | parts)
    return found.select("doc_id", F.col("phrase").alias("keyword")).distinct().join(asked, "keyword").groupBy("doc_id", "category", "is_child").agg(F.count(F.lit(1)).alias("hits"))


def keyword_in(keyword: str, text: Column, stem: int = 6) -> Column:
    """Whether a keyword occurs as a whole word, or anywhere if it has at least `stem` characters."""
    whole = text.rlike(r"(?iu)(?<![\p{L}\p{N}_])\Q" + keyword.replace("\\E", "") + r"\E(?![\p{L}\p{N}_])")
    return F.coalesce(F.lower(text).contains(keyword.lower()) if len(keyword) >= stem else whole, F.lit(False))


#: Precedence over keyword classes: (category, words in the name, words in the text of which two must occur), first that holds.
PRECEDENCE = [
    ("curriculum_vitae", ("cv", "resume", "lebenslauf", "curriculum"), ("work experience", "education", "skills", "languages", "berufserfahrung", "formation")),
    ("job_advert", ("vacancy", "job ad", "stellenanzeige"), ("we are looking for", "your profile", "apply now", "your tasks", "ihr profil")),
    ("cover_letter", ("cover letter", "motivation", "bewerbung"), ("i am applying", "application for", "bewerbe mich", "ma candidature")),
    ("portfolio", ("portfolio",), ("selected works", "case study", "portfolio of")),
    ("profile", ("profile", "profil"), ("about me", "personal profile", "kurzprofil")),
    ("reference", ("reference", "zeugnis", "certificat"), ("to whom it may concern", "was employed", "arbeitszeugnis")),
    ("bank_statement", ("statement", "kontoauszug", "relevé"), ("iban", "account balance", "opening balance", "kontostand")),
]


def precedence(name: Column, text: Column, rules=PRECEDENCE) -> Column:
    """Category of the first rule with a word in the file name or two of its phrases in the text; null without one."""
    low, out = F.lower(text), F.lit(None).cast("string")
    for category, names, phrases in reversed(rules):
        named = F.coalesce(F.lower(name).rlike(r"(?u)(?<![\p{L}\p{N}])(?:" + "|".join(names) + r")(?![\p{L}\p{N}])"), F.lit(False))
        held = sum((F.coalesce(low.contains(x), F.lit(False)).cast("int") for x in phrases), F.lit(0))
        out = F.when(named | (held >= 2), F.lit(category)).otherwise(out)
    return out


def classify(docs: DataFrame, keywords: DataFrame, floor: float = 0.5, stem: int | None = None, whole_only: tuple[str, ...] = ()) -> DataFrame:
    """Best category per document: min(.95, .72 + .08 hits) + .05 for a child category, over the floor; ties by name.

    Hits are those of stem_hits if `stem` is given, else of keyword_hits.
    """
    confidence = F.round(F.least(F.lit(0.95), 0.72 + 0.08 * F.col("hits")) + 0.05 * F.col("is_child").cast("int"), 4)
    hits = keyword_hits(docs, keywords) if stem is None else stem_hits(docs, keywords, stem, whole_only)
    scored = hits.withColumn("confidence", confidence).where(F.col("confidence") > floor)
    best = scored.groupBy("doc_id").agg(F.min(F.struct(-F.col("confidence"), "category", "hits", "confidence")).alias("b"))
    return best.select("doc_id", "b.category", "b.hits", "b.confidence")


def label_breakdown(docs: DataFrame, labels: dict[str, str], group: str) -> DataFrame:
    """Per group the share of documents whose text matches each label's pattern, in one pass."""
    out = docs.groupBy(group).agg(F.count(F.lit(1)).alias("docs"), *[F.sum(F.lower("text").rlike(p).cast("long")).alias(n) for n, p in labels.items()])
    for n in labels:
        out = out.withColumn(f"{n}_pct", F.round(100 * F.col(n) / F.col("docs"), 2))
    return out


def mentions(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """Entity links from a gazetteer (term, node_id, confidence): the highest confidence per document and node.

    A term is a word or a run of words of any length, met by whole words whatever signs are between them.
    """
    spaced = F.array_join(words(F.col("text")), " ")
    known = rules.select(F.array_join(words(F.col("term")), " ").alias("phrase"), "node_id", "confidence")
    found = phrase_hits(docs, spaced, known.select("phrase")).where("whole > 0").select("doc_id", "phrase")
    return found.join(known, "phrase").groupBy("doc_id", "node_id").agg(F.max("confidence").alias("confidence"))


def reclassify(df: DataFrame, rules: list[tuple[str, Column, str, float]]) -> DataFrame:
    """First rule (name, condition, category, confidence) that holds gives new_category, rule and confidence."""
    chosen = F.struct(F.col("category").alias("category"), F.lit("unchanged").alias("rule"), F.lit(1.0).alias("confidence"))
    for name, condition, category, confidence in reversed(rules):
        chosen = F.when(condition, F.struct(F.lit(category).alias("category"), F.lit(name).alias("rule"), F.lit(confidence).alias("confidence"))).otherwise(chosen)
    return df.withColumn("c", chosen).select("*", F.col("c.category").alias("new_category"), "c.rule", "c.confidence").drop("c")


def evolve(df: DataFrame, rules: list, version: str, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ledger, transitions): changed rows get the new category and version; the audit counts old -> new per rule."""
    judged = reclassify(df, rules)
    changed = F.col("new_category") != F.col("category")
    audit = judged.where(changed).groupBy(F.col("category").alias("old_category"), "new_category", "rule").agg(F.count(F.lit(1)).alias("docs"))
    if dry_run:
        return df, audit
    ledger = judged.withColumn("requeue", changed).withColumn("category", F.col("new_category")).withColumn("version", F.lit(version))
    return ledger.drop("new_category", "rule", "confidence"), audit


def merge_categories(docs: DataFrame, categories: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Retag documents by (source, target), unite the keywords, drop the source categories."""
    tagged = docs.join(mapping, docs["category"] == mapping["source"], "left").withColumn("category", F.coalesce("target", "category")).drop("source", "target")
    moved = categories.join(mapping, categories["category"] == mapping["source"], "left").withColumn("category", F.coalesce("target", "category"))
    merged = moved.groupBy("category").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("keywords")))).alias("keywords"))
    return tagged, merged


def category_counts(categories: DataFrame, docs: DataFrame) -> DataFrame:
    """Live number of documents (category) of each category (category, parent), roots first, then by name."""
    live = docs.groupBy("category").agg(F.count(F.lit(1)).alias("docs"))
    counted = categories.join(live, "category", "left").na.fill(0, ["docs"])
    return counted.withColumn("is_root", F.col("parent").isNull())


def theme_counts(themes: DataFrame) -> DataFrame:
    """Documents of each theme."""
    return themes.groupBy("theme").agg(F.count(F.lit(1)).alias("docs"))


def ancestors(parents: DataFrame, roots: list[str]) -> DataFrame:
    """(category, top): where the climb from each category ends: at a root, or at a category without a parent; null on a cycle.

    Of several parents the smallest by name counts. Each round doubles the steps of every category, so a chain of n
    categories needs about log2(n) rounds and so does a cycle; what has not ended by then never does. Each round is
    written once; the driver sees a count a round.
    """
    spark = parents.sparkSession
    with Workspace(spark, "ancestors") as work:
        one = parents.where("category is not null").groupBy("category").agg(F.min("parent").alias("parent"))
        known = one.select("category", "parent").unionByName(one.where("parent is not null").select(F.col("parent").alias("category"), F.lit(None).cast("string").alias("parent")))
        given = known.groupBy("category").agg(F.min("parent").alias("parent"))
        ended = F.col("category").isin(roots) | F.col("parent").isNull()
        at = work.keep(given.select("category", F.when(ended, F.col("category")).otherwise(F.col("parent")).alias("top"), ended.alias("ended")))
        for _ in range(at.count().bit_length() + 1):
            ahead = at.select(F.col("category").alias("_c"), F.col("top").alias("_top"), F.col("ended").alias("_ended"))
            at = work.keep(at.join(ahead, F.col("top") == F.col("_c"), "left").select("category", F.coalesce("_top", "top").alias("top"), (F.col("ended") | F.coalesce("_ended", F.lit(False))).alias("ended")))
            if at.where(~F.col("ended")).isEmpty():
                break
        return work.result(at.select("category", F.when(F.col("ended"), F.col("top")).alias("top")))


def theme_of(types: DataFrame, parents: DataFrame, aliases: DataFrame, roots: list[str], cues: list[tuple[str, str]] = ()) -> DataFrame:
    """Root theme of each distinct document type: alias, then up the parents to a root, then by cue words (word, theme).

    One row a type: of several aliases and of several parents the smallest counts, and cycles end (ancestors). A type that
    reaches no root takes the theme of the first cue that its name contains, else "unclassified"; a null type is left out.
    """
    known = aliases.groupBy(F.lower("alias").alias("_alias")).agg(F.min("category").alias("_of"))
    at = types.select("doc_type").where("doc_type is not null").distinct().join(known, F.lower("doc_type") == F.col("_alias"), "left").select("doc_type", F.coalesce("_of", F.lower("doc_type")).alias("node"))
    top = ancestors(parents, roots).withColumnRenamed("category", "_c")
    cue = F.lit("unclassified")
    for word, theme in reversed(list(cues)):
        cue = F.when(F.lower("doc_type").contains(word), F.lit(theme)).otherwise(cue)
    end = F.when(F.col("_c").isNull(), F.col("node")).otherwise(F.col("top"))
    return at.join(top, F.col("node") == F.col("_c"), "left").select("doc_type", F.when(end.isin(roots), end).otherwise(cue).alias("theme"))


def nearest_folder_category(paths: DataFrame, rules: DataFrame, depth: int = 3) -> DataFrame:
    """Category of the nearest of up to three folders that a rule (folder, category) names; .98, .95, .90 by distance."""
    folders = F.slice(F.reverse(F.split("path", "/")), 2, depth)
    each = paths.select("path", F.posexplode(F.transform(folders, F.lower)).alias("distance", "folder"))
    best = each.join(rules, "folder").groupBy("path").agg(F.min(F.struct("distance", "category")).alias("b"))
    return best.select("path", "b.category", F.element_at(F.array(F.lit(0.98), F.lit(0.95), F.lit(0.90)), F.col("b.distance") + 1).alias("confidence"))


def author_queue(candidates: DataFrame, reviews: DataFrame, floor: float = 0.9) -> DataFrame:
    """Qualified and verified candidates (doc_id, node_id, status, confidence, verified) without a review."""
    good = candidates.where((F.col("status") == "qualified") & (F.col("confidence") >= floor) & F.col("verified"))
    return good.join(reviews.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_anti")


def corroboration(links: DataFrame) -> DataFrame:
    """Per person: documents in which they are an author, and others; two levels, so a document counts once."""
    per_doc = links.groupBy("node_id", "doc_id").agg(F.max((F.col("role") == "author").cast("int")).alias("a"))
    return per_doc.groupBy("node_id").agg(F.sum("a").alias("as_author"), F.sum(1 - F.col("a")).alias("other"), (F.sum("a") >= 10).alias("corroborated"))


def first_documents(links: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("node_id").orderBy("doc_id")
    return links.select("node_id", "doc_id").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)


def roles_of_pairs(links: DataFrame) -> DataFrame:
    """Distinct roles of each document and person as one sorted string."""
    return links.groupBy("doc_id", "node_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


def certify(candidates: DataFrame, verdicts: DataFrame, least: int = 3) -> DataFrame:
    """Outcome of each candidate (node_id, name) by the verdict (name, verdict: purge, retain or a type) on its name.

    Without a verdict, names shorter than `least` are purged and the others retained.
    """
    given = verdicts.groupBy(F.lower("name").alias("_n")).agg(F.min("verdict").alias("verdict"))
    judged = candidates.join(given, F.lower("name") == F.col("_n"), "left").drop("_n")
    return judged.withColumn("outcome", F.coalesce("verdict", F.when(F.length("name") < least, "purge").otherwise("retain"))).drop("verdict")


def keyword_documents(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, docs): documents that hold each term (term, one word) at least once; terms that none holds are left out."""
    held = word_matches(docs, F.array_join(words(F.col("text")), " "), terms.select(F.lower("term").alias("token"))).where("term is not null")
    return held.groupBy("term").agg(F.countDistinct("doc_id").alias("docs"))


def review_queue(candidates: DataFrame, reviews: DataFrame, evaluated: DataFrame, statuses: list[str], floor: float = 0.9, text: str | None = None) -> DataFrame:
    """Candidates (doc_id, node_id, name, status, confidence, verified) of the given statuses that are sure and verified, and that
    nobody has reviewed (doc_id, node_id) or evaluated (doc_id, node_id) yet; text: a part of the name, in any case."""
    good = candidates.where(F.col("status").isin(statuses) & (F.col("confidence") >= floor) & F.col("verified"))
    if text:
        good = good.where(F.lower("name").contains(text.lower()))
    for done in (reviews, evaluated):
        good = good.join(done.select("doc_id", "node_id").distinct(), ["doc_id", "node_id"], "left_anti")
    return good


def review_page(queue: DataFrame, offset: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(page, total): the surest candidates first, and one row with the number of all."""
    return queue.orderBy(F.desc("confidence"), "doc_id", "node_id").offset(offset).limit(limit), queue.agg(F.count(F.lit(1)).alias("total"))


def evolution_progress(docs: DataFrame, version: str) -> DataFrame:
    """Per category and over all (category null): documents, those of the taxonomy's version, the share in per cent, and
    those still waiting (requeue). A document without a version is not migrated."""
    own = F.sum(F.coalesce(F.col("version") == version, F.lit(False)).cast("long"))
    waiting = F.sum(F.coalesce(F.col("requeue"), F.lit(False)).cast("long"))
    counted = docs.rollup("category").agg(F.count(F.lit(1)).alias("docs"), own.alias("migrated"), waiting.alias("pending"))
    return counted.withColumn("migrated_pct", F.round(100 * F.col("migrated") / F.col("docs"), 2))


def version_counts(docs: DataFrame) -> DataFrame:
    """Documents of each taxonomy version (null: none)."""
    return docs.groupBy("version").agg(F.count(F.lit(1)).alias("docs"))
