"""Evidence and review of authors, queries' intents, hints in texts, edits of categories and nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.features import looks_like_person
from ledgerloom.operators.durable import Workspace, dealt, few

#: Cues of authorship, stop words of queries, triggers of existence checks, question words.
AUTHOR_CUE = r"authors?|authored\s+by|written\s+by|prepared\s+by|auteur(?:e|rice)?s?|rédigé(?:e|s)?\s+par|écrit\s+par|verfasser(?:in|innen)?|geschrieben\s+von|erstellt\s+von"
STOP_WORDS = ["do", "we", "have", "any", "copy", "or", "draft", "of", "the", "a", "an", "in", "is", "what", "here", "to", "for", "about", "this", "please", "can", "you", "find", "show", "me", "tell", "which", "are", "there"]
EXISTENCE = ["do we have", "est-ce qu'on a", "haben wir", "any copy", "any draft", "copy or draft", "draft or copy", "is there a copy", "is there any copy", "check duplicate", "verify duplicate", "find copy", "search copy", "find draft", "exist", "is it a duplicate"]
QUESTIONS = "where|what|who|when|why|how|summarize|tell|explain|detail|describe|which|is this|où|qui|quand|pourquoi|comment|wo|wer|wann|warum"
NO_CODES = ["PDF", "THE", "AND", "FOR", "NOT", "YES", "AFA", "SHA", "EUR", "USD", "CHF"]
_OUT, _IN = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def folded(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def sentences(text: Column) -> Column:
    """Sentences: cut after . ! ? before white space, and at line breaks; none is empty."""
    cut = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\n"), r"\n+")
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")  # F.trim itself would take the place as what to trim


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once: a lambda's variable, not an expression repeated inside other lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def evidence(text: Column, name: Column, hits: int = 8, chars: int = 900) -> Column:
    """Sentences with the name, the first `hits` of them, each with its neighbours, in order; "" without a hit."""
    found = lambda p, n: F.slice(F.array_compact(F.transform(p, lambda s, i: F.when(folded(s).contains(n), i))), 1, hits)
    around = lambda p, at: F.array_join(F.array_compact(F.transform(p, lambda s, i: F.when(F.exists(at, lambda k: F.abs(k - i) <= 1), s))), "\n")
    return F.coalesce(F.substring(_let(folded(name), lambda n: _let(sentences(text), lambda p: _let(found(p, n), lambda at: around(p, at)))), 1, chars), F.lit(""))


def has_cue(text: Column) -> Column:
    return text.rlike(rf"(?iu){_OUT}(?:{AUTHOR_CUE}){_IN}")


def quote_verified(quote: Column, name: Column, source: Column) -> Column:
    """The quote is verbatim in the evidence and holds both the name and a cue of authorship."""
    q = folded(quote)
    return F.coalesce((q != "") & folded(source).contains(q) & q.contains(folded(name)) & has_cue(quote), F.lit(False))


def prevalidate(candidates: DataFrame) -> DataFrame:
    """Candidates (doc_id, node_id, name, text) with their evidence and status: rejected with a reason, or candidate."""
    out = candidates.withColumn("evidence", evidence(F.col("text"), F.col("name")))
    reason = F.when(~F.coalesce(looks_like_person(F.col("name")), F.lit(False)), "name").when(F.col("evidence") == "", "absent").when(~has_cue(F.col("evidence")), "no cue")
    return out.drop("text").withColumn("reason", reason).withColumn("status", F.when(reason.isNull(), "candidate").otherwise("rejected"))


def apply_verdicts(judged: DataFrame, verdicts: DataFrame, floor: float = 0.9) -> DataFrame:
    """Verdicts (doc_id, node_id, is_author, score, quote) on candidates: qualified needs a verified quote and score >= floor."""
    both = judged.join(verdicts, ["doc_id", "node_id"], "left")
    sure = F.col("score") >= floor
    checked = quote_verified(F.col("quote"), F.col("name"), F.col("evidence"))
    status = F.when(F.col("status") == "rejected", "rejected").when(F.col("is_author") & sure & checked, "qualified").when(~F.col("is_author") & sure, "rejected").otherwise("uncertain")
    return both.withColumn("verified", checked).withColumn("status", status).drop("is_author", "quote")


def apply_reviews(links: DataFrame, evaluated: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, invalid): decisions (doc_id, node_id, decision) on qualified candidates add or take the author role.

    Decisions on others are given back as invalid and change nothing. links have (doc_id, node_id, role, confidence).
    """
    key = ["doc_id", "node_id"]
    fit = evaluated.where("status = 'qualified' and verified").select(*key).distinct()
    valid, invalid = decisions.join(fit, key, "left_semi"), decisions.join(fit, key, "left_anti")
    authors = valid.where("decision = 'approve'").select(*key, F.lit("author").alias("role"), F.lit(1.0).alias("confidence")).distinct()
    touched = valid.select(*key, F.lit("author").alias("role")).distinct()
    return links.select(*key, "role", "confidence").join(touched, [*key, "role"], "left_anti").unionByName(authors), invalid


# Queries and hints --------------------------------------------------------------------------------------------------


def query_tokens(text: Column) -> Column:
    """Words of more than one letter that are no stop words, in order, as written."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"([a-zA-Z0-9_\u00C0-\u017F]+)"), F.lit(1)), lambda t: (F.length(t) > 1) & ~F.lower(t).isin(STOP_WORDS))


def quoted_terms(text: Column) -> Column:
    """Distinct quoted terms and file names of a query."""
    named = F.regexp_extract_all(text, F.lit(r"(?i)([\p{L}\p{N}_.-]+\.(?:pdf|docx?|xlsx?|txt|md|eml))(?![\p{L}\p{N}_])"), F.lit(1))
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1)), named))


def is_existence_check(text: Column) -> Column:
    """Whether a query asks for the existence of a document: a trigger decides, else it is no question; empty counts as one."""
    q = F.lower(F.trim(text))
    trigger = F.exists(F.array(*[F.lit(t) for t in EXISTENCE]), lambda t: q.contains(t))
    return (q == "") | trigger | ~(q.rlike(rf"{_OUT}(?:{QUESTIONS}){_IN}") | q.endswith("?"))


def path_hints(path: Column) -> Column:
    """Distinct folders of a path, drives left out."""
    return F.array_distinct(F.filter(F.slice(F.split(path, r"[/\\]"), 1, F.greatest(F.lit(0), F.size(F.split(path, r"[/\\]")) - 1)), lambda p: (p != "") & ~p.rlike("^[A-Za-z]?:$")))


def capital_codes(text: Column, first: int = 3) -> Column:
    """The first codes of three capital letters that are no common words."""
    return F.slice(F.filter(F.regexp_extract_all(text, F.lit(rf"{_OUT}([A-Z]{{3}}){_IN}"), F.lit(1)), lambda c: ~c.isin(NO_CODES)), 1, first)


#: Labels that announce a name.
NAME_LABELS = ("signed", "passenger", "name", "herr", "frau", "monsieur", "madame", "by", "author")


def labelled_names(text: Column, first: int = 3, labels: tuple[str, ...] = NAME_LABELS, length: tuple[int, int] = (3, 39)) -> Column:
    """The first names that stand behind a label: words of letters, points and hyphens up to another sign, of a length.

    A label is any of `labels` before a colon or white space. What follows it is a name up to the first character that
    names do not have; the next label is looked for behind it.
    """
    label = "|".join(labels)
    cut = F.split(F.regexp_replace(text, rf"(?i)(?:{label})[:\s]+(?=[A-Za-z.-])([A-Za-z\s.-]*)", "\u0001$1\u0002"), "\u0001")
    names = F.transform(F.filter(cut, lambda part: part.contains("\u0002")), lambda part: F.regexp_replace(F.substring_index(part, "\u0002", 1), r"^\s+|\s+$", ""))
    return F.slice(F.filter(names, lambda n: F.length(n).between(*length)), 1, first)


# Categories, nodes, lists -------------------------------------------------------------------------------------------


def split_category(docs: DataFrame, categories: DataFrame, source: str, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listed documents (doc_id, child) of the source category move to its new children: (docs, categories with parent)."""
    to = moves.groupBy("doc_id").agg(F.min("child").alias("_child"))
    moved = docs.join(to, "doc_id", "left").withColumn("category", F.when(F.col("category") == source, F.coalesce("_child", "category")).otherwise(F.col("category"))).drop("_child")
    added = moves.select(F.col("child").alias("category"), F.lit(source).alias("parent")).distinct().join(categories, "category", "left_anti")
    return moved, categories.select("category", "parent").unionByName(added)


def reindex_chunks(chunks: DataFrame, categories: DataFrame) -> DataFrame:
    """Chunks (doc_id, chunk_text) whose header [OLD_CATEGORY] follows the document's category (doc_id, category)."""
    header = F.concat(F.lit("["), F.upper("category"), F.lit("]"))
    moved = chunks.join(categories.select("doc_id", "category"), "doc_id", "left")
    fresh = F.concat(header, F.regexp_replace("chunk_text", r"^\[[A-Z_]+\]", ""))
    return moved.withColumn("chunk_text", F.when(F.col("category").isNotNull() & F.col("chunk_text").rlike(r"^\[[A-Z_]+\]"), fresh).otherwise(F.col("chunk_text"))).drop("category")


def valid_nodes(nodes: DataFrame, longest: int = 60, bad: str = r"(?i)\.pdf|^vous avez") -> DataFrame:
    """Nodes without places whose name is too long or looks like a file or a sentence."""
    broken = (F.col("node_type") == "location") & ((F.length("name") > longest) | F.col("name").rlike(bad))
    return nodes.where(~F.coalesce(broken, F.lit(False)))


def overlay(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(node_id, role) of nodes whose name is like a rule's pattern (pattern, role); the rules are a small list."""
    return nodes.join(rules, F.expr("name ilike pattern")).select("node_id", "role").distinct()


def folder_candidates(paths: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """(path, theme) of paths that contain one of a theme's patterns (theme, text), case ignored."""
    low = F.lower("path")
    themes = sorted({t for t, _ in patterns})
    hit = F.array_compact(F.array(*[F.when(F.exists(F.array(*[F.lit(p.lower()) for u, p in patterns if u == t]), lambda p: low.contains(p)), F.lit(t)) for t in themes]))
    return paths.select("path", F.explode(hit).alias("theme"))


def corpus_counts(actions: DataFrame) -> DataFrame:
    """Actions by category, type and status, with totals of each category and of all; null stands for all."""
    return actions.rollup("category", "action_type", "status").agg(F.count(F.lit(1)).alias("actions"))


def latest_mtimes(undated: DataFrame, instances: DataFrame) -> DataFrame:
    """Latest file time of each undated document over its copies (doc_id, mtime); null without a copy."""
    last = instances.join(undated.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("mtime").alias("mtime"))
    return undated.select("doc_id").join(last, "doc_id", "left")


# Portraits and facets -----------------------------------------------------------------------------------------------


def facet_subgraph(facets: list[DataFrame], edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the nodes of any facet, and the edges with both ends among them."""
    kept = facets[0].select("node_id")
    for f in facets[1:]:
        kept = kept.unionByName(f.select("node_id"))
    kept = kept.distinct()
    ends = lambda e: kept.select(F.col("node_id").alias(e))
    return kept, edges.join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi")


def resolve_focus(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node of each asked text: equal id first, then equal name, then equal slug of the name; ties to the smaller id."""
    slug = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")
    keys = F.array(F.struct(F.col("node_id").alias("key"), F.lit(1).alias("tier")), F.struct(F.lower("name").alias("key"), F.lit(2).alias("tier")), F.struct(slug(F.col("name")).alias("key"), F.lit(3).alias("tier")))
    known = nodes.select("node_id", F.explode(keys).alias("k")).select("node_id", "k.key", "k.tier")
    forms = F.array(F.struct(F.col("asked").alias("key"), F.lit(1).alias("tier")), F.struct(F.lower("asked").alias("key"), F.lit(2).alias("tier")), F.struct(slug(F.col("asked")).alias("key"), F.lit(3).alias("tier")))
    want = asked.select("asked", F.explode(forms).alias("k")).select("asked", "k.key", "k.tier")
    return want.join(known, ["key", "tier"]).groupBy("asked").agg(F.min(F.struct("tier", "node_id")).alias("b")).select("asked", "b.node_id", "b.tier")


def portraits(focus: DataFrame, tiers: list[DataFrame], limit: int = 10) -> DataFrame:
    """Best pieces of evidence (node_id, doc, excerpt) per focus node: earlier tiers first, one per document and first 60 characters."""
    rows = None
    for n, t in enumerate(tiers):
        t = t.join(focus.select("node_id").distinct(), "node_id", "left_semi").select("node_id", "doc", "excerpt", F.lit(n).alias("tier"))
        rows = t if rows is None else rows.unionByName(t)
    once = rows.groupBy("node_id", "doc", F.substring("excerpt", 1, 60).alias("head")).agg(F.min(F.struct("tier", "excerpt")).alias("b"))
    order = Window.partitionBy("node_id").orderBy("b.tier", "doc", "head")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("node_id", "doc", "b.tier", "b.excerpt", "rank")


def expand_results(results: DataFrame, links: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities of each query's documents (query_id, doc) and their neighbours: query_id, node_id, hop (the smallest).

    The results and their entities are written, and broadcast where they are few, so links and edges are read where they lie.
    """
    near_by = lambda t: F.broadcast(t) if few(t) else t
    with Workspace(results.sparkSession, "expanded") as work:
        asked = work.keep(results.select("query_id", "doc").distinct())
        own = work.keep(links.join(near_by(asked), "doc").select("query_id", "node_id").distinct())
        both = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("to")).unionByName(edges.select(F.col("dst").alias("node_id"), F.col("src").alias("to")))
        near = both.join(near_by(own), "node_id").select("query_id", F.col("to").alias("node_id"))
        return work.result(own.withColumn("hop", F.lit(0)).unionByName(near.withColumn("hop", F.lit(1))).groupBy("query_id", "node_id").agg(F.min("hop").alias("hop")))


def insert_absent(links: DataFrame, new: DataFrame, key: list[str], parts: int | None = None) -> DataFrame:
    """Rows of `new` whose key is not among the links yet, once each, appended; with `parts` dealt into so many by the key's first column."""
    known = dealt(links.select(*key), parts, key[0]).distinct()
    return links.unionByName(dealt(new, parts, key[0]).dropDuplicates(key).join(known, key, "left_anti").select(*links.columns))


def missing_embeddings(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """Chunks without an embedding: the ones a refresh has to read."""
    return chunks.join(embedded.select("doc_id").distinct(), "doc_id", "left_anti")


def attach_themes(links: DataFrame, themes: DataFrame) -> DataFrame:
    """links (doc_id, node_id, role, confidence) whose theme links are those of `themes` (doc_id, theme).

    Older theme links of the listed documents go, so a document without a theme (null or 'unclassified') keeps none.
    """
    old = themes.select("doc_id", F.lit("theme").alias("role")).distinct()
    fresh = themes.where("theme is not null and theme <> 'unclassified'").select("doc_id", F.concat(F.lit("theme_"), "theme").alias("node_id"), F.lit("theme").alias("role"), F.lit(1.0).alias("confidence")).distinct()
    return links.select("doc_id", "node_id", "role", "confidence").join(old, ["doc_id", "role"], "left_anti").select("doc_id", "node_id", "role", "confidence").unionByName(fresh)
