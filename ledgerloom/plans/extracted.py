"""Registered queries of extraction, evidence, review and portraits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import extraction as E
from ledgerloom.operators import refresh
from ledgerloom.operators import review as R
from ledgerloom.plans import fixtures as fx
from ledgerloom.plans.registered import query, values

#: Terms of the invented prose beside the fixed ones, so that every rule has hits in the given tables.
PILLARS = [*E.PILLARS, ("rent", "nicht|avec"), ("salary", "have|para"), ("fee", "was|les")]
PATTERNS = [*E.PARTY_PATTERNS, r"under the ([A-Z][A-Za-z ]+)(?:,|\.|\n)", r"\n([A-Z][a-z]+)\.\n"]
STATUTES = [*E.STATUTES, ("VERSION", "licence")]
_OUT, _IN = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
_NAME = fx.FILE_NAME


def _docs(spark, sf):
    return fx.table(spark, sf, "documents")


def _term(terms: str) -> str:
    quoted = terms.replace("'", "''")
    return f"regexp_matches(text, '(?i){_OUT}(?:{quoted}){_IN}')"


_FIN = "fin as (" + " union ".join(
    [f"select doc_id, 'currency_{c.lower()}' node_id, 'currency' node_type, 'currency_unit' as \"role\" from documents where {_term(w)}" + (f" or contains(text, '{s}')" if s else "") for c, w, s in E.CURRENCIES]
    + [f"select doc_id, 'financial_pillar_{p}', 'financial_pillar', 'financial_term' from documents where {_term(w)}" for p, w in PILLARS]
) + ")"


@query(f"with {_FIN} select * from fin")
def financial_links(spark, sf):
    return E.financial_links(_docs(spark, sf), pillars=PILLARS).select("doc_id", "node_id", "node_type", "role").distinct()


@query(f"with {_FIN} select node_id, count(*) docs from fin where node_type = 'financial_pillar' group by all")
def pillar_counts(spark, sf):
    return E.pillar_counts(E.financial_links(_docs(spark, sf), pillars=PILLARS))


_PARTY = "party as (select distinct doc_id, kind || '_' || lower(regexp_replace(name, '[\\s-]+', '_', 'g')) node_id, kind node_type, case kind when 'organization' then 'counterparty' else 'signatory' end as \"role\" from (select doc_id, name, case when regexp_matches(name, '" + E.ORGANISATION + "') then 'organization' else 'person' end kind from (select doc_id, trim(regexp_replace(trim(unnest(list_distinct(" + " || ".join("regexp_extract_all(coalesce(text, ''), '" + p.replace("'", "''") + "', 1)" for p in PATTERNS) + "))), '\\s*\\([^)]*\\)', '', 'g')) name from documents) where length(name) between 3 and 55 and not contains(name, chr(10)) and not regexp_matches(name, '[.,;:!?]$') and not regexp_matches(lower(name), 'agreement|contract|page|date')))"


@query(f"with {_PARTY} select * from party")
def party_links(spark, sf):
    return E.parties(_docs(spark, sf), PATTERNS).select("doc_id", "node_id", "node_type", "role")


_LAWS = "|".join(a for a, _ in STATUTES)
_CITED = f"""laws(law, code) as (values {values(STATUTES)}),
cites as (select doc_id, upper(unnest(regexp_extract_all(text, '(?i){_OUT}(?:Art\\.?|Article)?\\s*([0-9]+[a-z]?\\s*(?:al\\.?\\s*[0-9]+)?\\s*(?:let\\.?\\s*[a-z])?\\s*(?:{_LAWS})\\b)', 1))) c, true first from documents
  union select doc_id, upper(unnest(regexp_extract_all(text, '(?i){_OUT}((?:{_LAWS})\\s*(?:Art\\.?|Article)?\\s*[0-9]+[a-z]?)\\b', 1))), false from documents),
cp as (select doc_id, regexp_extract(c, case when first then '({_LAWS})$' else '^({_LAWS})' end, 1) law, lower(regexp_extract(c, case when first then '^([0-9]+(?:[A-Z]\\b)?)' else '([0-9]+[A-Z]?)$' end, 1)) article from cites),
cited as (select distinct doc_id, code, article, 'statute_sr_' || replace(code, '.', '_') law_id, 'statute_sr_' || replace(code, '.', '_') || '_art_' || article node_id from cp join laws using (law))"""


@query(f"with {_CITED} select * from cited")
def statute_citations(spark, sf):
    return E.citations(_docs(spark, sf), STATUTES)


_LINKED = f"{_FIN}, {_PARTY}, {_CITED}, linked as (select * from fin union select * from party union select doc_id, node_id, 'statute', 'governing_law' from cited)"
_RULES = f"rules(lk, rk, relation) as (values {values(E.EDGE_RULES)})"


def _linked(spark, sf):
    docs = _docs(spark, sf)
    cited = E.citations(docs, STATUTES).select("doc_id", "node_id", F.lit("statute").alias("node_type"), F.lit("governing_law").alias("role"), F.lit(1.0).alias("confidence"))
    return E.financial_links(docs, pillars=PILLARS).unionByName(E.parties(docs, PATTERNS)).unionByName(cited)


@query(
    f"with {_LINKED}, {_RULES}, k as (select distinct doc_id, node_id, unnest(case when node_type in ('person', 'organization') then [node_type, 'party'] else [node_type] end) kind from linked) "
    "select x.node_id src, y.node_id dst, relation, count(distinct x.doc_id) weight from k x join rules on lk = x.kind join k y on y.doc_id = x.doc_id and y.kind = rk where lk <> rk or x.node_id < y.node_id group by all"
)
def extracted_edges(spark, sf):
    return E.document_edges(_linked(spark, sf))


@query(f"with {_LINKED} select doc_id, count(distinct node_id || '/' || \"role\") links from linked group by all")
def extracted_links(spark, sf):
    return E.extract_links(_docs(spark, sf), [_linked(spark, sf)], PATTERNS).groupBy("doc_id").agg(F.count(F.lit(1)).alias("links"))


@query(f"select doc_id, case when {_term('was|have')} then 'org_en' when {_term('les|avec')} then 'org_fr' else 'org_en' end node_id from documents where regexp_matches(text, '{_OUT}The{_IN}')")
def acronym_senses(spark, sf):
    return E.disambiguate(_docs(spark, sf), "The", [("org_en", "was|have"), ("org_fr", "les|avec")]).select("doc_id", "node_id")


_PROFILE = f"""n as (select doc_id, coalesce(text, '') t, {_NAME} filename from documents), b as (select *, lower(concat_ws(' ', filename, t)) low from n),
ls as (select *, list_filter(list_transform(regexp_split_to_array(t, '\\r\\n|\\r|\\n'), lambda x: trim(regexp_replace(trim(x), '^\\[(?:Document:[^\\]]+|[A-Z_]+)\\]\\s*', ''))), lambda x: length(x) > 3) l from b)"""


@query(f"with {_PROFILE} select doc_id, nullif(regexp_replace(regexp_extract(low, '({E._ISO})', 1), '[./_]', '-', 'g'), '') governing_date, case when regexp_matches(low, '{E.DRAFT}') then 'draft' when regexp_matches(low, '{E.PARTIAL}') then 'truncated' else 'final' end status, md5(substr(coalesce(l[1], filename), 1, 80)) title_md5 from ls")
def document_profile(spark, sf):
    return E.profile(fx.documents(spark, sf)).select("doc_id", "governing_date", "status", F.md5("title").alias("title_md5"))


@query("with o as (select o_custkey doc_id, o_orderpriority action_type, o_orderdate::date due_date, o_orderstatus, o_orderkey from orders), k as (select distinct doc_id, action_type, due_date from o where o_orderstatus = 'F') select distinct doc_id, action_type, due_date from o anti join k using (doc_id, action_type, due_date)")
def obligation_backfill(spark, sf):
    """Orders as obligations found again; completed ones are known already."""
    o = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("action_type"), F.col("o_orderdate").cast("date").alias("due_date"), F.lit(None).cast("decimal(18,2)").alias("amount"), "o_orderstatus")
    return E.new_obligations(o, o.where("o_orderstatus = 'F'")).select("doc_id", "action_type", "due_date")


@query("with r as (select l_orderkey action_id, max(l_shipdate) \"at\" from lineitem where l_returnflag = 'R' group by all) select o_orderkey action_id, case when o_orderstatus = 'O' and \"at\" is not null then 'resolved' when o_orderstatus = 'O' then 'pending' else 'completed' end status from orders left join r on action_id = o_orderkey")
def resolved_actions(spark, sf):
    actions = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("action_id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("completed").alias("status"))
    done = fx.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("action_id"), F.lit("resolved").alias("status"), F.col("l_shipdate").alias("at"))
    return E.resolve_actions(actions, done)[0]


@query(f"select doc_id, case when contains(lower({_NAME}), 'draft') then 'drafting office' when contains(lower({_NAME}), 'src1') then 'first court' else lang end authority from documents")
def issuing_authority(spark, sf):
    return fx.documents(spark, sf).select("doc_id", E.authority(F.col("filename"), [("draft", "drafting office"), ("src1", "first court")], F.col("lang")).alias("authority"))


@query("with p as (select doc_id, unnest(string_split(trim(text), chr(10))) t, generate_subscripts(string_split(trim(text), chr(10)), 1) - 1 n from documents), w as (select doc_id, n, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') w from p) select doc_id, n::int chunk_index, (len(w) + 1)::int token_count from w where len(w) < 900 union all select doc_id, (n * 100)::int, (len(w) + 1)::int from w where len(w) >= 900")
def legal_chunks(spark, sf):
    """Every line of a document as a passage of a statute."""
    docs = _docs(spark, sf).where("text is not null").select("doc_id", F.concat(F.lit("passage: "), F.regexp_replace(F.trim("text"), "\n", "\n\npassage: ")).alias("text"))
    return E.legal_chunks(docs).select("doc_id", "chunk_index", "token_count")


_URL = "regexp_extract(url, '^[a-z]+://([^/]+)/([a-z]{2})/([0-9]+)', "


@query(f"with c as (select page_id chunk_id, regexp_extract(url, '\\.([a-z]+)/', 1) code, ({_URL}3)::int % 40)::varchar article, {_URL}2) lang from pages where regexp_matches(url, '^[a-z]+://[^/]+/[a-z]{{2}}/[0-9]+')) select code, article, lang, min(chunk_id) chunk_id from c where article::int % 2 = 0 group by all")
def statute_chunks(spark, sf):
    """Pages as chunks: their top-level domain is the code; even articles are asked for."""
    part = lambda g: F.regexp_extract("url", r"^[a-z]+://([^/]+)/([a-z]{2})/([0-9]+)", g)
    c = fx.table(spark, sf, "pages").where(part(3) != "").select(F.col("page_id").alias("chunk_id"), F.regexp_extract("url", r"\.([a-z]+)/", 1).alias("code"), (part(3).cast("int") % 40).cast("string").alias("article"), part(2).alias("lang"))
    return E.statute_chunks(c, c.where("cast(article as int) % 2 = 0"))


# Evidence and review ------------------------------------------------------------------------------------------------

_EVIDENCE = f"""s0 as (select doc_id, regexp_extract_all(text, '([\\p{{L}}\\p{{N}}_]+)')[2] nm, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x)), lambda x: x <> '') p from documents where text is not null),
s1 as (select doc_id, nm, unnest(p) s, generate_subscripts(p, 1) i from s0), hit as (select doc_id, i from (select doc_id, i, row_number() over (partition by doc_id order by i) r from s1 where contains(trim(regexp_replace(lower(s), '\\s+', ' ', 'g')), lower(nm))) where r <= 8),
ev as (select doc_id, substr(string_agg(s, chr(10) order by i), 1, 900) evidence from s1 semi join hit on s1.doc_id = hit.doc_id and abs(s1.i - hit.i) <= 1 group by all)"""


@query(f"with {_EVIDENCE} select s0.doc_id, md5(coalesce(evidence, '')) evidence_md5 from s0 left join ev using (doc_id) where nm is not null")
def candidate_evidence(spark, sf):
    """Sentences around the second word of each document, as if it were a candidate's name."""
    docs = _docs(spark, sf).withColumn("name", F.get(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), F.lit(1)))
    return docs.where("name is not null").select("doc_id", F.md5(R.evidence(F.col("text"), F.col("name"))).alias("evidence_md5"))


_TOKENS = "list_filter(regexp_extract_all(text, '([a-zA-Z0-9_\\x{00C0}-\\x{017F}]+)'), lambda t: length(t) > 1 and not list_contains([" + ", ".join(f"'{w}'" for w in R.STOP_WORDS) + "], lower(t)))"
_EXISTS = "(trim(text) = '' or " + " or ".join("contains(lower(trim(text)), '" + t.replace("'", "''") + "')" for t in R.EXISTENCE) + f" or not (regexp_matches(lower(trim(text)), '{_OUT}(?:{R.QUESTIONS}){_IN}') or ends_with(trim(text), '?')))"


@query(f"select item_id, len({_TOKENS})::int tokens, {_TOKENS}[1] first_token, {_EXISTS} existence from benchmark")
def query_intents(spark, sf):
    b, t = fx.table(spark, sf, "benchmark"), R.query_tokens(F.col("text"))
    return b.select("item_id", F.size(t).alias("tokens"), F.get(t, F.lit(0)).alias("first_token"), R.is_existence_check(F.col("text")).alias("existence"))


@query("select page_id, regexp_extract(url, '^[a-z]+://(.*)/[^/]*$', 1) hints from pages")
def path_hints(spark, sf):
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return fx.table(spark, sf, "pages").select("page_id", F.array_join(R.path_hints(path), "/").alias("hints"))


@query(f"select doc_id, list_filter(regexp_extract_all(regexp_replace(text, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'), '{_OUT}([A-Z]{{3}}){_IN}', 1), lambda c: not list_contains([{', '.join(repr(c) for c in R.NO_CODES)}], c))[1:3]::varchar[] codes from documents where text is not null")
def capital_codes(spark, sf):
    return _docs(spark, sf).where("text is not null").select("doc_id", R.capital_codes(F.col("text")).alias("codes"))


@query("select o_orderstatus category, o_orderpriority action_type, (o_totalprice > 200000)::varchar status, count(*) actions from orders group by rollup (o_orderstatus, o_orderpriority, (o_totalprice > 200000)::varchar)")
def corpus_counts(spark, sf):
    return R.corpus_counts(fx.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("category"), F.col("o_orderpriority").alias("action_type"), (F.col("o_totalprice") > 200000).cast("string").alias("status")))


@query("select o_orderkey doc_id, max(l_shipdate) mtime from orders left join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'P' group by all")
def undated_documents(spark, sf):
    undated = fx.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("doc_id"))
    return R.latest_mtimes(undated, fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_shipdate").alias("mtime")))


@query("select label, count(*) vectors, count(*) filter (len(list_filter(embedding, lambda x: x <> 0)) = 0) empty from embeddings group by all")
def embedding_status(spark, sf):
    return refresh.embedding_status(fx.table(spark, sf, "embeddings"))


@query("select doc_id, len(text)::int n from documents where doc_id not in (select vec_id from embeddings)")
def embedding_backlog(spark, sf):
    done = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return R.missing_embeddings(_docs(spark, sf), done).select("doc_id", F.length("text").alias("n"))


# Graph --------------------------------------------------------------------------------------------------------------

_NODES = "nodes as (select 'p' || p_partkey node_id, 'part' node_type, p_name \"name\" from part union all select 's' || s_suppkey, 'supplier', s_name from supplier)"


@query(f"with {fx.EDGES_SQL}, f as (select 'p' || p_partkey n from part where p_size > 40 union select 's' || s_suppkey from supplier where s_nationkey < 5) select src, dst, weight from edges where src in (from f) and dst in (from f)")
def facet_subgraph(spark, sf):
    p = fx.table(spark, sf, "part").where("p_size > 40").select(F.concat(F.lit("p"), "p_partkey").alias("node_id"))
    s = fx.table(spark, sf, "supplier").where("s_nationkey < 5").select(F.concat(F.lit("s"), "s_suppkey").alias("node_id"))
    return R.facet_subgraph([p, s], fx.edges(spark, sf))[1].select("src", "dst", "weight")


_OVERLAY = [("%red%", "colour"), ("%1%", "numbered"), ("supplier#%7", "seventh")]


@query(f"with {_NODES}, r(pattern, \"role\") as (values {values(_OVERLAY)}) select distinct node_id, \"role\" from nodes join r on \"name\" ilike pattern")
def name_overlays(spark, sf):
    return R.overlay(fx.nodes(spark, sf), spark.createDataFrame(_OVERLAY, "pattern string, role string"))


_FOLDERS = [("english", "/en/"), ("french", "/FR/"), ("forum", "m."), ("forum", "example.org")]


@query("select distinct url \"path\", theme from pages join (values ('english', '/en/'), ('french', '/fr/'), ('forum', 'm.'), ('forum', 'example.org')) t(theme, p) on contains(lower(url), p)")
def folder_candidates(spark, sf):
    return R.folder_candidates(fx.table(spark, sf, "pages").select(F.col("url").alias("path")), _FOLDERS).distinct()


_RESULTS = "res as (select o_orderpriority query_id, o_orderkey doc from (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) r from orders) where r <= 3)"


@query(f"with {fx.LINKS_SQL}, {fx.EDGES_SQL}, {_RESULTS}, own as (select distinct query_id, node_id from res join links using (doc)), b as (select src x, dst y from edges union select dst, src from edges) select query_id, node_id, min(hop)::int hop from (select *, 0 hop from own union all select query_id, y, 1 from own join b on x = node_id) group by all")
def expanded_results(spark, sf):
    """Entities around the three dearest orders of each priority."""
    o = fx.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("query_id"), F.col("o_orderkey").alias("doc"), "o_totalprice")
    order = Window.partitionBy("query_id").orderBy(F.desc("o_totalprice"), "doc")
    top = o.withColumn("r", F.row_number().over(order)).where("r <= 3").select("query_id", "doc")
    return R.expand_results(top, fx.links(spark, sf), fx.edges(spark, sf))


@query(
    f"with {fx.LINKS_SQL}, t as (select l_partkey, l_orderkey doc, l_linenumber n, l_returnflag f, l_quantity q from lineitem), e as (select 'p' || l_partkey node_id, doc, case f when 'R' then 0 when 'A' then 1 else 2 end tier, f || ' ' || q::int excerpt from t), "
    "o as (select node_id, doc, excerpt, min(tier)::int tier from e group by all), r as (select *, row_number() over (partition by node_id order by tier, doc, excerpt)::int \"rank\" from o) select * from r where \"rank\" <= 10"
)
def entity_portraits(spark, sf):
    """Lines of every part as evidence, returned ones first."""
    t = fx.table(spark, sf, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("node_id"), F.col("l_orderkey").alias("doc"), F.concat_ws(" ", "l_returnflag", F.round("l_quantity").cast("int").cast("string")).alias("excerpt"), "l_returnflag")
    return R.portraits(fx.nodes(spark, sf), [t.where("l_returnflag = 'R'"), t.where("l_returnflag = 'A'"), t.where("l_returnflag not in ('R', 'A')")])


@query(f"with {_NODES} select s_name asked, 's' || s_suppkey node_id from supplier union all select 'p' || p_partkey, 'p' || p_partkey from part")
def resolved_focus(spark, sf):
    s = fx.table(spark, sf, "supplier").select(F.col("s_name").alias("asked"))
    p = fx.table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("asked"))
    return R.resolve_focus(s.unionAll(p), fx.nodes(spark, sf)).select("asked", "node_id")


@query(f"with {fx.LINKS_SQL} select doc, node_id from links union select l_orderkey, 'l' || l_linenumber from lineitem")
def inserted_links(spark, sf):
    more = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.concat(F.lit("l"), "l_linenumber").alias("node_id"))
    return R.insert_absent(fx.links(spark, sf), more.unionAll(fx.links(spark, sf)), ["doc", "node_id"], fx.link_parts(spark, sf))


@query("select case when p_brand = 'Brand#1' or p_brand = 'Brand#11' then case when p_size > 25 then 'large' else 'small' end else p_brand end category, count(*) docs from part group by all")
def category_split(spark, sf):
    docs = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_brand").isin("Brand#1", "Brand#11"), "both").otherwise(F.col("p_brand")).alias("category"), "p_size")
    moves = docs.select("doc_id", F.when(F.col("p_size") > 25, "large").otherwise("small").alias("child"))
    known = docs.select("category", F.lit(None).cast("string").alias("parent")).distinct()
    return R.split_category(docs, known, "both", moves)[0].groupBy("category").agg(F.count(F.lit(1)).alias("docs"))


@query("select doc_id, case when quality = 1 and toxic = 0 then 'author' else 'reader' end as \"role\" from labels")
def review_decisions(spark, sf):
    """Documents of good quality are qualified; a toxic one is rejected by its reviewer."""
    l = fx.table(spark, sf, "labels").withColumn("node_id", F.lit("n"))  # noqa: E741
    judged = l.select("doc_id", "node_id", F.when(F.col("quality") == 1, "qualified").otherwise("rejected").alias("status"), F.lit(True).alias("verified"))
    decisions = l.select("doc_id", "node_id", F.when(F.col("toxic") == 0, "approve").otherwise("reject").alias("decision"))
    links, _ = R.apply_reviews(l.limit(0).select("doc_id", "node_id", F.lit("").alias("role"), F.lit(1.0).alias("confidence")), judged, decisions)
    return l.join(links.select("doc_id", "role"), "doc_id", "left").select("doc_id", F.coalesce("role", F.lit("reader")).alias("role"))
