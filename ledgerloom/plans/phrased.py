"""Registered queries of what many phrases decide: classes by stems, links by names of many words, fulfilment, statutes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.features import words
from ledgerloom.operators import actions as A
from ledgerloom.operators import extraction as E
from ledgerloom.operators import taxonomy
from ledgerloom.plans import catalogue as C
from ledgerloom.plans import fixtures as fx
from ledgerloom.plans.registered import query, values
from ledgerloom.sources import statutes

STEMS = [("secrets", "password", False), ("secrets", "token", False), ("secrets", "secret key", True), ("notes", "draft", False), ("notes", "final", False), ("licence", "license", False), ("licence", "licen", False), ("licence", "permission is hereby", True), ("suffix", "schaft", False), ("suffix", "mente", True), ("suffix", "station", False), ("words", "because", True), ("words", "that", False)]
WHOLE_ONLY = ("because", "license")


@query(
    f"with k(category, keyword, is_child) as (values {values(STEMS)}), d as (select doc_id, lower({fx.FILE_NAME} || chr(10) || coalesce(text, '')) low from documents), "
    f"h as (select doc_id, category, is_child, count(*) hits from d join k on (length(keyword) >= 6 and keyword not in {WHOLE_ONLY} and contains(low, keyword)) or regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(keyword) || '([^\\p{{L}}\\p{{N}}_]|$)') group by all), "
    "c as (select *, round(least(0.95, 0.72 + 0.08 * hits) + 0.05 * is_child::int, 4)::double confidence from h) "
    "select doc_id, category, hits, confidence from c qualify row_number() over (partition by doc_id order by confidence desc, category) = 1"
)
def stem_classes(spark, sf):
    kw = spark.createDataFrame(STEMS, "category string, keyword string, is_child boolean")
    return taxonomy.classify(fx.documents(spark, sf), kw, stem=6, whole_only=WHOLE_ONLY)


_OPENING = C._WORDS.replace("documents", "benchmark")


@query(f"with g as (select 'b' || item_id node_id, array_to_string({_OPENING}[1:5], ' ') term from benchmark), d as (select doc_id, ' ' || array_to_string({C._WORDS}, ' ') || ' ' run from documents) select doc_id, node_id, 0.9::double confidence from d join g on contains(run, ' ' || term || ' ') where term <> '' group by all")
def passage_links(spark, sf):
    """Documents linked to the items whose first five words they hold as a run."""
    opening = F.array_join(F.slice(words(F.col("text")), 1, 5), " ")
    rules = fx.table(spark, sf, "benchmark").select(opening.alias("term"), F.concat(F.lit("b"), "item_id").alias("node_id"), F.lit(0.9).alias("confidence"))
    return taxonomy.mentions(fx.table(spark, sf, "documents"), rules)


_LINES = """lines as (select l_orderkey * 10 + l_linenumber doc_id, l_linenumber % 4 kind, l_returnflag flag, l_partkey part, l_linestatus mode, floor(l_extendedprice)::bigint price, 'customer ' || o_custkey || ' of ' || o_orderpriority party, l_orderkey o from lineitem join orders on l_orderkey = o_orderkey)"""


@query(
    f"with {_LINES}, a as (select *, case part % 3 when 0 then 'payment' when 1 then 'signature' else 'reply' end rule from lines where flag = 'N'), "
    "parties as (select distinct doc_id, kind, party from lines where kind in (1, 3) or (kind = 2 and part % 5 <> 0)), refs as (select distinct doc_id, kind, o from lines where (kind = 2 and part % 5 = 0) or (kind = 3 and part % 2 = 1)), "
    "heads as (select distinct doc_id, mode from lines where kind = 3 and part % 2 = 0), amounts as (select distinct doc_id, kind, price, party from lines where kind < 2), m as ("
    "select a.doc_id action_id, d.doc_id, a.rule, 'amount and a word of payment' evidence from a join amounts d on a.rule = 'payment' and d.kind = 0 and d.price = a.price and d.doc_id <> a.doc_id "
    "union all select a.doc_id, d.doc_id, a.rule, 'amount and party' from a join amounts d on a.rule = 'payment' and d.kind = 1 and d.price = a.price and d.party = a.party and d.doc_id <> a.doc_id "
    "union all select a.doc_id, d.doc_id, a.rule, 'signed by the party' from a join parties d on a.rule = 'signature' and d.kind = 2 and d.party = a.party and d.doc_id <> a.doc_id "
    "union all select a.doc_id, d.doc_id, a.rule, 'signed for the source' from a join refs d on a.rule = 'signature' and d.kind = 2 and d.o = a.o and d.doc_id <> a.doc_id "
    "union all select a.doc_id, d.doc_id, a.rule, 'party and source' from a join refs d on a.rule = 'reply' and d.o = a.o and d.doc_id <> a.doc_id join parties p on p.doc_id = d.doc_id and p.party = a.party "
    "union all select a.doc_id, d.doc_id, a.rule, 'party and description' from a join parties p on a.rule = 'reply' and p.party = a.party join heads d on d.doc_id = p.doc_id and d.mode = a.mode and d.doc_id <> a.doc_id) "
    "select action_id, doc_id, rule, evidence from m qualify row_number() over (partition by action_id order by doc_id, rule, evidence) = 1"
)
def party_fulfilment(spark, sf):
    """Lines as papers of four kinds; those not yet returned are open actions of the order's customer.

    Names and keys are spelled in letters, one for one: the only number in a paper is its price, as the SQL has it.
    """
    o = fx.table(spark, sf, "orders").select("o_orderkey", F.translate(F.concat(F.lit("Customer "), "o_custkey", F.lit(" of "), "o_orderpriority"), "0123456789", "abcdefghij").alias("party"))
    lines = fx.table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    price, key = F.floor("l_extendedprice").cast("long"), F.translate(F.substring(F.md5(F.col("l_orderkey").cast("string").cast("binary")), 1, 8), "0123456789", "ghijklmnop")
    told = F.concat(F.lit("return of goods of kind "), "l_linestatus", F.lit(", please"))
    kind, part = F.col("l_linenumber") % 4, F.col("l_partkey")
    text = F.when(kind == 0, F.concat(F.lit("Receipt for "), price)).when(kind == 1, F.concat(F.lit("we had "), price, F.lit(".00 from "), "party"))
    text = text.when(kind == 2, F.concat(F.lit("Signed: "), F.when(part % 5 == 0, key).otherwise(F.col("party")))).otherwise(F.concat(F.lit("answer of "), "party", F.lit(" to "), F.when(part % 2 == 1, key).otherwise(told)))
    papers = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), text.alias("text"), "party", price.alias("amount"), key.alias("source_key"), told.alias("description"), "l_returnflag", part.alias("part"))
    rule = F.when(F.col("part") % 3 == 0, "payment").when(F.col("part") % 3 == 1, "signature").otherwise("reply")
    asked = papers.where("l_returnflag = 'N'").select(F.col("doc_id").alias("action_id"), F.col("doc_id").alias("source_doc"), rule.alias("action_type"), "party", "amount", "source_key", "description")
    return A.first_matches(asked, papers.select("doc_id", "text"))


_CHUNKS = """c as (select page_id chunk_id, (page_id % 7 + 1) * 100 || '.' || page_id % 5 code, (page_id % 40)::varchar article, page_id % 3 kind, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})/', 1) tongue from pages)"""


@query(
    f"with {_CHUNKS}, m as (select *, case when tongue in ('de', 'en', 'it', 'fr') then tongue else 'fr' end lang, case kind when 0 then 'key' else 'text' end \"by\" from c where kind < 2 and article::int % 2 = 0) "
    'select code, article, lang, chunk_id, "by" from m qualify row_number() over (partition by code, article, lang order by "by", chunk_id) = 1'
)
def statute_mentions(spark, sf):
    """Pages as chunks of statutes: a third has the binding key in its name, a third names code and article, a third the code only."""
    n = F.col("page_id")
    code, article = F.concat((n % 7 + 1) * 100, F.lit("."), n % 5), (n % 40).cast("string")
    tongue = F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]{2})/", 1)
    name = F.concat(F.lit("law"), F.when(n % 3 == 0, F.concat(F.lit("_"), code, F.lit("_art_"), article)).otherwise(""), F.lit("-"), F.upper(tongue), F.lit(".xml"))
    text = F.when(n % 3 == 1, F.concat(F.lit("By Art. "), article, F.lit(" (SR "), code, F.lit(") it holds"))).when(n % 3 == 2, F.concat(F.lit("SR "), code, F.lit(" as a whole")))
    chunks = fx.table(spark, sf, "pages").select(n.alias("chunk_id"), name.alias("name"), text.alias("text"), code.alias("code"), article.alias("article"))
    return E.statute_mentions(chunks, chunks.where("cast(article as int) % 2 = 0"))


def _xml(spark, sf):
    """Pages as statutes: two articles with text in a chapter of a part, one without, one outside of all levels."""
    escaped = F.replace(F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    n = F.col("page_id").cast("string")
    article = lambda number, own, *texts: F.concat(F.lit("<article><num>Art. "), number, F.lit("</num>"), F.lit(f"<heading>{own}</heading>" if own else ""), *[F.concat(F.lit("<paragraph><p>"), t, F.lit("</p></paragraph>")) for t in texts], F.lit("</article>"))
    content = F.concat(
        F.lit("<act xmlns='x'><docTitle>Act "), n, F.lit("</docTitle>"), article(F.lit("1"), None, F.lit("alone")), F.lit("<part><heading>Part "), (F.col("page_id") % 3).cast("string"), F.lit("</heading><chapter><heading>Chapter "), (F.col("page_id") % 5).cast("string"),
        F.lit("</heading><level><heading>Level</heading>"), article(n, None, escaped, F.lit("second")), article(F.lit("3"), "empty"), article(F.lit("4"), "Own", F.lit("own text")), F.lit("</level></chapter></part></act>"),
    )
    path = F.concat(F.lit("/x/SR-"), (F.col("page_id") % 7 + 100).cast("string"), F.lit("-2024-"), F.when(F.col("page_id") % 2 == 0, "DE").otherwise("EN"), F.lit(".xml"))
    return fx.table(spark, sf, "pages").select(path.alias("path"), content.cast("binary").alias("content"))


LAWS = [("100", "de", "Grundgesetz", "GG"), ("101", "en", "Code", "C"), ("102", "de", "Ordnung", "O")]


@query(
    f"with c(code, lang, title, short) as (values {values(LAWS)}), p as (select page_id, (page_id % 7 + 100)::varchar code, case when page_id % 2 = 0 then 'de' else 'en' end lang, url from pages), "
    "a as (select *, 0 n, 'Art. 1' number, '' heading, '' chapter, '' part, 'alone' t from p union all select *, 1, 'Art. ' || page_id, 'Level', 'Chapter ' || page_id % 5, 'Part ' || page_id % 3, url || ' second' from p union all select *, 3, 'Art. 4', 'Own', 'Chapter ' || page_id % 5, 'Part ' || page_id % 3, 'own text' from p) "
    "select n, a.code, a.lang, number, a.code || '_' || number binding_key, heading, chapter, part, 'passage: ' || coalesce(title, 'Act ' || page_id) || ' (' || coalesce(short || ' ', '') || 'SR ' || a.code || '), ' || number || case when heading <> '' then ' — ' || heading else '' end || ': ' || t passage from a left join c on a.code = c.code and a.lang = c.lang"
)
def statute_articles(spark, sf):
    laws = spark.createDataFrame(LAWS, "code string, lang string, title string, short string")
    return statutes.statutes(_xml(spark, sf), laws).select("n", "code", "lang", "number", "binding_key", "heading", "chapter", "part", "passage")


#: A note at the end of a document, the same in Spark SQL and in DuckDB: a bill, what pays the bill before, a letter to sign.
NOTE = """concat(coalesce(text, ''), case doc_id % 6 when 0 then concat(' Invoice of EUR ', doc_id, '.50, due date: 2024-0', doc_id % 9 + 1, '-15')
 when 1 then concat(' We paid ', doc_id - 1, '.50 in full') when 2 then ' Bitte unterschreiben, due date: 20.05.2024' when 3 then concat(' Rechnung ', doc_id, ', zahlbar bis 1.2.2024') else '' end)"""
_BILL = (
    f"d as (select doc_id, lang, {NOTE} t from documents), r as (select doc_id, lang, t, lower(t) low, try_cast(regexp_replace(regexp_extract(t, '{A._AMOUNT.replace(chr(39), chr(39) * 2)}', 1), '[''’ ]', '', 'g') as decimal(18, 2)) amount, "
    f"coalesce(try_strptime(regexp_extract(t, '{A._DUE.replace('(?iu)', '(?i)')}', 1), '%Y-%m-%d'), try_strptime(regexp_extract(t, '{A._DUE.replace('(?iu)', '(?i)')}', 1), '%d.%m.%Y'))::date due from d), "
    f"k as (select *, case when regexp_matches(low, '{A.BILL_WORDS}') and (amount is not null or due is not null) then 'payment' when regexp_matches(low, '{A.SIGN_WORDS}') then 'signature' end action_type from r), "
    "f as (select doc_id, lang, action_type, case when action_type = 'payment' then amount end amount, due from k where action_type is not null), n as (select * from f where lang is distinct from 'de'), "
    f"tok as (select distinct doc_id, case when contains(x, '.') then x else x || '.00' end x from (select doc_id, unnest(regexp_extract_all(t, '[0-9]+(?:\\.[0-9]{{2}})?')) x from r where regexp_matches(low, '{A.PAID_WORDS}'))), "
    "m as (select n.doc_id, min(tok.doc_id) fulfilled_by from n join tok on action_type = 'payment' and amount > 0 and x = printf('%.2f', amount::double) and tok.doc_id <> n.doc_id group by all), "
    "a as (select n.doc_id, action_type, amount::double amount, due::varchar due, case when fulfilled_by is null then 'pending' else 'completed' end status, fulfilled_by from n left join m using (doc_id))"
)


def _backfilled(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang", F.expr(NOTE).alias("text"))
    known = A.obligations(docs.where("lang = 'de'"))
    return A.backfill_obligations(docs, known, F.lit("2024-04-01").cast("date"))


@query(f"with {_BILL} select * from a")
def document_obligations(spark, sf):
    """Obligations of all documents but the German ones, which are known already."""
    actions = _backfilled(spark, sf)[0]
    return actions.select("doc_id", "action_type", F.col("amount").cast("double").alias("amount"), F.col("due").cast("string").alias("due"), "status", "fulfilled_by")


@query(
    f"with {_BILL}, g as (select action_type, count(*) found from f group by all), h as (select action_type, count(*) \"new\", sum((status = 'pending')::int)::bigint pending, sum((status = 'pending' and due < '2024-04-01')::int)::bigint overdue, sum((status = 'completed')::int)::bigint completed from a group by all) "
    'select action_type, found, coalesce("new", 0) "new", coalesce(pending, 0) pending, coalesce(overdue, 0) overdue, coalesce(completed, 0) completed from g left join h using (action_type)'
)
def obligation_counts(spark, sf):
    return _backfilled(spark, sf)[1]
