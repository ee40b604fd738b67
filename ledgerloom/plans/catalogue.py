"""Registered queries of the engine's own operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import features as X
from ledgerloom.operators import actions as A
from ledgerloom.operators import dedup, graph, ledger, refresh, retrieval, taxonomy
from ledgerloom.operators.automaton import phrase_hits
from ledgerloom.plans import extracted as _extracted  # noqa: F401
from ledgerloom.plans import fixtures as fx
from ledgerloom.plans import refreshed as _refreshed  # noqa: F401
from ledgerloom.plans.registered import QUERIES, SQL, query, values
from ledgerloom.sources import files
from ledgerloom.streaming import jobs

AS_OF = "1998-06-01 00:00:00"
KEYWORDS = [("function_en", "the", False), ("function_en", "that", False), ("function_en", "with", False), ("function_de", "und", False), ("function_de", "der", False), ("function_de", "nicht", True), ("function_fr", "les", False), ("function_fr", "dans", True), ("function_es", "para", False), ("function_es", "que", False), ("function_fr", "que", False)]
GAZETTEER = [("was", "org_was", 1.0), ("have", "org_have", 0.9), ("avec", "place_avec", 0.95), ("dans", "place_dans", 0.85), ("mit", "place_mit", 0.9), ("von", "place_dans", 0.95)]


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


# Identity and duplicates --------------------------------------------------------------------------------------------


@query("select sha256(text) sha256_hash, count(*) copies, min(doc_id) first_doc from documents group by 1 having count(*) > 1")
def exact_duplicates(spark, sf):
    return dedup.exact_duplicates(fx.table(spark, sf, "documents"))


@query("select source, count(*) locations, count(distinct sha256(text)) unique_docs, greatest(0, count(*) - count(distinct sha256(text))) saved from documents group by rollup(source)")
def ledger_stats(spark, sf):
    return ledger.ledger_stats(fx.table(spark, sf, "documents").select(F.col("source").alias("root"), F.sha2("text", 256).alias("sha256_hash"))).withColumnRenamed("root", "source")


_SIMHASH = """
t as (select doc_id, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) c from documents),
g as (select doc_id, regexp_replace(c, '[^\\p{L}\\p{N}_]', '', 'g') k from t),
tok as (select doc_id, unnest(regexp_extract_all(c, '[\\p{L}\\p{N}_]+')) w from t
  union all select doc_id, substr(k, i, 3) w from (select doc_id, k, unnest(range(1, length(k) - 1)) i from g)),
cnt as (select doc_id, w, count(*) n from tok group by all),
h as (select doc_id, n, ('0x' || substr(md5(w), 1, 8))::bigint hi, ('0x' || substr(md5(w), 9, 8))::bigint lo from cnt),
b as (select doc_id, unnest(range(32)) b, unnest([""" + ", ".join(f"sum(n * (2 * ((hi >> {b}) & 1) - 1))" for b in range(32)) + "]) sh, unnest([" + ", ".join(f"sum(n * (2 * ((lo >> {b}) & 1) - 1))" for b in range(32)) + """]) sl from h group by doc_id),
fp as (select doc_id, sum(case when sh > 0 then (1::bigint << b) else 0 end)::bigint hi, sum(case when sl > 0 then (1::bigint << b) else 0 end)::bigint lo from b group by doc_id)
"""


@query(f"with {_SIMHASH} select d.doc_id, format('{{:08x}}{{:08x}}', coalesce(hi, 0), coalesce(lo, 0)) simhash_hex from documents d left join fp using (doc_id)")
def simhash_fingerprints(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select("doc_id", X.simhash_hex(X.simhash("text")).alias("simhash_hex"))


def _prints(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", X.simhash("text").alias("simhash"))


_PAIRS = _SIMHASH + """, grp as (select hi, lo, min(doc_id) first_doc, count(*) docs from fp where hi <> 0 or lo <> 0 group by hi, lo),
pairs as (select x.first_doc a, y.first_doc b, x.docs docs_a, y.docs docs_b, (bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)))::int distance from grp x join grp y on x.first_doc < y.first_doc and bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) <= 3)
"""


@query(f"with {_PAIRS} select *, round(1 - distance / 64.0, 4)::double similarity from pairs")
def near_duplicates(spark, sf):
    return dedup.near_pairs(dedup.fingerprint_groups(_prints(spark, sf)))


@query(f"with {_PAIRS.replace('<= 3', '<= 8')}, e as (select a first_doc, distance from pairs union all select b, distance from pairs), l as (select first_doc, count(*) links, min(distance) nearest from e group by all) select first_doc, docs, coalesce(links, 0) links, nearest from grp left join l using (first_doc)")
def near_links_k8(spark, sf):
    return dedup.near_links(dedup.fingerprint_groups(_prints(spark, sf)), 8)


@query(f"with {_PAIRS.replace('<= 3', '<= 12')}, e as (select a first_doc, distance from pairs union all select b, distance from pairs), l as (select first_doc, count(*) links, min(distance) nearest from e group by all) select first_doc, docs, coalesce(links, 0) links, nearest from grp left join l using (first_doc)")
def near_links_k12(spark, sf):
    return dedup.near_links(dedup.fingerprint_groups(_prints(spark, sf)), 12)


def _maturity(spark, sf):
    return X.with_maturity(fx.documents(spark, sf))


def _like(column: str, patterns: list[str]) -> str:
    return " + ".join(f"regexp_matches({column}, '{p}')::int" for p in patterns)


_MATURITY = f"""
n as (select doc_id, source, text, {fx.FILE_NAME} filename, lower(text) low, lower({fx.FILE_NAME}) fn from documents),
s as (select doc_id, source, fn, length(trim(text)) < 50 as small, regexp_matches(low, '{"|".join(X.CUT_MARKS)}') cut,
  {_like("right(low, 1500)", X.END_MARKS)} ends, {_like("low", X.STAMPS)} stamps, regexp_matches(right(low, 1000), '{X.WEAK_SIGNATURE}') weak,
  regexp_matches(fn, '(_|\\b)(final|def|definitive|signed|signe|unterschrieben)(\\.|\\b)') n1, regexp_matches(fn, '(_|\\b)(v[0-9]+(\\.[0-9]+)?|rev[0-9]+)(\\.|\\b)') n2,
  regexp_matches(fn, '(_|\\b)(draft|brouillon|entwurf|temp|tmp|wip)(\\.|\\b)') n3, regexp_matches(fn, '(_|\\b)(part|partial|tronque|truncated|copy|copie)(\\.|\\b)') n4,
  regexp_matches(fn, '(20[0-9]{{2}})[-_.]?(0[1-9]|1[0-2])[-_.]?(0[1-9]|[12][0-9]|3[01])') d1,
  regexp_matches(substr(text, 1, 2000), '\\b(20[0-9]{{2}})[-/.](0[1-9]|1[0-2])[-/.](0[1-9]|[12][0-9]|3[01])\\b') d2 from n),
p as (select doc_id, source, fn, small or cut truncated,
  case when small then 0.1 else round(greatest(0.0, least(1.0, 0.5 + least(0.35, 0.15 * ends) - 0.4 * cut::int)), 2) end::double completeness,
  case when stamps > 0 then least(0.9, 0.45 * stamps) when weak then 0.4 else 0 end::double signature,
  case when n1 then 0.9 when n2 then 0.7 when n3 then 0.15 when n4 then 0.2 else 0.5 end::double naming,
  case when d1 then 0.8 when d2 then 0.6 else 0.4 end::double date_score from s),
m as (select *, round(0.35 * completeness + 0.25 * signature + 0.2 * date_score + 0.2 * naming, 4)::double maturity from p),
l as (select *, case when truncated or fn like '%partial%' or fn like '%tronque%' then 'truncated' when naming >= 0.8 or signature >= 0.8 or maturity >= 0.75 then 'final'
  when naming <= 0.3 or fn like '%draft%' or fn like '%entwurf%' or maturity < 0.4 then 'draft' else 'review' end lifecycle from m)
"""


@query(f"with {_MATURITY} select doc_id, completeness, signature, naming, date_score, truncated, maturity, lifecycle from l")
def maturity_scores(spark, sf):
    return _maturity(spark, sf).select("doc_id", "completeness", "signature", "naming", "date_score", "truncated", "maturity", "lifecycle")


@query(f"with {_MATURITY} select source, lifecycle, count(*) docs, round(avg(maturity), 4) maturity from l group by all")
def lifecycle_counts(spark, sf):
    return _maturity(spark, sf).groupBy("source", "lifecycle").agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg("maturity"), 4).alias("maturity"))


_LINKS = f"{_PAIRS}, {_MATURITY}, links as (select a parent_doc, b child_doc, case when y.maturity > x.maturity then 'supersedes' else 'derived_from' end relationship, distance from pairs join l x on x.doc_id = a join l y on y.doc_id = b)"


@query(f"with {_LINKS} select * from links")
def version_chains(spark, sf):
    """A document's maturity is joined to its fingerprint, so the pairs, which are many more, need no join."""
    groups = dedup.fingerprint_groups(_prints(spark, sf)).join(_maturity(spark, sf).select(F.col("doc_id").alias("first_doc"), "maturity"), "first_doc")
    return dedup.version_links(dedup.near_pairs(groups, carried=("maturity",)))


@query(f"with {_LINKS} select relationship, count(*) links from links group by all")
def lineage_summary(spark, sf):
    return dedup.lineage_summary(version_chains(spark, sf))


_BY_DATE = lambda col, p, order, src: f"(case when regexp_matches({col}, '{p}') then (try_strptime({_part(col, p, order[0], True)} || '-' || {_part(col, p, order[1])} || '-' || {_part(col, p, order[2])}, '%Y-%m-%d')::date) end, '{src}')"


def _part(col: str, p: str, g: int, year: bool = False) -> str:
    got = f"regexp_extract({col}, '{p}', {g})" if g else "'01'"
    return f"(case when length({got}) = 2 then (case when {got} > '70' then '19' else '20' end) || {got} else {got} end)" if year else got


_DATES = [_BY_DATE("fn", p, g, "filename_prefix") for p, g in X.NAME_PREFIX] + [_BY_DATE("head", p, g, "content") for p, g in X.IN_TEXT] + [_BY_DATE("fn", p, g, "filename") for p, g in X.IN_NAME]


@query(
    f"with n as (select doc_id, trim({fx.FILE_NAME}) fn, substr(text, 1, 4000) head from documents), c as (select doc_id, [" + ", ".join(f"struct_pack(d := {x[1:].rpartition(', ')[0]}, s := {x[1:-1].rpartition(', ')[2]})" for x in _DATES) + "] c from n), "
    "f as (select doc_id, list_filter(c, lambda x: x.d is not null) f from c) select doc_id, coalesce(f[1].d, case when doc_id % 2 = 0 then date '2020-01-15' end)::varchar as \"date\", coalesce(f[1].s, case when doc_id % 2 = 0 then 'mtime' else 'unknown' end) as source from f"
)
def document_dates(spark, sf):
    docs = fx.documents(spark, sf).withColumn("mtime", F.when(F.col("doc_id") % 2 == 0, F.lit("2020-01-15 12:00:00").cast("timestamp")))
    return docs.select("doc_id", X.document_date(F.col("filename"), F.col("text"), F.col("mtime")).alias("d")).select("doc_id", F.col("d.date").cast("string").alias("date"), "d.source")


# The fingerprints of the items come from the same SQL over a table of both, items under negative numbers.
_BOTH = "both_ as (select doc_id, text from documents union all select -1 - item_id, text from benchmark), " + _SIMHASH.replace("from documents)", "from both_)")


_W = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"


@query(
    f"with {_BOTH}, {_MATURITY}, led as (select b.doc_id, sha256(text) h, coalesce(hi, 0) hi, coalesce(lo, 0) lo from both_ b left join fp using (doc_id)),"
    "ex as (select h, min(doc_id) exact_doc from led where doc_id >= 0 group by h), gr as (select hi, lo, max(maturity) maturity from led join l using (doc_id) where hi <> 0 or lo <> 0 group by hi, lo),"
    "nr as (select b.doc_id, count(*) near, max(maturity) best from led b join gr on bit_count(xor(b.hi, gr.hi)) + bit_count(xor(b.lo, gr.lo)) <= 12 where b.doc_id < 0 and (b.hi <> 0 or b.lo <> 0) group by b.doc_id),"
    f"iw as (select distinct -1 - item_id doc_id, unnest({_W}) w from benchmark), dw as (select distinct doc_id d, unnest({_W}) w from documents),"
    "rl as (select doc_id, min(d) related_doc from (select iw.doc_id, d, count(*) n from iw join dw using (w) group by all) join (select doc_id, count(*) n from iw group by all) using (doc_id, n) group by doc_id)"
    "select -1 - doc_id item_id, exact_doc, coalesce(near, 0) near, related_doc, case when exact_doc is not null then 'EXACT_MATCH' when near > 1 then 'MULTIPLE_MATCHES' when best >= 0.6 then 'EVOLVED_VERSION' when near = 1 then 'DRAFT_EXISTS' when related_doc is not null then 'RELATED_DOCUMENT' else 'NOT_FOUND' end category from led left join ex using (h) left join nr using (doc_id) left join rl using (doc_id) where doc_id < 0"
)
def duplicate_check(spark, sf):
    shaped = lambda t: t.withColumn("sha256_hash", F.sha2("text", 256)).withColumn("simhash", X.simhash("text"))
    docs, items = fx.table(spark, sf, "documents"), fx.table(spark, sf, "benchmark")
    related = retrieval.all_term_documents(docs, retrieval.query_terms(items.select(F.col("item_id").alias("query_id"), "text"))).withColumnRenamed("query_id", "item_id")
    return dedup.duplicate_check(shaped(items), shaped(_maturity(spark, sf)), related)


@query(
    f"with {_SIMHASH}, d as (select doc_id, text, sha256(text) h, {fx.FILE_NAME} fn from documents), p as (select doc_id, coalesce(hi, 0) hi, coalesce(lo, 0) lo from d left join fp using (doc_id)),"
    "q as (select doc_id query_id, case when doc_id % 150 = 0 then 'is ' || upper(h) || ' here' when doc_id % 100 = 0 then 'find \"' || fn || '\" now' else text end t, doc_id % 150 <> 0 and doc_id % 100 <> 0 whole from d where doc_id % 50 = 0),"
    "byh as (select query_id, doc_id, 'hash' signal from q join d on contains(lower(t), h)), byn as (select query_id, doc_id, 'name' from q join d on contains(lower(t), '\"' || lower(fn) || '\"') or lower(t) = lower(fn)),"
    "nr as (select query_id, y.doc_id, 'near' from q join p x on x.doc_id = query_id join p y on bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) <= 12 and (y.hi <> 0 or y.lo <> 0) where whole and (x.hi <> 0 or x.lo <> 0) and len(regexp_extract_all(t, '[\\p{L}\\p{N}_]+')) >= 8)"
    "select distinct * from (from byh union all from byn union all from nr)"
)
def exact_signals(spark, sf):
    """Every 50th document asks: by its hash, by its file name, or with its whole text."""
    hashed = fx.documents(spark, sf).withColumn("sha256_hash", F.sha2("text", 256))
    docs = hashed.withColumn("simhash", X.simhash("text"))
    asked = hashed.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 150 == 0, F.concat(F.lit("is "), F.upper("sha256_hash"), F.lit(" here"))).when(F.col("doc_id") % 100 == 0, F.concat(F.lit('find "'), "filename", F.lit('" now'))).otherwise(F.col("text")).alias("text"))
    return retrieval.exact_signals(docs, asked.withColumn("simhash", F.when(~F.col("text").rlike('^(is |find ")'), X.simhash("text")).otherwise(F.lit(0).cast("long"))))


# Text and retrieval -------------------------------------------------------------------------------------------------


@query(
    """with p as (select doc_id, list_transform(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\n{2,}'), lambda p: list_filter(regexp_split_to_array(p, '\\s+'), lambda w: w <> '')) ps from documents),
w as (select doc_id, flatten(list_transform(list_filter(ps, lambda p: len(p) > 0), lambda p: list_append(p, chr(10) || chr(10)))) w from p),
c as (select doc_id, w, unnest(range(0, len(w), 520)) i from w)
select doc_id, (i // 520)::int chunk_index, len(w[i + 1 : i + 600])::int token_count, md5(regexp_replace(replace(array_to_string(w[i + 1 : i + 600], ' '), ' ' || chr(10) || chr(10) || ' ', chr(10) || chr(10)), '^\\s+|\\s+$', '', 'g')) text_md5 from c"""
)
def chunks(spark, sf):
    return retrieval.chunks(fx.table(spark, sf, "documents")).select("doc_id", "chunk_index", "token_count", F.md5("chunk_text").alias("text_md5"))


def _queries(spark, sf):
    """Each benchmark item as a retrieval query."""
    return fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
_BM25 = f"""
q as (select distinct item_id query_id, unnest(list_distinct({_WORDS})) term from benchmark),
dl as (select doc_id, regexp_extract_all(lower(concat_ws(' ', {fx.FILE_NAME}, text)), '[\\p{{L}}\\p{{N}}_]+') w from documents), tot as (select count(*) n, avg(len(w)) avg_len from dl),
tf as (select doc_id, len, term, count(*) tf from (select doc_id, len(w) len, unnest(w) term from dl) where term in (select term from q) group by all),
df as (select term, count(*) df from tf group by term),
need as (select query_id, count(*) need from q group by all),
sc as (select query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) s, count(*) found from q join tf using (term) join df using (term), tot group by all)
"""
_TOP5 = "select query_id, doc_id, score, r::int as \"rank\" from (select *, row_number() over (partition by query_id order by score desc, doc_id) r from scored) where r <= 5"


@query(f"with {_BM25}, scored as (select query_id, doc_id, round(s, 6) score from sc join need using (query_id) where found = need) {_TOP5}")
def bm25_search(spark, sf):
    return retrieval.bm25(fx.documents(spark, sf), _queries(spark, sf))


_ASKED = """case item_id % 4 when 1 then 'find "note src' || item_id % 5 || ' 20191105 x.txt"' when 2 then array_to_string(list_transform(W[1:6], lambda w: substr(w, 1, 4)), ' ')
  when 3 then array_to_string(list_transform(W[1:6], lambda w: substr(w, 2, 4)), ' ') else text end""".replace("W", _WORDS)
_TIERS = f"""n as (select doc_id, {fx.FILE_NAME} fn, text from documents), q as (select item_id query_id, {_ASKED} t from benchmark),
dl as (select doc_id, regexp_extract_all(lower(concat_ws(' ', fn, text)), '[\\p{{L}}\\p{{N}}_]+') w from n), tot as (select count(*) n, avg(len(w)) avg_len from dl),
tf as (select doc_id, len, term, count(*) tf from (select doc_id, len(w) len, unnest(w) term from dl) group by all), df as (select term, count(*) df from tf group by term),
qw as (select query_id, list_distinct(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+')) ws, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+') ordered from q),
pos as (select query_id, w, min(i) i from (select query_id, unnest(ordered) w, generate_subscripts(ordered, 1) i from qw) group by all), tok as (select query_id, w, row_number() over (partition by query_id order by i) k from pos),
t0 as (select distinct query_id, doc_id, 100.0 score from q join n on lower(t) = lower(fn) or contains(lower(t), '"' || lower(fn) || '"') or lower(t) = regexp_replace(lower(fn), '\\.[a-z0-9]+$', '')),
wt as (select doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) s from tf join df using (term), tot),
t1 as (select query_id, doc_id, round(sum(s), 6) score from tok join wt on w = term where query_id not in (select query_id from t0) group by query_id, doc_id having count(*) = any_value((select len(ws) from qw where qw.query_id = tok.query_id))),
e2 as (select distinct query_id, term from tok join df on case when length(w) < 3 then term = w else starts_with(term, w) end where k <= 4 and query_id not in (select query_id from t0 union all select query_id from t1)),
t2 as (select query_id, doc_id, round(sum(s), 6) score from e2 join wt using (term) group by all),
e3 as (select distinct query_id, term from tok join df on case when length(w) < 3 then term = w else contains(term, w) end where k <= 3 and query_id not in (select query_id from t0 union all select query_id from t1 union all select query_id from t2)),
t3 as (select query_id, doc_id, round(sum(s), 6) score from e3 join wt using (term) group by all),
scored as (select *, 0 tier from t0 union all select *, 1 from t1 union all select *, 2 from t2 union all select *, 3 from t3)"""


@query(f"with {_TIERS} select query_id, doc_id, score::double score, r::int as \"rank\", tier from (select *, row_number() over (partition by query_id order by score desc, doc_id) r from scored) where r <= 5")
def search_cascade(spark, sf):
    """Items ask by their text, by a file name, by beginnings of words and by inner parts of words."""
    w = X.words(F.col("text"))
    cut = lambda at: F.array_join(F.transform(F.slice(w, 1, 6), lambda x: F.substring(x, at, 4)), " ")
    kind = F.col("item_id") % 4
    text = F.when(kind == 1, F.concat(F.lit('find "note src'), (F.col("item_id") % 5).cast("string"), F.lit(' 20191105 x.txt"'))).when(kind == 2, cut(1)).when(kind == 3, cut(2)).otherwise(F.col("text"))
    return retrieval.cascade(fx.documents(spark, sf), fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("text")))


_VECTOR = """v as (select vec_id, embedding::double[] v from embeddings), q as (select vec_id query_id, v q from v where vec_id % 50 = 0),
scored as (select query_id, vec_id doc_id, round(list_cosine_similarity(q, v), 6) score from q join v on vec_id <> query_id)"""


def _probe(spark, sf):
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    return e, e.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))


@query(f"with {_VECTOR} select query_id, doc_id, score, r::int as \"rank\" from (select *, row_number() over (partition by query_id order by score desc, doc_id) r from scored where score >= 0.25) where r <= 10")
def vector_topk(spark, sf):
    return retrieval.vector_topk(*_probe(spark, sf))


_RRF = f"""{_VECTOR}, {_BM25.replace(chr(10) + "q as", chr(10) + "bq as").replace(" from q)", " from bq)").replace("from q group", "from bq group").replace("from q join tf", "from bq join tf")},
dense as (select query_id, doc_id, r from (select *, row_number() over (partition by query_id order by score desc, doc_id) r from scored where score >= 0.25) where r <= 10),
bs as (select query_id, doc_id, round(s, 6) score from sc), sparse as (select query_id, doc_id, r from (select *, row_number() over (partition by query_id order by score desc, doc_id) r from bs) where r <= 10),
ex as (select item_id query_id, min(doc_id) doc_id from benchmark b join documents d on contains(d.text, b.text) group by all),
fused as (select query_id, doc_id, round(sum(s), 6) score from (select query_id, doc_id, 1 / (60 + r) s from dense union all select query_id, doc_id, 1 / (60 + r) from sparse union all select query_id, doc_id, 1 / 60.5 + 0.05 from ex) group by all)
"""


def _exact_passage(spark, sf):
    """First document that holds a whole benchmark passage, as it is written; all passages are met in one pass."""
    docs, items = fx.table(spark, sf, "documents"), fx.table(spark, sf, "benchmark").where("text <> ''")
    held = phrase_hits(docs, F.col("text"), items.select(F.col("text").alias("phrase")), as_written=True).select("doc_id", "phrase")
    found = held.join(items.select(F.col("item_id").alias("query_id"), F.col("text").alias("phrase")), "phrase")
    return found.groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))


@query(f"with {_RRF} select query_id, doc_id, score, r::int as \"rank\" from (select *, row_number() over (partition by query_id order by score desc, doc_id) r from fused) where r <= 10")
def hybrid_rrf(spark, sf):
    dense = retrieval.vector_topk(*_probe(spark, sf))
    sparse = retrieval.bm25(fx.documents(spark, sf), _queries(spark, sf), 10, all_terms=False)
    return retrieval.reciprocal_rank_fusion([dense, sparse], _exact_passage(spark, sf))


@query(
    f"with {_MATURITY}, {_BM25}, scored0 as (select query_id, doc_id, round(s, 6) sc0, found / need overlap from sc join need using (query_id)), r0 as (select *, row_number() over (partition by query_id order by sc0 desc, doc_id) r from scored0), "
    "scored as (select query_id, r0.doc_id, round(40 * round(1 / (60 + r), 6) + 0.35 * overlap + 0.25 * maturity + 0.1 * (lifecycle = 'final')::int, 6) score from r0 join l using (doc_id) where r <= 10) " + _TOP5
)
def rerank(spark, sf):
    docs, queries_ = fx.documents(spark, sf), _queries(spark, sf)
    terms = retrieval.query_terms(queries_)
    top = retrieval.bm25_terms(docs, terms, 10, all_terms=False, counted=True).drop("score")
    need = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    asked = docs.join(F.broadcast(top.select("doc_id").distinct()), "doc_id", "left_semi")  # ten documents a query
    rows = top.join(need, "query_id").join(X.with_maturity(asked).select("doc_id", "maturity", "lifecycle"), "doc_id")
    rows = rows.select("query_id", "doc_id", F.round(1 / (60 + F.col("rank")), 6).alias("rrf"), (F.col("found") / F.col("need")).alias("overlap"), "maturity", F.lit(False).alias("is_exact"), (F.col("lifecycle") == "final").alias("is_final"))
    return retrieval.rerank(rows).select("query_id", "doc_id", "score", "rank")


@query("select vec_id, label, len(embedding)::int dims, len(list_filter(embedding, lambda x: x <> 0))::int filled from embeddings")
def embedding_health(spark, sf):
    return refresh.embedding_health(fx.table(spark, sf, "embeddings"))


@query(
    "with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) t, generate_subscripts(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), 1) - 1 i from documents), "
    "s as (select doc_id, ('0x' || substr(sha256(t), 1, 8))::bigint % 64 k, sum(1 / (1 + 0.05 * i)) v from w group by all) select doc_id, round(max(v) / sqrt(sum(v * v)), 5) top, count(*) filled from s group by all"
)
def hashed_embeddings(spark, sf):
    v = fx.table(spark, sf, "documents").select("doc_id", X.hashed_embedding(F.col("text")).alias("v"))
    filled = F.size(F.filter("v", lambda x: x > 0)).cast("long")
    return v.select("doc_id", F.round(F.array_max("v"), 5).alias("top"), filled.alias("filled")).where("filled > 0")


# Classification -----------------------------------------------------------------------------------------------------


@query(
    f"with k(category, keyword, is_child) as (values {values(KEYWORDS)}), w as (select distinct doc_id, unnest({_WORDS}) keyword from documents), "
    "h as (select doc_id, category, is_child, count(*) hits from w join k using (keyword) group by all), c as (select *, round(least(0.95, 0.72 + 0.08 * hits) + 0.05 * is_child::int, 4)::double confidence from h) "
    "select doc_id, category, hits, confidence from (select *, row_number() over (partition by doc_id order by confidence desc, category) r from c where confidence > 0.5) where r = 1"
)
def keyword_classes(spark, sf):
    kw = spark.createDataFrame(KEYWORDS, "category string, keyword string, is_child boolean")
    return taxonomy.classify(fx.table(spark, sf, "documents"), kw)


@query("select lang, count(*) docs, sum(regexp_matches(lower(text), '@')::int)::bigint mail, sum(regexp_matches(lower(text), 'token|password')::int)::bigint secret, round(100 * sum(regexp_matches(lower(text), '@')::int) / count(*), 2) mail_pct, round(100 * sum(regexp_matches(lower(text), 'token|password')::int) / count(*), 2) secret_pct from documents group by lang")
def label_breakdown(spark, sf):
    return taxonomy.label_breakdown(fx.table(spark, sf, "documents"), {"mail": "@", "secret": "token|password"}, "lang")


@query(f"with g(term, node_id, confidence) as (values {values(GAZETTEER)}), w as (select distinct doc_id, unnest({_WORDS}) term from documents) select doc_id, node_id, max(confidence)::double confidence from w join g using (term) group by all")
def entity_links(spark, sf):
    return taxonomy.mentions(fx.table(spark, sf, "documents"), spark.createDataFrame(GAZETTEER, "term string, node_id string, confidence double"))


@query(f"with g(term, node_id, confidence) as (values {values(GAZETTEER)}), w as (select distinct doc_id, unnest({_WORDS}) term from documents) select term, count(*) docs from w semi join g using (term) group by all")
def keyword_documents(spark, sf):
    """Documents that mention each keyword of a list."""
    return taxonomy.keyword_documents(fx.table(spark, sf, "documents"), spark.createDataFrame([(t,) for t, _, _ in GAZETTEER], "term string"))


_RULES_SQL = """case when lower(name) like '%red%' then 'colour_red' when size > 40 then 'large' when type like '%TIN%' or type like '%tin%' then 'tin' else category end"""


def _parts(spark, sf):
    p = fx.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("category"), F.col("p_size").alias("size"), F.col("p_type").alias("type"))


def _rules():
    return [("red", F.lower("name").contains("red"), "colour_red", 0.95), ("large", F.col("size") > 40, "large", 0.9), ("tin", F.col("type").contains("TIN") | F.col("type").contains("tin"), "tin", 0.85)]


@query(f"with p as (select p_partkey id, p_name name, p_brand category, p_size size, p_type \"type\" from part), r as (select category old_category, {_RULES_SQL.replace(' type ', ' \"type\" ')} new_category from p) select old_category, new_category, count(*) docs from r where old_category <> new_category group by all")
def evolution(spark, sf):
    _, audit = taxonomy.evolve(_parts(spark, sf), _rules(), "v2", dry_run=True)
    return audit.groupBy("old_category", "new_category").agg(F.sum("docs").alias("docs"))


@query(f"with p as (select p_partkey id, p_name name, p_brand category, p_size size, p_type \"type\" from part), r as (select id, category was, {_RULES_SQL.replace(' type ', ' \"type\" ')} category from p) select category, count(*) docs, sum((was <> category)::int)::bigint requeued, round(100 * sum((was <> category)::int) / count(*), 2) migrated_pct from r group by all")
def evolution_status(spark, sf):
    led, _ = taxonomy.evolve(_parts(spark, sf), _rules(), "v2")
    moved = F.sum(F.col("requeue").cast("long"))
    return led.groupBy("category").agg(F.count(F.lit(1)).alias("docs"), moved.alias("requeued"), F.round(100 * moved / F.count(F.lit(1)), 2).alias("migrated_pct"))


@query("select case when p_brand in ('Brand#11', 'Brand#12', 'Brand#1', 'Brand#2') then 'Brand#13' else p_brand end category, count(*) docs from part group by all")
def category_merge(spark, sf):
    mapping = spark.createDataFrame([(b, "Brand#13") for b in ("Brand#11", "Brand#12", "Brand#1", "Brand#2")], "source string, target string")
    docs = _parts(spark, sf)
    tagged, _ = taxonomy.merge_categories(docs, docs.select("category", F.array("type").alias("keywords")), mapping)
    return tagged.groupBy("category").agg(F.count(F.lit(1)).alias("docs"))


@query("with u as (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') p from pages) select array_to_string(string_split(p, '/')[1:2], '/') folder, count(*) docs from u group by all")
def folder_topology(spark, sf):
    return ledger.folder_topology(fx.table(spark, sf, "pages").select(F.col("url").alias("path")))


@query(None)
def markup_text(spark, sf):
    return files.markup_text(fx.table(spark, sf, "pages"))


@query("with n as (select c_custkey, c_name, regexp_replace(regexp_replace(trim(lower(c_name)), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '[\\s-]+', '_', 'g') own from customer) select c_custkey, case when starts_with(own, 'customer_') then own else 'customer_' || own end node_id, length(c_name) between 3 and 55 clean from n")
def name_slugs(spark, sf):
    c = fx.table(spark, sf, "customer")
    return c.select("c_custkey", X.slug(F.lit("customer"), F.col("c_name")).alias("node_id"), X.is_clean_party(F.col("c_name"), []).alias("clean"))


# Graph --------------------------------------------------------------------------------------------------------------


@query("with p as (select distinct l_orderkey d, l_partkey p from lineitem), s as (select distinct l_orderkey d, l_suppkey s from lineitem) select p src, s dst, count(*) weight, 'seen_with' relation from p join s using (d) group by all")
def cooccurrence_edges(spark, sf):
    items = fx.table(spark, sf, "lineitem")
    return graph.cooccurrence(items.select("l_orderkey", F.col("l_partkey").alias("src")), items.select("l_orderkey", F.col("l_suppkey").alias("dst")), "l_orderkey", "seen_with")


_STATS = f"""{fx.LINKS_SQL}, {fx.EDGES_SQL}, n as (select 'p' || p_partkey node_id, 'part' node_type from part union all select 's' || s_suppkey, 'supplier' from supplier),
deg as (select node_id, count(*) degree from (select src node_id from edges union all select dst from edges) group by all), dc as (select node_id, count(*) docs from links group by all),
stats as (select node_id, node_type, coalesce(degree, 0) degree, coalesce(docs, 0) docs from n left join deg using (node_id) left join dc using (node_id))"""


def _stats(spark, sf):
    return graph.node_stats(fx.nodes(spark, sf), fx.edges(spark, sf), fx.links(spark, sf)).select("node_id", "node_type", "degree", "docs")


@query(f"with {_STATS} select * from stats")
def node_degree(spark, sf):
    return _stats(spark, sf)


@query(f"with {_STATS} select node_type, count(*) nodes, sum(degree)::bigint degree, max(docs) most_docs from stats group by all")
def graph_stats(spark, sf):
    return graph.graph_stats(_stats(spark, sf))


@query(f"with {_STATS} select node_id, node_type, degree * 2 + docs * 5 score from (select *, row_number() over (partition by node_type order by degree * 2 + docs * 5 desc, node_id) r from stats) where r <= 25")
def stratified_nodes(spark, sf):
    return graph.stratified_nodes(_stats(spark, sf), 25).select("node_id", "node_type", "score")


@query(f"with {_STATS} select node_id, degree, docs from stats where degree <= 4 and docs <= 5")
def low_degree_candidates(spark, sf):
    return graph.low_degree_candidates(_stats(spark, sf), 4, 5).select("node_id", "degree", "docs")


@query("with d as (select o_orderkey doc_id, o_orderpriority theme, o_custkey::varchar || '-' || o_orderstatus name, o_orderstatus = 'O' pending from orders), a as (select *, row_number() over (partition by theme, name order by pending desc, doc_id) r from d) select doc_id, theme, pending from (select *, row_number() over (partition by theme order by pending desc, doc_id) k from a where r = 1) where k <= 45")
def stratified_docs(spark, sf):
    d = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("theme"), F.concat(F.col("o_custkey").cast("string"), F.lit("-"), "o_orderstatus").alias("name"), (F.col("o_orderstatus") == "O").alias("pending"))
    return graph.stratified_documents(d, 45).select("doc_id", "theme", "pending")


_SEEDS = ["p1", "p2", "s3"]
_SEEDS_SQL = "seeds(node_id) as (values ('p1'), ('p2'), ('s3'))"


def _seeds(spark):
    return spark.createDataFrame([(s,) for s in _SEEDS], "node_id string")


@query(f"with {fx.LINKS_SQL}, {_SEEDS_SQL} select a.node_id seed, b.node_id, count(*) shared from links a join links b using (doc) where a.node_id in (from seeds) and b.node_id not in (from seeds) group by all")
def shared_docs(spark, sf):
    return graph.shared_neighbours(fx.links(spark, sf), _seeds(spark))


@query(f"with {fx.LINKS_SQL} select distinct a.doc from links a join links b using (doc) where a.node_id in ('p1', 'p2', 'p3', 'p4', 'p5', 'p6', 'p7', 'p8', 'p9') and b.node_id in ('s1', 's2', 's3', 's4', 's5', 's6', 's7', 's8', 's9')")
def bridging_documents(spark, sf):
    of = lambda k: spark.createDataFrame([(f"{k}{i}",) for i in range(1, 10)], "node_id string")
    return graph.bridging_documents(fx.links(spark, sf), of("p"), of("s"))


@query(f"with {fx.EDGES_SQL}, {_SEEDS_SQL}, b as (select src x, dst y from edges union select dst, src from edges), h1 as (select distinct node_id seed, y from seeds join b on x = node_id), h2 as (select distinct seed, b.y from h1 join b on b.x = h1.y) select seed, y node_id, min(hop)::int hop from (select seed, y, 1 hop from h1 union all select seed, y, 2 from h2) where seed <> y group by all")
def neighborhood_2hop(spark, sf):
    return graph.neighbourhood(fx.edges(spark, sf), _seeds(spark))


@query(f"with {fx.EDGES_SQL} select src, dst, weight from edges where src in (select 'p' || p_partkey from part where p_size > 25) and dst in (select 's' || s_suppkey from supplier where s_acctbal > 0)")
def induced_subgraph(spark, sf):
    parts = fx.table(spark, sf, "part").where("p_size > 25").select(F.concat(F.lit("p"), "p_partkey").alias("node_id"))
    kept = parts.unionAll(fx.table(spark, sf, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node_id")))
    return graph.induced_subgraph(fx.edges(spark, sf), kept, None).select("src", "dst", "weight")


@query(f"with {fx.EDGES_SQL} select relation, count(*) edges, sum(weight)::bigint weight from (select *, 'supplied_by' relation from edges) group by all")
def relation_counts(spark, sf):
    return graph.relation_counts(fx.edges(spark, sf))


@query(f"with {fx.EDGES_SQL}, m as (select case when substr(src, 2)::int % 10 = 7 then 'p1' else src end src, dst, weight from edges) select src, dst, 'supplied_by' relation, max(weight) weight from m group by all")
def entity_consolidation(spark, sf):
    mapping = fx.nodes(spark, sf).where("node_type = 'part'").select(F.col("node_id").alias("alias")).where(F.substring("alias", 2, 20).cast("int") % 10 == 7).withColumn("canonical", F.lit("p1"))
    return graph.consolidate(fx.edges(spark, sf), mapping)


@query(f"with {fx.EDGES_SQL}, light as (select * from edges where weight >= 2), n as (select 'p' || p_partkey node_id, p_name name from part union all select 's' || s_suppkey, s_name from supplier) select node_id from n where node_id not in (select src from light union select dst from light)")
def orphan_nodes(spark, sf):
    return graph.orphans(fx.nodes(spark, sf), fx.edges(spark, sf).where("weight >= 2")).select("node_id")


@query("with recursive h(geo_id, parent_id) as (select 'world', null union all select 'r' || r_regionkey, 'world' from region union all select 'n' || n_nationkey, 'r' || n_regionkey from nation), t(geo_id, level) as (select geo_id, 0 from h where geo_id = 'world' union all select h.geo_id, t.level + 1 from h join t on h.parent_id = t.geo_id) select geo_id, level, count(c_custkey) customers, round(sum(c_acctbal), 2) balance from t left join customer on 'n' || c_nationkey = geo_id group by all")
def region_rollup(spark, sf):
    r, n = fx.table(spark, sf, "region"), fx.table(spark, sf, "nation")
    h = spark.sql("select 'world' as geo_id, cast(null as string) as parent_id").unionAll(r.select(F.concat(F.lit("r"), "r_regionkey"), F.lit("world"))).unionAll(n.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")))
    tree = graph.descendants(h, "world")
    c = fx.table(spark, sf, "customer").groupBy(F.concat(F.lit("n"), "c_nationkey").alias("geo_id")).agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return tree.join(c, "geo_id", "left").na.fill(0, ["customers"]).select("geo_id", "level", "customers", "balance")


@query("select n_name child, r_name parent, 'part_of' relation from nation join region on n_regionkey = r_regionkey")
def admin_edges(spark, sf):
    n, r = fx.table(spark, sf, "nation"), fx.table(spark, sf, "region")
    return graph.part_of_edges(n.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent_id")), r.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))


_RANGES = [(1, 10, "general", 1), (5, 20, "persons", 2), (21, 40, "things", 3)]


@query("select p_partkey article_id, p_size \"number\", case when p_size = 7 then 'special' when p_size between 1 and 10 then 'general' when p_size between 5 and 20 then 'persons' when p_size between 21 and 40 then 'things' end topic from part")
def article_topics(spark, sf):
    p = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("article_id"), F.col("p_size").alias("number"))
    return graph.range_topics(p, spark.createDataFrame(_RANGES, "lo int, hi int, topic string, seq int"), spark.createDataFrame([(7, "special")], "number int, topic string"))


_LIGHT = f"{fx.LINKS_SQL}, {fx.EDGES_SQL}, light as (select * from edges where weight >= 2), n as (select 'p' || p_partkey node_id from part union all select 's' || s_suppkey from supplier), alone as (select node_id from n where node_id not in (select src from light union select dst from light))"


@query(f"with {_LIGHT}, nb as (select a.node_id seed, b.node_id, count(*) shared from links a join links b using (doc) where a.node_id in (from alone) and b.node_id not in (from alone) group by all) select seed src, min_by(node_id, (-shared, node_id)) dst, case when seed[1] = 's' or min_by(node_id, (-shared, node_id))[1] = 's' then 'SUPPLIED_BY' else 'CO_OCCURS' end relation, max(shared) weight from nb group by seed")
def bridged_nodes(spark, sf):
    return graph.bridge_isolated(fx.nodes(spark, sf), fx.edges(spark, sf).where("weight >= 2"), fx.links(spark, sf), bridges=(("supplier", "SUPPLIED_BY"),))


@query("select 'd' || l_orderkey doc, 's' || l_suppkey node_id from lineitem join supplier on l_suppkey = s_suppkey where s_acctbal > 0 group by all")
def mirrored_links(spark, sf):
    items = fx.table(spark, sf, "lineitem")
    e = items.select(F.concat(F.lit("doc_d"), "l_orderkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    n = fx.table(spark, sf, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node_id"))
    return graph.mirror_document_edges(e, n, fx.table(spark, sf, "orders").select(F.concat(F.lit("d"), "o_orderkey").alias("doc")))


@query("with t as (select p_brand brand, count(*) total, sum((p_size <= 25)::int)::bigint rendered from part group by all) select *, round(100 * rendered / total, 1) pct, rendered < total capped from t")
def cluster_representativity(spark, sf):
    p = fx.table(spark, sf, "part").select(F.col("p_brand").alias("brand"), "p_size")
    return graph.representativity(p, p.where("p_size <= 25"), "brand")


@query("select o_custkey doc_id, o_orderstatus node_id, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) roles from orders group by all")
def pair_roles(spark, sf):
    return taxonomy.roles_of_pairs(fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("node_id"), F.col("o_orderpriority").alias("role")))


@query("select s_suppkey node_id, s_name as \"name\", case when s_suppkey % 4 = 0 then 'purge' when s_suppkey % 4 = 1 then 'location' else 'retain' end outcome from supplier")
def certification(spark, sf):
    c = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_name").alias("name"))
    verdicts = c.where("node_id % 4 < 2").select(F.upper("name").alias("name"), F.when(F.col("node_id") % 4 == 0, "purge").otherwise("location").alias("verdict"))
    return taxonomy.certify(c, verdicts)


# Obligations --------------------------------------------------------------------------------------------------------


@query(f"with {fx.ACTIONS_SQL} select action_id, c_name party, status, due, status = 'pending' and due < timestamp '{AS_OF}' overdue from actions left join customer on c_custkey = party where status = 'pending'")
def open_actions(spark, sf):
    return A.open_actions(fx.actions(spark, sf), fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("party"), F.col("c_name").alias("name")), _as_of())


@query(f"with {fx.ACTIONS_SQL} select action_id, status, due from actions order by (status <> 'pending'), not (status = 'pending' and due < timestamp '{AS_OF}'), due, action_id desc limit 100")
def most_urgent_actions(spark, sf):
    return A.with_urgency(fx.actions(spark, sf), _as_of()).orderBy(*A.urgency()).select("action_id", "status", "due").limit(100)


@query(f"with {fx.ACTIONS_SQL}, e as (select l_orderkey action_id, l_shipdate as \"at\", l_linenumber::int n from lineitem where l_returnflag = 'N'), f as (select action_id, \"at\", n, row_number() over (partition by action_id order by \"at\", n) r from e join actions using (action_id) where \"at\" >= \"start\") select action_id, n evidence_id, \"at\" fulfilled_at from f where r = 1")
def fulfilment(spark, sf):
    e = fx.table(spark, sf, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("action_id"), F.col("l_shipdate").alias("at"), F.col("l_linenumber").cast("int").alias("evidence_id"))
    return A.first_fulfilment(fx.actions(spark, sf), e)


@query(f"with {fx.ACTIONS_SQL} select action_type, count(*) total, sum((status = 'pending')::int)::bigint pending, sum((status = 'pending' and due < timestamp '{AS_OF}')::int)::bigint overdue, sum((status = 'completed')::int)::bigint completed from actions group by all")
def action_stats(spark, sf):
    return A.action_stats(fx.actions(spark, sf), _as_of())


@query(f"with {fx.ACTIONS_SQL}, d as (select o_orderpriority theme, count(*) docs, sum((o_orderdate > timestamp '{AS_OF}' - interval 7 day and o_orderdate <= timestamp '{AS_OF}')::int)::bigint velocity from orders group by all), a as (select theme, sum((status = 'pending')::int)::bigint pending, sum((status = 'pending' and due < timestamp '{AS_OF}')::int)::bigint overdue from actions group by all) select theme, docs, velocity, pending, overdue, round(ln(1 + docs) + 2.5 * velocity + 3 * pending + 5 * overdue, 4)::double gravity from d join a using (theme)")
def gravity(spark, sf):
    o = fx.table(spark, sf, "orders")
    docs = o.select(F.col("o_orderpriority").alias("theme"), F.col("o_orderdate").alias("created"))
    return A.gravity(docs.select("theme").distinct(), docs, fx.actions(spark, sf), _as_of())


@query("with a as (select doc_id, unnest(regexp_extract_all(text, '([0-9]+(?:\\.[0-9]{2})?)')) t from documents), t as (select distinct doc_id, case when contains(t, '.') then t else t || '.00' end amount from a), k as (select l_orderkey action_id, l_orderkey source_doc, printf('%.2f', l_quantity) amount from lineitem) select distinct action_id, doc_id from k join t using (amount) where doc_id <> source_doc")
def amount_mentions(spark, sf):
    k = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("action_id"), F.col("l_orderkey").alias("source_doc"), F.col("l_quantity").alias("amount"))
    return A.amount_matches(k, fx.table(spark, sf, "documents"))


# Review -------------------------------------------------------------------------------------------------------------


@query("select doc_id, 'src' || doc_id % 7 node_id, quality / 1.0 + 0.0 confidence from labels where quality = 1 and toxic = 0 and doc_id % 5 <> 0")
def author_queue(spark, sf):
    l = fx.table(spark, sf, "labels")  # noqa: E741
    c = l.select("doc_id", F.concat(F.lit("src"), (F.col("doc_id") % 7).cast("string")).alias("node_id"), F.lit("qualified").alias("status"), F.col("quality").cast("double").alias("confidence"), (F.col("toxic") == 0).alias("verified"))
    return taxonomy.author_queue(c, c.where("doc_id % 5 = 0")).select("doc_id", "node_id", "confidence")


@query("with l as (select source node_id, doc_id, quality from documents join labels using (doc_id)), d as (select node_id, doc_id, max(quality) a from l group by all) select node_id, sum(a)::bigint as_author, sum(1 - a)::bigint other, sum(a) >= 10 corroborated from d group by all")
def author_corroboration(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", F.col("source").alias("node_id")).join(fx.table(spark, sf, "labels"), "doc_id")
    return taxonomy.corroboration(d.select("node_id", "doc_id", F.when(F.col("quality") == 1, "author").otherwise("reader").alias("role")))


@query("select node_id, doc_id from (select source node_id, doc_id, row_number() over (partition by source order by doc_id) r from documents) where r <= 3")
def author_documents(spark, sf):
    return taxonomy.first_documents(fx.table(spark, sf, "documents").select(F.col("source").alias("node_id"), "doc_id"), 3).select("node_id", "doc_id")


# Ledger -------------------------------------------------------------------------------------------------------------


@query("select conv_id, turn, role, length(text)::int n from (select *, row_number() over (partition by conv_id order by turn desc) r from conversations) where r = 1")
def history_latest(spark, sf):
    return ledger.latest(fx.table(spark, sf, "conversations"), ["conv_id"], [F.desc("turn")]).select("conv_id", "turn", "role", F.length("text").alias("n"))


@query("select user_id, max_by(event_type, event_id) event_type, max_by(value, event_id) filter (value > 50) value, max(event_id) event_id from events group by user_id")
def upsert_latest(spark, sf):
    e = fx.table(spark, sf, "events").select("user_id", "event_type", F.when(F.col("value") > 50, F.col("value")).alias("value"), "event_id")
    return ledger.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], "event_id", ("value",))


_LISTING = f"with n as (select sha256(text) h, doc_id, source, {fx.FILE_NAME} name from documents), c as (select h, count(*) copies from n group by all), d as (select *, row_number() over (partition by h order by doc_id) r from n)"


@query(f"{_LISTING} select name, doc_id, copies from d join c using (h) where r = 1 and contains(lower(name), 'src1') and copies > 1 order by lower(name), doc_id limit 50 offset 5")
def ledger_listing(spark, sf):
    d = fx.documents(spark, sf).withColumn("sha256_hash", F.sha2("text", 256)).withColumnRenamed("filename", "name").withColumns({"doc_date": F.lit(None).cast("timestamp"), "created": F.lit(None).cast("timestamp"), "mtime": F.lit(AS_OF).cast("timestamp")})
    first = ledger.latest(d, ["sha256_hash"], [F.asc("doc_id")]).drop("mtime")
    return ledger.listing(first, d.select("sha256_hash", "mtime"), "src1", True, [F.lower("name"), F.col("doc_id")], 5, 50).select("name", "doc_id", "copies")


@query("with n as (select sha256(text) h, doc_id, source from documents) select h sha256_hash, list(source order by doc_id)::varchar[] as roots from n group by h")
def document_locations(spark, sf):
    n = fx.table(spark, sf, "documents").select(F.sha2("text", 256).alias("sha256_hash"), F.concat_ws("/", F.lpad(F.col("doc_id").cast("string"), 12, "0"), "source").alias("path"), F.lit(0).alias("mtime"), F.lit(False).alias("is_primary"))
    known = n.select("sha256_hash").distinct()
    nested = ledger.with_locations(known.where("sha256_hash is not null"), n)
    nameless = n.where("sha256_hash is null").groupBy("sha256_hash").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    paths = nested.select("sha256_hash", F.transform("locations", lambda x: x["path"]).alias("paths")).unionByName(nameless)
    return paths.select("sha256_hash", F.transform("paths", lambda p: F.substring_index(p, "/", -1)).alias("roots"))


@query("with n as (select source root, sha256(text) h, doc_id, row_number() over (partition by sha256(text) order by doc_id) r from documents) select root, sum((r = 1)::int)::bigint as \"new\", sum((r > 1)::int)::bigint exact_duplicate from n group by all")
def scan_summary(spark, sf):
    f = fx.table(spark, sf, "documents").select(F.col("source").alias("root"), F.sha2("text", 256).alias("sha256_hash"), F.col("doc_id").alias("mtime"), F.col("doc_id").cast("string").alias("path"))
    judged = ledger.ingest_decisions(f, f.limit(0)).withColumnRenamed("decision", "status")
    return ledger.scan_summary(judged, ["new", "exact_duplicate"])


@query("select l_orderkey path, l_linenumber::bigint mtime, l_quantity size from lineitem where not (l_linenumber % 2 = 0)")
def changed_files(spark, sf):
    f = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("long").alias("mtime"), F.col("l_quantity").alias("size"))
    return ledger.changes(f, f.where("mtime % 2 = 0"))


@query("select event_id, ts, event_type from events order by ts desc, event_id desc limit 100")
def audit_trail(spark, sf):
    return ledger.audit_trail(fx.table(spark, sf, "events").select("event_id", "ts", "event_type"), [F.desc("ts"), F.desc("event_id")])


@query(f"with {fx.EDGES_SQL}, ids as (select 'p' || p_partkey id from part where p_size > 45 union select 's' || s_suppkey from supplier where s_acctbal > 0) select src, dst, weight from edges where src in (from ids) and dst in (from ids) order by weight desc, src, dst limit 35000")
def subset_export(spark, sf):
    p = fx.table(spark, sf, "part").where("p_size > 45").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    s = fx.table(spark, sf, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    return ledger.subset_export([p, s], {}, fx.edges(spark, sf), 35_000)["edges"].select("src", "dst", "weight")


# Streams, on tables -------------------------------------------------------------------------------------------------


@query("select time_bucket(interval 60 second, ts) window_start, event_type, count(*) events, round(sum(value), 4) value from events group by all")
def throughput_60s(spark, sf):
    out = jobs.throughput(fx.table(spark, sf, "events"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "events", F.round("value", 4).alias("value"))


@query("select distinct user_id from events")
def enqueue_dedup(spark, sf):
    return jobs.enqueue_once(fx.table(spark, sf, "events"), "user_id").select("user_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
