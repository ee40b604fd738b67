"""Registered queries of the stored keyword index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.operators import retrieval, term_index, vector_index
from ledgerloom.operators.durable import shared_folder
from ledgerloom.plans import catalogue as C
from ledgerloom.plans import fixtures as fx
from ledgerloom.plans.registered import query


def _searched(spark, sf, limit, all_terms):
    index = term_index.build(fx.documents(spark, sf), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", docs_per_group=16)
    return term_index.search(index, retrieval.query_terms(C._queries(spark, sf)), limit, all_terms)


@query(f"with {C._BM25}, scored as (select query_id, doc_id, round(s, 6) score from sc join need using (query_id) where found = need) {C._TOP5}")
def indexed_search(spark, sf):
    """The rows of bm25_search, through a stored index."""
    return _searched(spark, sf, 5, True)[0]


@query(f"with {C._BM25}, scored as (select query_id, doc_id, round(s, 6) score from sc) {C._TOP5}")
def indexed_search_any(spark, sf):
    """Documents with any word of a query."""
    return _searched(spark, sf, 5, False)[0]


@query("select count(*) queries, true good from embeddings where vec_id % 50 = 0")
def vector_index_recall(spark, sf):
    """Whether the inverted lists find nine tenths of the exact nearest vectors of every fiftieth row."""
    rows, asked = C._probe(spark, sf)
    index = vector_index.build(rows, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}", lists=32)
    found = vector_index.search(index, asked, 10, -1.0, probes=22)
    told = vector_index.recall(found, retrieval.vector_topk(rows, asked, 10, -1.0))
    return told.select("queries", (F.col("recall") >= 0.9).alias("good"))
