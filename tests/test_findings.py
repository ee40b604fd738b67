"""What a review found: small inputs on which an operator failed or left its SQL."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import features
from ledgerloom.operators import actions as A
from ledgerloom.operators import automaton, dedup, durable, extraction, graph, ledger, refresh, retrieval, review, term_index
from ledgerloom.plans import catalogue
from ledgerloom.plans import fixtures as fx


def test_a_subset_without_classes_has_its_heaviest_edges(spark):
    edges = spark.createDataFrame([("a", "b", "r", 1), ("a", "c", "r", 5), ("b", "c", "r", 5), ("a", "x", "r", 9)], "src string, dst string, relation string, weight long")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    got = ledger.subset_export([ids], {}, edges, 2)["edges"].collect()
    assert [(r["src"], r["dst"], r["weight"]) for r in got] == [("a", "c", 5), ("b", "c", 5)]


def test_evidence_keeps_digits_at_the_ends_of_sentences(spark):
    got = spark.createDataFrame([("Reouti anatha. 19.37.233.111\n  2 anatha 2 ", "Anatha")], "t string, n string").select(review.evidence(F.col("t"), F.col("n"))).first()[0]
    assert got == "Reouti anatha.\n19.37.233.111\n2 anatha 2"


def test_long_passages_keep_digits_at_the_ends_of_lines(spark):
    docs = spark.createDataFrame([(1, "passage: a b\n1 x 1\n 2 y 2")], "doc_id long, text string")
    assert [(r["chunk_index"], r["chunk_text"]) for r in extraction.legal_chunks(docs, size=2).orderBy("chunk_index").collect()] == [(0, "passage: a b"), (1, "1 x 1"), (2, "2 y 2")]


def test_a_citation_ends_before_an_accent(spark):
    docs = spark.createDataFrame([(1, "555-8658 coñ ó"), (2, "8658 con"), (3, "OR 12é")], "doc_id long, text string")
    assert {(r["doc_id"], r["article"]) for r in extraction.citations(docs).collect()} == {(1, "8658"), (3, "12")}


def test_pairs_of_a_common_amount_are_made_once_and_never_shuffled(spark):
    asked = [(1, 1, 5.0), (1, 1, 7.0), (1, 1, 5.0), (2, 3, 7.0), (2, 4, 7.0), (3, 5, 5.0), (3, 6, 7.0), (4, None, 5.0), (5, 1, None), *[(100 + i, 2, float(i)) for i in range(90)]]
    texts = [(1, "5 and 7.00"), (2, "7 5.00 5"), (3, "7"), (4, None), (5, "7, 5"), (6, "7"), (7, " ".join(str(i) for i in range(90)))]
    actions, docs = spark.createDataFrame(asked, "action_id long, source_doc long, amount double"), spark.createDataFrame(texts, "doc_id long, text string")
    held = {d: {f"{float(x):.2f}" for x in re.findall(r"[0-9]+(?:\.[0-9]{2})?", t or "")} for d, t in texts}
    want = {(a, d) for a, s, x in asked for d, h in held.items() if s is not None and x is not None and s != d and f"{x:.2f}" in h}
    found = A.amount_matches(actions, docs)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString().lstrip()
    assert plan.startswith("Union")


def test_fingerprints_meet_in_tiles(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in base for _ in range(5)] + [0]
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in prints]
    rows = spark.createDataFrame([(v,) for v in signed], "simhash long")
    bits = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    got = [tuple(r) for r in dedup.near_matches(rows.limit(30), rows, 4, tile_rows=16).collect()]
    want = {(a, b, bits(a, b)) for a in signed[:30] for b in signed if a and b and bits(a, b) <= 4}
    assert len(got) == len(want) and set(got) == want
    groups = dedup.fingerprint_groups(rows.withColumn("doc_id", F.monotonically_increasing_id()))
    by_blocks, by_tiles = ({tuple(r) for r in dedup.near_links(groups, 4, blocks).select("docs", "links", "nearest").collect()} for blocks in (3, None))
    assert by_blocks == by_tiles
    parts = dedup._linked(groups, 3, 4)
    assert parts.rdd.getNumPartitions() == 6  # a task per pair of tiles


def test_an_action_of_one_key_meets_a_document_once_without_a_shuffle_of_pairs(spark):
    asked = [(1, 1, "payment", None, 5.0), (2, 9, "reply", "ann", None), (2, 9, "reply", "bob", None), (3, 3, "signature", "ann", None), (4, 2, "payment", None, 5.0), (4, 2, "payment", None, 5.0)]
    actions = spark.createDataFrame(asked, "action_id long, source_doc long, action_type string, party string, amount double")
    docs = spark.createDataFrame([(1, "paid 5"), (2, "paid 5.00, re: Ann and Bob"), (3, "signed for ann"), (4, "signed for ann, reply"), (2, "paid 5")], "doc_id long, text string")
    found = A.fulfilment_candidates(actions, docs)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2, "payment"), (2, 2, "reply"), (2, 4, "reply"), (3, 4, "signature"), (4, 1, "payment")]
    assert found._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith("Union")


def test_workers_take_few_texts_at_once(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.range(1).write.parquet(f"{tmp_path}/documents.parquet")
    for setting, want in (("10000", "1024"), ("100", "100")):
        spark.conf.set(name, setting)
        fx.table(spark, str(tmp_path), "documents")
        assert spark.conf.get(name) == want
    spark.conf.unset(name)


def _lines(spark, folder, orders=300):
    """Lines of orders, of which some repeat, as the fixtures read them."""
    rng = random.Random(7)
    rows = [(o, rng.randrange(40), rng.randrange(9)) for o in range(orders) for _ in range(4)]
    spark.createDataFrame(rows + rows[:50], "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{folder}/lineitem.parquet")
    return rows


def test_many_pairs_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(durable, "TASK_ROWS", 100)
    rows = _lines(spark, tmp_path)
    lines = fx.table(spark, str(tmp_path), "lineitem")
    found = graph.cooccurrence(lines.select("l_orderkey", F.col("l_partkey").alias("src")), lines.select("l_orderkey", F.col("l_suppkey").alias("dst")), "l_orderkey", "with")
    want = Counter((a, b) for o in {r[0] for r in rows} for a in {r[1] for r in rows if r[0] == o} for b in {r[2] for r in rows if r[0] == o})
    assert {(r["src"], r["dst"]): r["weight"] for r in found.collect()} == want
    assert found.rdd.getNumPartitions() > 40  # not the session's 4: some 4,800 pairs


def test_links_and_edges_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    rows = _lines(spark, tmp_path)
    links, edges = ({tuple(r) for r in t.collect()} for t in (fx.links(spark, str(tmp_path)), fx.edges(spark, str(tmp_path))))
    assert links == {(o, n) for o, p, s in rows for n in (f"p{p}", f"s{s}")}
    monkeypatch.setattr(durable, "TASK_ROWS", 100)
    for read, want, least in ((fx.links, links, 20), (fx.edges, edges, 10)):
        dealt = read(spark, str(tmp_path))
        assert dealt.rdd.getNumPartitions() >= least and {tuple(r) for r in dealt.collect()} == want


def test_few_results_and_seeds_leave_the_edges_where_they_lie(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "d"), ("e", "a"), (None, "a")], "src string, dst string")
    links = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "d")], "doc long, node_id string")
    asked = spark.createDataFrame([("q", 1), ("q", 1), ("r", 2), ("s", 9)], "query_id string, doc long")
    got = [tuple(r) for r in review.expand_results(asked, links, edges).collect()]
    assert sorted(got, key=str) == sorted([("q", "a", 0), ("q", "b", 0), ("q", "c", 1), ("q", "e", 1), ("q", None, 1), ("r", "d", 0), ("r", "c", 1)], key=str)
    seeds = spark.createDataFrame([("a",), ("z",)], "node_id string")
    near = graph.neighbourhood(edges, seeds)
    assert sorted(tuple(r) for r in near.collect() if r["node_id"]) == [("a", "b", 1), ("a", "c", 2), ("a", "e", 1)]
    for found in (near, review.expand_results(asked, links, edges)):
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # written, not planned with its lineage


def test_links_of_documents_stay_in_the_partitions_they_are_dealt_into(spark):
    links = spark.createDataFrame([("1", "a", "r", 1.0)], "doc_id string, node_id string, role string, confidence double")
    edges = spark.createDataFrame([("doc_1", "a", "r", 2.0), ("doc_1", "b", "r", 2.0), ("doc_1", "b", "r", 3.0), ("doc_2", "b", "r", None), ("doc_3", "b", "r", 1.0), ("doc_2", "x", "r", 1.0)], "src string, dst string, relation string, weight double")
    placed = spark.createDataFrame([("2", "R 1", 0.5), ("2", "g", 0.5)], "doc_id string, geo_id string, confidence double")
    nodes = spark.createDataFrame([("a", "{}"), ("b", '{"geo_id": "g"}'), ("location_r_1", "{}")], "node_id string, properties string")
    docs = spark.createDataFrame([("1",), ("2",)], "doc_id string")
    want = {("1", "a", "r", 1.0), ("1", "b", "r", 3.0), ("2", "b", "r", 1.0), ("2", "location_r_1", "LOCATED_IN", 0.5), ("2", "b", "LOCATED_IN", 0.5)}
    mapping = spark.createDataFrame([("a", "b")], "alias string, canonical string")
    for parts in (None, 13):
        assert sorted(map(tuple, refresh.mirror_links(links, edges, placed, nodes, docs, parts).collect())) == sorted(want)
        moved = graph.consolidate_links(links.withColumnRenamed("doc_id", "doc").unionByName(links.select(F.col("doc_id").alias("doc"), F.lit("b").alias("node_id"), "role", "confidence")), mapping, parts)
        assert [tuple(r) for r in moved.collect()] == [("1", "b")]
        own = ledger.entities_of(links.select(F.col("doc_id").alias("doc"), "node_id"), nodes.select("node_id", F.lit("t").alias("node_type"), F.col("node_id").alias("name")), docs.withColumnRenamed("doc_id", "doc"), parts)
        assert [tuple(r) for r in own.collect()] == [("1", "a", "t", "a", None, 1)]
    assert moved.rdd.getNumPartitions() == own.rdd.getNumPartitions() == 13


def test_a_search_tells_how_many_of_its_terms_it_found(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "d")], "doc_id long, text string")
    terms = spark.createDataFrame([(1, "a"), (1, "b"), (1, "z"), (2, "c")], "query_id long, term string")
    got = {(r["query_id"], r["doc_id"]): r["found"] for r in retrieval.bm25_terms(docs, terms, 5, all_terms=False, counted=True).collect()}
    assert got == {(1, 1): 2, (1, 2): 1, (2, 2): 1}


@pytest.mark.parametrize(("asked_rows", "sums"), [(200_000, 1 << 19), (3, 20)])
def test_any_word_searches_sum_scores_where_documents_lie(spark, monkeypatch, asked_rows, sums):
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(9))) for i in range(60)}
    texts |= {100 + i: texts[7] for i in range(20)} | {900: "", 901: None}
    terms = [(q, t) for q in ("p", "q", "r", "s") for t in rng.sample("abcdefgh", 4)] + [("q", "nowhere"), ("none", "nowhere"), (None, "a")]
    held = {i: (t or "").split() for i, t in texts.items()}
    df, mean = Counter(w for own in held.values() for w in set(own)), sum(map(len, held.values())) / len(held)
    part = lambda tf, n, w: math.log(1 + (len(held) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))
    want = set()
    for q in {q for q, _ in terms if q}:
        own = [w for p, w in terms if p == q]
        rows = [(-round(sum(part(words.count(w), len(words), w) for w in own if w in words), 6), i, sum(w in words for w in own)) for i, words in held.items() if set(own) & set(words)]
        want |= {(q, i, -s, n, r) for r, (s, i, n) in enumerate(sorted(rows)[:5], 1)}
    plans, ranked = [], retrieval.ranked
    monkeypatch.setattr(retrieval, "ranked", lambda df, limit: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or ranked(df, limit))
    monkeypatch.setattr(retrieval, "ASKED_ROWS", asked_rows)
    monkeypatch.setattr(retrieval, "SUMS_AT_ONCE", sums)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = retrieval.bm25_terms(docs, spark.createDataFrame(terms, "query_id string, term string"), 5, all_terms=False, counted=True)
    assert {tuple(r[c] for c in ("query_id", "doc_id", "score", "found", "rank")) for r in got.collect()} == want
    assert not any(word in plans[0] for word in ("Join", "Aggregate"))  # pairs of query and document are not shuffled


def test_the_best_of_a_query_with_ids_of_any_kind():
    best = retrieval._Best(1, 3)
    for ids, scores in (([7, 2**60 + 1], [1.0, 2.0]), ([2**60, None, 5], [2.0, 1.0, 0.5]), ([3], [2.0])):
        best.add(np.zeros(len(ids), int), np.array(ids, object), np.array(scores), np.ones(len(ids), int))
    assert list(best.doc) == [3, 2**60, 2**60 + 1]


def test_a_passage_is_found_without_a_second_look_at_the_texts(spark, tmp_path):
    passages = [(1, "One Two"), (2, "two"), (3, "not there"), (4, "Two")]
    spark.createDataFrame([(5, "so One Two it is"), (4, "one two"), (9, "One Two"), (8, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = catalogue._exact_passage(spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {(1, 5), (2, 4), (4, 5)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # with the items only


def test_a_token_of_few_letters_stands_for_itself(spark):
    docs = spark.createDataFrame([(1, "ab abc abcd xab"), (2, "")], "doc_id long, text string")
    tokens = spark.createDataFrame([("ab",), ("abc",)], "token string")
    for how, shard_chars in (("begins", 100), ("in", 100), ("in", 2)):
        rows = automaton.word_lists(docs, F.col("text"), tokens, how, shard_chars=shard_chars, least=3).collect()
        assert {(r["doc_id"], r["len"], *sorted(zip(r["terms"], r["tfs"], strict=True))) for r in rows} == {(1, 4, ("ab", 1), ("abc", 1), ("abcd", 1)), (2, 0)}


def test_a_hashed_vector_is_worked_out_once(spark, tmp_path):
    texts = [(1, "Ab ab, c_1 É"), (2, ""), (3, "?!"), (4, None), (5, " ".join(f"w{i % 90}" for i in range(500)))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for dim in (64, 5):
        got = {r["doc_id"]: r["v"] for r in docs.select("doc_id", features.hashed_embedding(F.col("text"), dim).alias("v")).collect()}
        for i, text in texts[:3] + texts[4:]:
            raw = [0.0] * dim
            for at, word in enumerate(re.findall(r"\w+", text.lower())):
                raw[int(hashlib.sha256(word.encode()).hexdigest()[:8], 16) % dim] += 1 / (1 + 0.05 * at)
            norm = math.sqrt(sum(v * v for v in raw))
            assert got[i] == pytest.approx([v / norm if norm else 0.0 for v in raw], abs=1e-12)
        assert got[4] is None
    found = catalogue.hashed_embeddings(spark, str(tmp_path))
    assert {r["doc_id"] for r in found.collect()} == {1, 5}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1  # not again for the filter


def test_near_pairs_meet_in_runs_of_a_key_not_by_a_join(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(6)]
    values = list(dict.fromkeys(b ^ sum(1 << i for i in rng.sample(range(10), rng.randint(0, 3))) for b in base for _ in range(30)))
    rows = [(v, 1000 - i, 1 + i % 3, i / 10) for i, v in enumerate(values)]
    want = {(*sorted((x[1], y[1])), (x[0] ^ y[0]).bit_count()) for x, y in itertools.combinations(rows, 2) if (x[0] ^ y[0]).bit_count() <= 3}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # keys span batches
    monkeypatch.setattr(dedup, "PAIRS_AT_ONCE", 20)
    found = dedup.near_pairs(spark.createDataFrame(rows, "simhash long, first_doc long, docs long, maturity double"), carried=("maturity",))
    got = found.collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    known = {r[1]: r for r in rows}
    assert {(r["a"], r["b"], r["distance"]) for r in got} == want and len(got) == len(want) > 100
    assert all((r["docs_a"], r["docs_b"], r["maturity_a"], r["maturity_b"]) == (*(known[r[c]][2] for c in "ab"), *(known[r[c]][3] for c in "ab")) for r in got)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    links = {(r["parent_doc"], r["child_doc"]): r["relationship"] for r in dedup.version_links(found).collect()}
    assert links == {(a, b): "supersedes" if known[b][3] > known[a][3] else "derived_from" for a, b, _ in want}


def test_a_fingerprint_counts_words_and_three_letters():
    def plain(text):
        compact, votes = re.sub(r"\W", "", text.lower()), [0] * 64
        for token in re.findall(r"\w+", text.lower()) + [compact[i : i + 3] for i in range(len(compact) - 2)]:
            got = int.from_bytes(hashlib.md5(token.encode()).digest()[:8], "big")
            votes = [v + (1 if got >> (63 - i) & 1 else -1) for i, v in enumerate(votes)]
        value = sum(1 << (63 - i) for i, v in enumerate(votes) if v > 0)
        return value - (1 << 64) if value >> 63 else value

    for text in ("", "?!", "a", "ab ab abc", "É é ΣΑΣ ß İx", "\U0001f600 x\U00010400yz \n q", "_ __ x" * 9, "the cat sat on the mat 12 34"):
        assert features.simhash_of(text) == plain(text)


def test_marks_without_patterns_are_looked_for_as_texts(spark):
    texts = ["x" * 60 + end for end in (" ....", " ...", " [cut]", " cut", " gez. A", " geza", " Page 2 of 3", " Notar, SIGNATURE", "")] + ["short", None]
    docs = spark.createDataFrame([(i, "a.txt", t) for i, t in enumerate(texts)], "doc_id long, filename string, text string")
    found = features.with_maturity(docs)
    assert found.columns[:3] == docs.columns and not [c for c in found.columns if c.startswith("_")]
    got = [(r["truncated"], r["completeness"], r["signature"]) for r in found.orderBy("doc_id").collect()]
    want = [(True, 0.1, 0.0), (False, 0.5, 0.0), (True, 0.1, 0.0), (False, 0.5, 0.0), (False, 0.65, 0.4), (False, 0.5, 0.0), (False, 0.65, 0.0), (False, 0.65, 0.45), (False, 0.5, 0.0), (True, 0.1, 0.0), (True, 0.1, 0.0)]
    assert got == want
    assert found.select("completeness")._jdf.queryExecution().optimizedPlan().toString().count("lower(text") == 1  # once, not for each mark


def test_all_projects_and_milestones_of_a_text_are_links(spark):
    codes, days = [f"ab-{i}" for i in range(7)], [f"2024-01-{i:02d}" for i in range(1, 8)]
    text = " ".join([*(f"Project {c}, projekt {c.upper()}" for c in codes), *(f"deadline: {d}" for d in days)])
    got = extraction.extract_links(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).where("node_type in ('project_code', 'milestone_date')").select("doc_id", "node_id").collect()
    assert sorted(tuple(r) for r in got) == sorted((1, n) for n in [f"project_code_{c}" for c in (x.replace("-", "_") for x in codes)] + [f"milestone_date_{d.replace('-', '_')}" for d in days])


@pytest.mark.parametrize("sent_rows", [1_000_000, 0])
def test_actions_are_dealt_once_and_what_texts_name_is_sent(spark, monkeypatch, sent_rows):
    monkeypatch.setattr(A, "SENT_ROWS", sent_rows, raising=False)
    rng = random.Random(4)
    asked = [(rng.randrange(60), rng.randrange(5) or None, float(rng.randrange(80))) for _ in range(300)] + [(7, None, None), (None, 3, 5.0)]
    texts = [(i % 35, " ".join(f"{rng.randrange(90)}{rng.choice(['', '.00', '.50'])}" for _ in range(rng.randrange(7)))) for i in range(50)]
    actions, docs = spark.createDataFrame(asked, "action_id long, source_doc long, amount double"), spark.createDataFrame(texts, "doc_id long, text string")
    held = [(d, {f"{float(x):.2f}" for x in re.findall(r"[0-9]+(?:\.[0-9]{2})?", t)}) for d, t in texts]
    want = {(a, d) for a, s, x in asked for d, h in held if s is not None and x is not None and s != d and f"{x:.2f}" in h}
    found = A.amount_matches(actions, docs)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert ("_salt" in plan) == (not sent_rows) and "RepartitionByExpression [action_id" in plan


@pytest.mark.parametrize("carried", [16, 2, 1])
def test_pairs_of_repeated_actions_and_documents_are_not_made_distinct(spark, monkeypatch, carried):
    monkeypatch.setattr(A, "CARRIED", carried, raising=False)
    rng, kinds = random.Random(6), {"payment": ("paid", A.PAID_WORDS), "signature": ("signed", A.SIGNED_WORDS), "reply": ("re:", A.REPLY_WORDS)}
    asked = [(rng.randrange(40), rng.choice([1, 1, 2, None]), rng.choice(["payment", "signature", "reply", "filing"]), rng.choice(["ann", "Bob", "cy", None]), rng.choice([5.0, 7.0, None])) for _ in range(200)]
    texts = [(rng.randrange(25), " ".join(rng.choices(["paid", "signed", "re:", "ann", "bob", "cy", "5", "7.00", "the"], k=rng.randrange(6)))) for _ in range(60)] + [(3, None), (99, "the the signed ann, re: bob, paid 5 7")]
    marks = lambda t: {k for k, (_, p) in kinds.items() if re.search(p, t)}
    held = {(d, "payment", f"{float(n):.2f}") for d, t in texts if t and "payment" in marks(t) for n in re.findall(r"[0-9]+(?:\.[0-9]{2})?", t)} | {(d, k, w) for d, t in texts if t for k in marks(t) - {"payment"} for w in re.findall(r"\w+", t)}
    key = lambda kind, party, amount: ("payment", amount and f"{amount:.2f}") if kind == "payment" else ("signature" if kind == "signature" else "reply", party and party.lower())
    want = {(a, d, kind) for a, s, kind, party, amount in asked for d, k, w in held if s is not None and s != d and (k, w) == key(kind, party, amount)}
    actions = spark.createDataFrame(asked, "action_id long, source_doc long, action_type string, party string, amount double")
    found = A.fulfilment_candidates(actions, spark.createDataFrame(texts, "doc_id long, text string"))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    distinct = [i for i, line in enumerate(plan) if "Aggregate [action_id" in line and "doc_id" in line]
    assert len(distinct) == 1 and re.search(rf"size\(_keys.*\) (<=|>) {carried}\b", "".join(plan[distinct[0] :]))  # only documents of more tokens than are carried


@pytest.mark.parametrize("asked_prints", [100_000, 7])
def test_pairs_of_signals_are_neither_written_nor_shuffled(spark, tmp_path, monkeypatch, asked_prints):
    monkeypatch.setattr(retrieval, "ASKED_PRINTS", asked_prints, raising=False)
    rng = random.Random(8)
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    base = [rng.getrandbits(64) for _ in range(6)]
    rows = [(None if i == 9 else i % 50, f"h{i}".encode().hex() * 16, rng.choice(["a.txt", "A.txt", "a", "b.pdf", None]), signed(rng.choice(base) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))) if i % 9 else rng.choice([0, None])) for i in range(70)]
    asks = [(q % 25, rng.choice(["one two three", "a.txt", 'find "a.txt" or "a" now', "b"]), signed(base[q % 6])) for q in range(35)] + [(3, f"is {rows[4][1].upper()[:64]} here", 0), (77, None, 5)]
    docs = spark.createDataFrame([(d, h[:64].ljust(64, "0"), n, s) for d, h, n, s in rows], "doc_id long, sha256_hash string, filename string, simhash long")
    queries = spark.createDataFrame(asks, "query_id long, text string, simhash long")
    bits = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    near = {(q, d, "near") for q, t, a in asks for d, _, _, b in rows if t and a and b and len(re.findall(r"\w+", t)) >= 3 and bits(a, b) <= 4}
    names = lambda n: {n.lower(), re.sub(r"\.[a-z0-9]+$", "", n.lower())} if n else set()
    name = {(q, d, "name") for q, t, _ in asks for d, _, n, _ in rows if t and names(n) & {t.lower(), *re.findall('"([^"]+)"', t.lower())}}
    found = retrieval.exact_signals(docs, queries, 4, 3)
    got = [tuple(r) for r in found.where("signal <> 'hash'").collect()]
    assert len(got) == len(set(got)) and set(got) == near | name and near and name
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union") and "Aggregate [query_id, doc_id" not in re.sub(r"#\d+L?", "", plan)


def test_neither_blocks_nor_their_queries_are_shuffled(spark, tmp_path, monkeypatch):
    plans = []
    told = lambda df: plans.append(re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString()))
    frame, keep = type(spark.range(0)), durable.Workspace.keep
    monkeypatch.setattr(frame, "sortWithinPartitions", lambda self, *c, f=frame.sortWithinPartitions: told(self) or f(self, *c))
    monkeypatch.setattr(durable.Workspace, "keep", lambda self, df: told(df) or keep(self, df))
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 11} common") for i in range(200)] + [(3, "w5"), (None, "w1")], "doc_id long, text string")
    index = term_index.build(docs, str(tmp_path / "i"), docs_per_group=16)
    terms = retrieval.query_terms(spark.createDataFrame([(1, "w1 common"), (2, "w5"), (2, "w5"), (None, "w1")], "query_id long, text string"))
    top, _ = term_index.search(index, terms, 3, all_terms=False)
    assert top.where("query_id = 1").count() == 3
    assert any("MapInArrow" in p for p in plans) and not any("hashpartitioning(bucket" in p or "hashpartitioning(query_id, grp" in p for p in plans if "held" in p)


def test_a_long_list_of_phrases_takes_one_pass_over_the_texts(spark, monkeypatch):
    monkeypatch.setattr(automaton, "CHARS_AT_ONCE", 50, raising=False)
    rng = random.Random(2)
    phrases = sorted({"".join(rng.choices("abé_ ", k=rng.randrange(1, 20))) for _ in range(300)} | {"a" * 40})
    texts = ["".join(rng.choices("abé_ ", k=rng.randrange(80))) for _ in range(60)] + ["a" * 99, "", "x" + phrases[-1] + "\U0001f600" + phrases[3], None]
    docs, asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string")
    found = automaton.phrase_hits(docs, F.col("text"), asked, shard_chars=100)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    machine = automaton.automaton(phrases)
    want = [(i, p, *c) for i, t in enumerate(texts) if t for p, c in automaton.count_hits(machine, t).items()]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
