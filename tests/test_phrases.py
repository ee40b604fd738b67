"""Phrases in texts, classes by stems, fulfilment by parties, statutes and climbs, against brute force."""

import re

import numpy as np
import pytest

from ledgerloom.operators import actions, automaton, durable, extraction, retrieval, taxonomy
from pyspark.sql import functions as F

WORDS = ["a", "ab", "abc", "bc", "rent", "parent", "rental", "äb", "x_y", "x", "y"]


def brute(text, phrase):
    at = [m.start() for m in re.finditer(f"(?={re.escape(phrase)})", text)]
    joined = lambda i: 0 < i < len(text) and (text[i - 1].isalnum() or text[i - 1] == "_") and (text[i].isalnum() or text[i] == "_")
    whole = [i for i in at if not joined(i) and not joined(i + len(phrase))]
    return (len(whole), len(at) - len(whole), at[0]) if at else None


@pytest.mark.parametrize("shard_chars", [1 << 20, 12])
def test_phrase_hits_equal_brute_force(spark, shard_chars):
    rng = np.random.default_rng(1)
    texts = [rng.choice(["", " ", "\n", ", "]).join(rng.choice(WORDS, rng.integers(0, 12))) for _ in range(150)] + [None, "", "ABC Rent", "a" * 50, "\0a\0"]
    phrases = [*WORDS, "a ab", "rent, x", "\0a", "", None, "AB"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, "rent")], "doc_id long, text string")
    got = automaton.phrase_hits(docs, F.col("text"), spark.createDataFrame([(p,) for p in phrases], "phrase string"), shard_chars=shard_chars)
    asked = {p.lower() for p in phrases if p}
    want = [(i, p, *found) for i, t in [*enumerate(texts), (0, texts[0]), (None, "rent")] if t for p in asked if (found := brute(t.lower(), p))]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_phrase_hits_of_nothing(spark):
    docs = spark.createDataFrame([("k", "text")], "key string, text string")
    none = spark.createDataFrame([], "phrase string")
    assert automaton.phrase_hits(docs, F.col("text"), none, key="key").collect() == []
    assert automaton.phrase_hits(docs.limit(0), F.col("text"), spark.createDataFrame([("text",)], "phrase string"), key="key").collect() == []
    assert [tuple(r) for r in automaton.word_matches(docs, F.col("text"), none.withColumnRenamed("phrase", "token"), key="key").collect()] == [("k", None, 0, 1)]


@pytest.mark.parametrize("shard_chars", [1 << 20, 4])
def test_word_matches(spark, shard_chars):
    docs = spark.createDataFrame([(1, "rent rental parent rent"), (2, ""), (3, None), (4, "other")], "doc_id long, text string")
    tokens = spark.createDataFrame([("rent",), ("par",)], "token string")
    run = lambda how: {(r["doc_id"], r["term"]): (r["tf"], r["len"]) for r in automaton.word_matches(docs, F.col("text"), tokens, how, shard_chars=shard_chars).collect()}
    lengths = {(1, None): (0, 4), (2, None): (0, 0), (3, None): (0, 0), (4, None): (0, 1)}
    assert run("is") == lengths | {(1, "rent"): (2, 4)}
    assert run("begins") == lengths | {(1, "rent"): (2, 4), (1, "rental"): (1, 4), (1, "parent"): (1, 4)}
    assert run("in") == run("begins")


def test_cost_does_not_depend_on_the_number_of_phrases():
    machine = automaton.automaton([f"word{i} word{i + 1}" for i in range(200_000)])
    text = "word5 word6 " + "nothing here " * 200_000
    assert automaton.count_hits(machine, text) == {"word5 word6": [1, 0, 0]}


def test_stems_names_and_paths(spark):
    rows = [(1, "Mietvertrag_neu.pdf", None, None), (2, "x.pdf", "/home/lease/", "please"), (3, "a.txt", "", "the tenants"), (4, None, None, "Lebenslauf: curriculum vitae"), (5, "b", "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, filename string, path string, text string")
    kw = spark.createDataFrame([("lease", "mietvertrag", False), ("lease", "lease", False), ("lease", "tenant", False), ("career", "curriculum vitae", True), ("career", "lebenslauf", True), ("career", " CV ", True)], "category string, keyword string, is_child boolean")
    got = taxonomy.classify(docs, kw, stem=6, whole_only=("tenant",))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "lease", 1, 0.8), (2, "lease", 1, 0.8), (4, "career", 2, 0.93)]
    assert {r["doc_id"] for r in taxonomy.classify(docs, kw, stem=6).collect()} == {1, 2, 3, 4}


def test_mentions_of_many_words(spark):
    docs = spark.createDataFrame([(1, "the Alder-Birch  Works, Ltd"), (2, "alder birch"), (3, None)], "doc_id long, text string")
    rules = spark.createDataFrame([("alder birch works", "o1", 0.9), ("Alder Birch", "o1", 0.5), ("birch", "o2", 0.7), ("--", "o3", 1.0)], "term string, node_id string, confidence double")
    assert {tuple(r) for r in taxonomy.mentions(docs, rules).collect()} == {(1, "o1", 0.9), (1, "o2", 0.7), (2, "o1", 0.5), (2, "o2", 0.7)}


def test_first_matches(spark):
    texts = [
        "receipt for 250.00", "250 from Alder & Birch Ltd", "250.00 from others", "signed, Alder & Birch Ltd", "unterzeichnet zu AB12CD34", "signed by others",
        "Alder & Birch Ltd about ab12cd34", "Alder & Birch Ltd: please return the annexed forms by", "about ab12cd34 only", "2500.00 paid", None, "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told, party = "Please return the annexed forms by friday", "alder & birch ltd"
    rows = [
        (1, 90, "payment", None, 250.0, "ab12cd34", told, "pending"), (2, 0, "payment", party, 250.0, None, None, "pending"), (3, 90, "payment", "", 0.0, None, None, "pending"), (4, 90, "payment", party, None, None, None, "pending"),
        (5, 90, "signature", "Alder & Birch Ltd", None, None, None, "pending"), (6, 3, "signature", party, None, "AB12CD34", None, "pending"), (7, 90, "signature", None, None, None, None, "pending"),
        (8, 90, "reply", party, None, "ab12cd34", None, "pending"), (9, 6, "filing", party, None, "ab12cd34", told, "pending"), (10, 90, "reply", None, None, "ab12cd34", told, "pending"), (11, 90, "payment", None, 250.0, None, None, "completed"),
        (12, 90, "payment", None, 2500.0, None, None, "pending"),
    ]
    asked = spark.createDataFrame(rows, "action_id long, source_doc long, action_type string, party string, amount double, source_key string, description string, status string")
    got = {tuple(r) for r in actions.first_matches(asked, docs).collect()}
    assert got == {
        (1, 0, "payment", "amount and a word of payment"), (2, 1, "payment", "amount and party"), (5, 3, "signature", "signed by the party"), (6, 4, "signature", "signed for the source"),
        (8, 6, "reply", "party and source"), (9, 7, "reply", "party and description"), (12, 9, "payment", "amount and a word of payment"),
    }
    assert actions.first_matches(asked.limit(0), docs).collect() == [] == actions.first_matches(asked, docs.limit(0)).collect()


def test_statute_mentions(spark):
    rows = [
        (1, "law_220_art_12-DE.xml", "x"), (2, "law_220_12_b", "y"), (3, "n", "see Art. 12 of SR 220 and SR 2201, Art. 121"), (4, "n/en/x", "Art. 12 SR 220"), (5, None, "SR 220 Art. 12 (OR here"), (6, "n", "SR 220"),
        (7, "n", None), (8, "law_220_121.xml", ""), (9, "law_220_art_12-de.xml", "Art. 12 SR 220"),
    ]
    chunks = spark.createDataFrame(rows, "chunk_id long, name string, text string")
    asked = spark.createDataFrame([("220", "12"), ("2201", "12"), ("220", "121"), ("220", "12")], "code string, article string")
    got = sorted(tuple(r) for r in extraction.statute_mentions(chunks, asked, per_language=2).collect())
    assert got == [
        ("220", "12", "de", 1, "key"), ("220", "12", "de", 9, "key"), ("220", "12", "en", 4, "text"), ("220", "12", "fr", 2, "key"), ("220", "12", "fr", 3, "text"),
        ("220", "121", "fr", 3, "text"), ("220", "121", "fr", 8, "key"), ("2201", "12", "fr", 3, "text"),
    ]


def test_long_chains_and_cycles_take_few_rounds(spark, monkeypatch):
    rows = [(f"c{i}", f"c{i + 1}") for i in range(1000)] + [(f"r{i}", f"r{(i + 1) % 1000}") for i in range(1000)] + [("two", "x1"), ("two", "a1"), ("a1", "c990"), ("tail", "r5"), ("top", None), (None, "c1")]
    rounds = []
    keep = durable.Workspace.keep
    monkeypatch.setattr(durable.Workspace, "keep", lambda self, df: rounds.append(1) or keep(self, df))
    got = {r["category"]: r["top"] for r in taxonomy.ancestors(spark.createDataFrame(rows, "category string, parent string"), ["c1000"]).collect()}
    assert len(rounds) <= 14
    assert all(got[f"c{i}"] == "c1000" for i in range(1001)) and all(got[f"r{i}"] is None for i in range(1000))
    assert got["two"] == "c1000" and got["tail"] is None and got["top"] == "top" and "x1" not in got
    themes = taxonomy.theme_of(spark.createDataFrame([("two",), ("Two",), (None,)], "doc_type string"), spark.createDataFrame(rows, "category string, parent string"), spark.createDataFrame([("Two", "r1"), ("two", "c5")], "alias string, category string"), ["c1000"])
    assert sorted(tuple(r) for r in themes.collect()) == [("Two", "c1000"), ("two", "c1000")]


def test_search_leaves_no_tables_but_its_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(durable, "shared_folder", lambda _: str(tmp_path))
    docs = spark.createDataFrame([(1, "a.txt", "red apple tree"), (2, "b.txt", "apples and pears"), (3, "c.txt", "pineapple")], "doc_id long, filename string, text string")
    asked = spark.createDataFrame([(1, "b.txt"), (2, "red tree"), (3, "appl"), (4, "eapp"), (5, "zzz")], "query_id long, text string")
    got = {(r["query_id"], r["doc_id"], r["tier"]) for r in retrieval.cascade(docs, asked).collect()}
    assert got == {(1, 2, 0), (2, 1, 1), (3, 1, 2), (3, 2, 2), (4, 3, 3)}
    assert len(list(tmp_path.iterdir())) == 1
