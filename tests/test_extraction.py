"""Extraction, evidence, review and portraits on small invented inputs."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import extraction as E
from ledgerloom.operators import review as R
from ledgerloom.sources import files


def docs(spark, *texts, names=None):
    rows = [(i, t, (names or ["a.txt"] * len(texts))[i]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, filename string")


def value(spark, column, **inputs):
    row = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} string" for k in inputs))
    return row.select(column.alias("v")).first()["v"]


def test_terms_need_whole_words_also_beside_accents(spark):
    got = E.financial_links(docs(spark, "Die GEBÜHR beträgt 5 Franken", "Gebühren, rentable", "une Pénalité.", "costs € 5", None, "")).collect()
    assert {(r["doc_id"], r["node_id"]) for r in got} == {(0, "financial_pillar_fee"), (0, "currency_chf"), (2, "financial_pillar_fine"), (3, "financial_pillar_cost"), (3, "currency_eur")}


def test_citations_in_both_orders(spark):
    got = E.citations(docs(spark, "see Art. 320 CO and OR 253a, art. 8 ZGB", "5 of them, 7 orange", "12 al. 3 let. b StGB", None))
    assert {(r["doc_id"], r["node_id"]) for r in got.collect()} == {(0, "statute_sr_220_art_320"), (0, "statute_sr_220_art_253a"), (0, "statute_sr_210_art_8"), (2, "statute_sr_311_0_art_12")}
    assert {(r["src"], r["dst"]) for r in E.citation_edges(got).collect()} >= {("statute_sr_220_art_320", "statute_sr_220")}


def test_parties_and_edges(spark):
    d = docs(spark, "Between Alder Works AG and others\nSigned by Ona Birch.\nRent in CHF, Art. 253 OR. Project: AB-12", "Employer: Page date\nTenant: Ab\n", None)
    links = E.extract_links(d)
    kinds = {(r["doc_id"], r["node_type"]) for r in links.collect()}
    assert {(0, "organization"), (0, "person"), (0, "statute"), (0, "currency"), (0, "project_code")} <= kinds and not any(i for i, _ in kinds)
    edges = {(r["src"], r["dst"], r["relation"]) for r in E.document_edges(links).collect()}
    assert ("organization_alder_works_ag", "person_ona_birch", "PARTY_TO") in edges and ("person_ona_birch", "organization_alder_works_ag", "PARTY_TO") not in edges
    assert ("financial_pillar_rent", "currency_chf", "DENOMINATED_IN") in edges and ("person_ona_birch", "statute_sr_220_art_253", "SUBJECT_TO") in edges
    assert ("person_ona_birch", "project_code_ab_12", "ASSIGNED_TO") in edges


def test_edges_equal_the_nested_loop(spark):
    rows = [(d, f"{t}{n}", t) for d in range(6) for t in ("person", "organization", "location", "currency", "financial_pillar", "other") for n in range((d + len(t)) % 3)]
    kinds = lambda t: {t, "party"} if t in ("person", "organization") else {t}
    want = {}
    for d, a, t in rows:
        for e, b, u in rows:
            for lk, rk, rel in E.EDGE_RULES:
                if d == e and lk in kinds(t) and rk in kinds(u) and (lk != rk or a < b):
                    want.setdefault((a, b, rel), set()).add(d)
    got = E.document_edges(spark.createDataFrame([*rows, *rows], "doc_id long, node_id string, node_type string"))
    assert {(r["src"], r["dst"], r["relation"]): r["weight"] for r in got.collect()} == {k: len(v) for k, v in want.items()}


def test_acronym_takes_the_sense_of_its_context(spark):
    got = E.disambiguate(docs(spark, "the ABK in Oldtown", "ABK of Newtown", "ABK", "ABKs in Newtown", None), "ABK", [("old", "Oldtown"), ("new", "Newtown")])
    assert {r["doc_id"]: r["node_id"] for r in got.collect()} == {0: "old", 1: "new", 2: "old"}


def test_profile_fields(spark):
    text = "[LEASE] The lease\nbetween Alder and Birch. issued: 03.02.2024, due date 2024/03/31"
    a, b = E.profile(docs(spark, text, None, names=["x.txt", "y_draft.txt"])).orderBy("doc_id").collect()
    assert (a["governing_date"], a["reception_date"], a["due_date"], a["party_a"], a["party_b"], a["status"], a["title"]) == ("2024-03-31", "2024-02-03", "2024-03-31", "Alder", "Birch", "final", "The lease")
    assert (b["governing_date"], b["due_date"], b["party_a"], b["status"], b["title"]) == (None, None, None, "draft", "y_draft.txt")


def test_obligations_once_and_resolved(spark):
    schema = "doc_id long, action_type string, due_date string, amount double"
    found = spark.createDataFrame([(1, "payment", None, 5.0), (1, "payment", None, 5.0), (2, "payment", "d", 1.0)], schema)
    assert [r["doc_id"] for r in E.new_obligations(found, found.where("doc_id = 2")).collect()] == [1]
    assert E.new_obligations(found, found).count() == 0
    actions = spark.createDataFrame([(1, "pending"), (2, "completed"), (3, "pending")], "action_id long, status string")
    now, audit = E.resolve_actions(actions, spark.createDataFrame([(1, "dismissed", 1), (1, "completed", 2), (2, "dismissed", 3)], "action_id long, status string, at long"))
    assert {r["action_id"]: r["status"] for r in now.collect()} == {1: "completed", 2: "completed", 3: "pending"} and audit.count() == 1


def test_legal_chunks_keep_short_passages_whole(spark):
    text = "passage: A (SR 220), Art. 1: one two\n\npassage: B (SR 5.1), Art. 2a:\n" + "word " * 9 + "\nend"
    got = E.legal_chunks(docs(spark, text, "no passage", None), size=8).collect()
    assert [(r["chunk_index"], r["sr_code"], r["article"], r["token_count"]) for r in got] == [(0, "220", "Art. 1", 8), (100, "5.1", "Art. 2a", 6), (101, "5.1", "Art. 2a", 9), (102, "5.1", "Art. 2a", 1)]


def test_evidence_equals_a_plain_loop(spark):
    import re

    text = "One here. Ona  Birch came! Two? Three.\nFour. ona birch again. " + "Ona Birch. x. y. " * 9
    parts = [p.strip() for p in re.split(r"(?<=[.!?])\s+|\n+", text) if p.strip()]
    hits = [i for i, p in enumerate(parts) if "ona birch" in " ".join(p.lower().split())][:8]
    want = "\n".join(parts[i] for i in sorted({j for i in hits for j in (i - 1, i, i + 1) if 0 <= j < len(parts)}))
    assert value(spark, R.evidence(F.col("t"), F.col("n")), t=text, n="Ona Birch") == want[:900]
    assert value(spark, R.evidence(F.col("t"), F.col("n")), t="none", n="Ona") == value(spark, R.evidence(F.col("t"), F.col("n")), t=None, n="Ona") == ""


def test_author_review(spark):
    c = spark.createDataFrame([(1, "a", "Ona Birch", "Written by Ona Birch. End."), (2, "a", "Ona Birch", "Ona Birch slept."), (3, "b", "ona", "by ona"), (4, "c", "Ed Elm", None)], "doc_id long, node_id string, name string, text string")
    judged = R.prevalidate(c)
    assert {r["doc_id"]: r["reason"] for r in judged.collect()} == {1: None, 2: "no cue", 3: "name", 4: "absent"}
    v = spark.createDataFrame([(1, "a", True, 0.95, "written by  Ona Birch"), (2, "a", True, 0.99, "Ona Birch slept.")], "doc_id long, node_id string, is_author boolean, score double, quote string")
    ev = R.apply_verdicts(judged, v)
    assert {r["doc_id"]: r["status"] for r in ev.collect()} == {1: "qualified", 2: "rejected", 3: "rejected", 4: "rejected"}
    links = spark.createDataFrame([(1, "a", "reader", 1.0), (2, "a", "author", 1.0)], "doc_id long, node_id string, role string, confidence double")
    d = spark.createDataFrame([(1, "a", "approve"), (2, "a", "reject")], "doc_id long, node_id string, decision string")
    now, invalid = R.apply_reviews(links, ev, d)
    assert {(r["doc_id"], r["role"]) for r in now.collect()} == {(1, "reader"), (1, "author"), (2, "author")} and invalid.count() == 1


@pytest.mark.parametrize("text, existence", [("", True), ("Do we have a copy?", True), ("where is it", False), ("lease 2024", True), ("is it?", False), ("nowhere", True)])
def test_existence_checks(spark, text, existence):
    assert value(spark, R.is_existence_check(F.col("t")), t=text) is existence


def test_hints(spark):
    v = lambda c, t: value(spark, c, t=t)
    t = F.col("t")
    assert v(R.query_tokens(t), "Find the lease of Straße x 2024") == ["lease", "Straße", "2024"]
    assert v(R.quoted_terms(t), 'open "my file" and a_b.pdf, a_b.pdf') == ["my file", "a_b.pdf"]
    assert v(R.path_hints(t), "C:\\Trips\\Sea/x.txt") == ["Trips", "Sea"] and v(R.path_hints(t), "x.txt") == []
    assert v(R.capital_codes(t), "ZRH THE ABCD LIS PDF OPO GVA") == ["ZRH", "LIS", "OPO"]
    assert v(R.labelled_names(t), "Passenger: Ona Birch, 5; Name: X;") == ["Ona Birch"]
    assert v(files.code_and_language(t), "/x/SR-220.1-2024-DE.xml").asDict() == {"code": "220.1", "lang": "de"}
    assert v(files.code_and_language(t), "/x/SR_220/IT/a.xml").asDict() == {"code": "220", "lang": "it"}
    assert v(files.code_and_language(t), "/x/a.xml").asDict() == {"code": None, "lang": "fr"}


def test_themes_and_taxonomy(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"themes": [{"id": "a", "parent": None, "keywords": ["x"]}, {"id": "a", "parent": "r", "keywords": ["y"]}]}, indent=1))
    seed = files.reviewed_themes(spark, str(tmp_path / "t.json"))
    old = spark.createDataFrame([("a", None, []), ("b", "r", ["k"])], seed.schema)
    now, versions = files.sync_taxonomy(old, seed, spark.createDataFrame([("v1",)], "version string"), "v1")
    assert {(r["category"], r["parent"], tuple(r["keywords"])) for r in now.collect()} == {("a", "r", ("y",)), ("b", "r", ("k",))} and versions.count() == 1


def test_edits_of_categories_and_nodes(spark):
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, category string")
    moved, cats = R.split_category(d, spark.createDataFrame([("a", None), ("b", None)], "category string, parent string"), "a", spark.createDataFrame([(1, "a1"), (3, "a1")], "doc_id long, child string"))
    assert {r["doc_id"]: r["category"] for r in moved.collect()} == {1: "a1", 2: "a", 3: "b"} and cats.where("category = 'a1' and parent = 'a'").count() == 1
    c = spark.createDataFrame([(1, "[OLD] x"), (2, "y"), (9, "[OLD] z")], "doc_id long, chunk_text string")
    assert {r["doc_id"]: r["chunk_text"] for r in R.reindex_chunks(c, moved).collect()} == {1: "[A1] x", 2: "y", 9: "[OLD] z"}
    n = spark.createDataFrame([("1", "location", "x.PDF"), ("2", "location", "Oldtown"), ("3", "person", "x.pdf"), ("4", "location", None)], "node_id string, node_type string, name string")
    assert {r["node_id"] for r in R.valid_nodes(n).collect()} == {"2", "3", "4"}


def test_focus_and_portraits(spark):
    n = spark.createDataFrame([("p_1", "part", "Old Mill"), ("old_mill", "part", "x")], "node_id string, node_type string, name string")
    asked = spark.createDataFrame([("old_mill",), ("OLD MILL",), ("Old-Mill",), ("none",)], "asked string")
    assert {r["asked"]: r["node_id"] for r in R.resolve_focus(asked, n).collect()} == {"old_mill": "old_mill", "OLD MILL": "p_1", "Old-Mill": "p_1"}
    tier = lambda *rows: spark.createDataFrame(list(rows), "node_id string, doc long, excerpt string")
    got = R.portraits(n.where("node_id = 'p_1'"), [tier(("p_1", 2, "b")), tier(("p_1", 1, "a"), ("p_1", 2, "b"), ("q", 1, "z"))], 2).collect()
    assert [(r["doc"], r["tier"], r["rank"]) for r in got] == [(2, 0, 1), (1, 1, 2)]


def test_themes_replace_older_ones(spark):
    links = spark.createDataFrame([(1, "theme_x", "theme", 1.0), (1, "p", "party", 1.0), (2, "theme_x", "theme", 1.0), (3, "theme_x", "theme", 1.0)], "doc_id long, node_id string, role string, confidence double")
    now = R.attach_themes(links, spark.createDataFrame([(1, "law"), (2, "unclassified"), (4, None), (5, "law")], "doc_id long, theme string"))
    assert {(r["doc_id"], r["node_id"]) for r in now.collect()} == {(1, "p"), (1, "theme_law"), (3, "theme_x"), (5, "theme_law")}
