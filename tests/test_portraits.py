"""Portraits, author graphs, remapped graphs, backfilled obligations, ledger pages and scan reports on small cases."""

import datetime

from pyspark.sql import functions as F

from ledgerloom.operators import actions, ledger, portraits


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_facts(spark):
    focus = spark.createDataFrame([("a",), ("a",), ("none",)], "node_id string")
    edges = spark.createDataFrame([("a", "b", "r", 1.0), ("c", "a", "s", 3.0), ("a", "d", "r", 2.0), ("b", "c", "r", 9.0)], "src string, dst string, relation string, weight double")
    links = spark.createDataFrame([("d1", "a"), ("d1", "a"), ("d2", "a"), ("d3", "b")], "doc string, node_id string")
    todo = spark.createDataFrame([(1, "d1", "completed", None), (2, "d1", "pending", "2024-05-01"), (3, "d2", "pending", "2024-01-01"), (4, "d3", "pending", None)], "action_id long, doc string, status string, due string").withColumn("due", F.col("due").cast("date"))
    docs = spark.createDataFrame([("d1", "2023"), ("d2", None), ("d3", "2024")], "doc string, doc_date string")
    got = portraits.facts(focus, edges, links, todo, docs, F.lit("2024-03-01").cast("date"), most=2)
    assert rows(got, "node_id", "section", "place", "ref", "detail") == {
        ("a", "edge", 1, "c", "<s"), ("a", "edge", 2, "d", "r>"), ("a", "action", 1, "3", "pending"), ("a", "action", 2, "2", "pending"), ("a", "document", 1, "d1", "2023"), ("a", "document", 2, "d2", None),
    }


def test_author_graph(spark):
    nodes = spark.createDataFrame([("p", "person", "Ona"), ("q", "person", "bel"), ("o", "organization", "Org")], "node_id string, node_type string, name string")
    links = spark.createDataFrame([(1, "p", "author", 0.5), (1, "p", "mention", 0.9), (2, "p", "mention", 0.7), (3, "q", "mention", 0.2), (4, "q", "author", 0.1), (1, "o", "author", 1.0)], "doc long, node_id string, role string, confidence double")
    reviews = spark.createDataFrame([(2, "p", "rejected"), (9, "q", "approved")], "doc long, node_id string, status string")
    found, edges = portraits.author_graph(links, nodes, reviews)
    assert [tuple(r) for r in found.collect()] == [("q", "bel", 2, 1, 1, 0), ("p", "Ona", 2, 1, 0, 1)]
    assert rows(edges, "node_id", "doc", "decision", "place") == {("p", 1, "approved", 1), ("p", 2, "rejected", 2), ("q", 3, "pending", 1), ("q", 4, "approved", 2)}
    found, edges = portraits.author_graph(links, nodes, reviews, "rejected", documents=1)
    assert [r["node_id"] for r in found.collect()] == ["p"] and rows(edges, "doc", "decision") == {(2, "rejected")}


def test_remap(spark):
    nodes = spark.createDataFrame([("a1", "t", "A one"), ("a2", "t", "A two"), ("b", "t", "B"), ("old", "t", "Old")], "node_id string, node_type string, name string")
    edges = spark.createDataFrame([("a1", "b", "r", 1.0), ("a2", "b", "r", 4.0), ("a1", "a2", "r", 1.0), ("old", "b", "r", 1.0)], "src string, dst string, relation string, weight double")
    links = spark.createDataFrame([("d", "a1"), ("d", "a2"), ("d", "old")], "doc string, node_id string")
    mapping = spark.createDataFrame([("a1", "A"), ("a2", "A")], "alias string, canonical string")
    n, e, k = portraits.remap(nodes, edges, links, mapping, spark.createDataFrame([("old",)], "node_id string"))
    assert rows(n, "node_id", "name") == {("A", "A one"), ("b", "B")} and rows(e, "src", "dst", "relation", "weight") == {("A", "b", "r", 4.0)} and rows(k, "doc", "node_id") == {("d", "A")}


def test_backfill(spark):
    docs = spark.createDataFrame([(1, "Invoice of EUR 250.00, due date: 2024-02-15"), (2, "we paid 250.00"), (3, "Rechnung, zahlbar bis 31.03.2024"), (4, "please sign"), (5, None)], "doc_id long, text string")
    known = spark.createDataFrame([(3, "payment", datetime.date(2024, 3, 31), None)], "doc_id long, action_type string, due date, amount decimal(18,2)")
    found, counts = actions.backfill_obligations(docs, known, F.lit("2024-03-01").cast("date"))
    assert rows(found, "doc_id", "action_type", "status", "fulfilled_by") == {(1, "payment", "completed", 2), (4, "signature", "pending", None)}
    assert rows(counts, "action_type", "found", "new", "pending", "overdue", "completed") == {("payment", 2, 1, 0, 0, 1), ("signature", 1, 1, 1, 0, 0)}
    again, _ = actions.backfill_obligations(docs, known, F.lit("2024-03-01").cast("date"))
    assert rows(found, "action_id") == rows(again, "action_id")
    nothing, _ = actions.backfill_obligations(docs, found.unionByName(known.withColumns({"action_id": F.lit("k"), "status": F.lit("x"), "fulfilled_by": F.lit(None).cast("long"), "evidence": F.lit("")})), F.lit("2024-03-01").cast("date"))
    assert nothing.collect() == []


def test_pages_and_reports(spark):
    docs = spark.createDataFrame([("h1", "A.txt", "done", "x"), ("h2", "b.txt", "done", "y"), ("h3", "a2.txt", "open", "x")], "sha256_hash string, name string, status string, category string").withColumns({"doc_date": F.lit(None).cast("timestamp"), "created": F.lit(None).cast("timestamp")})
    files = spark.createDataFrame([("h1", 1), ("h1", 2), ("h3", 3)], "sha256_hash string, mtime long").withColumn("mtime", F.timestamp_seconds("mtime"))
    assert rows(ledger.matching(docs, files, "a", statuses=["done"]), "sha256_hash", "copies") == {("h1", 2)}
    assert ledger.matching(docs, files, categories=[]).count() == 0 and ledger.matching(docs, files, only_duplicates=True).count() == 1
    assert [r["name"] for r in ledger.listing(docs, files, None, False, [F.col("name")], 1, 1, categories=["x", "y"]).collect()] == ["a2.txt"]
    judged = spark.createDataFrame([("r", "new"), ("r", "error"), ("q", "unchanged")], "root string, status string")
    roots = spark.createDataFrame([("r", True), ("s", False)], "root string, online boolean")
    got = {r["root"]: (r["scanned"], r["ingested"], r["duplicates"], r["unchanged"], r["errors"], r["offline"]) for r in ledger.scan_report(judged, roots).collect()}
    assert got == {"r": (2, 1, 0, 0, 1, 0), "q": (1, 0, 0, 1, 0, 0), "s": (0, 0, 0, 0, 0, 1), None: (3, 1, 0, 1, 1, 1)}
    table = spark.createDataFrame([("a", "b"), ("a", "z")], "src string, dst string")
    assert rows(ledger.dangling({"e": (table, ["src", "dst"])}, spark.createDataFrame([("a",), ("b",)], "id string")), "table", "rows", "dangling") == {("e", 2, 1)}
