"""Pruning rules, sampling by recency, bridges by type, first edges, retries."""

import datetime

from pyspark.sql import functions as F

from ledgerloom.operators import graph
from ledgerloom.streaming import jobs


CONTRACTS, BLACKLIST = ["lease_contract"], {"organization": "^memory bank$", "person": "^dear sir"}


def test_pruning_rules(spark):
    nodes = spark.createDataFrame(
        [("c1", "contract_type", "Lease Contract 2"), ("c2", "contract_type", "Invoice"), ("o1", "organization", "Baar "), ("o2", "organization", "Memory Bank"), ("p1", "person", "memory bank"), ("p2", "person", "Dear Sir X"), ("x", "person", "a\nb"), ("y", "person", "c\nd"), ("n", "organization", None)],
        "node_id string, node_type string, name string",
    )
    edges = spark.createDataFrame([("o2", "c1", "r"), ("c1", "p1", "r"), ("y", "c1", "r")], "src string, dst string, relation string")
    links = spark.createDataFrame([("d", n) for n in ("o2", "p2", "x", "y", "c1")], "doc string, node_id string")
    places = spark.createDataFrame([("baar",), (None,)], "name string")
    bad = graph.noisy_name(F.col("name"))
    assert graph.prune(nodes, edges, links, bad, places, CONTRACTS, BLACKLIST, dry_run=True).first().asDict() == {"recategorised": 1, "retyped": 1, "dropped": 1, "blacklisted": 2}
    kept, left, linked = graph.prune(nodes, edges, links, bad, places, CONTRACTS, BLACKLIST)
    assert {(r["node_id"], r["node_type"]) for r in kept.collect()} == {("c1", "contract_type"), ("c2", "document_category"), ("o1", "location"), ("p1", "person"), ("y", "person"), ("n", "organization")}
    assert {(r["src"], r["dst"]) for r in left.collect()} == {("c1", "p1"), ("y", "c1")} and {r["node_id"] for r in linked.collect()} == {"y", "c1"}
    assert graph.prune(nodes.limit(0), edges, links, bad, places, CONTRACTS, BLACKLIST, dry_run=True).first()["retyped"] == 0


def test_recency_and_bridges(spark):
    nodes = spark.createDataFrame([("a", "person"), ("b", "location"), ("c", "statute"), ("e", "person"), ("f", "person")], "node_id string, node_type string")
    edges = spark.createDataFrame([("b", "c", "r", 1), ("e", "c", "r", 1)], "src string, dst string, relation string, weight int")
    links = spark.createDataFrame([("d1", "a"), ("d1", "b"), ("d1", "c"), ("d2", "a"), ("d2", "c"), ("d3", "f"), ("d3", "e")], "doc string, node_id string")
    assert {tuple(r) for r in graph.bridge_isolated(nodes, edges, links).collect()} == {("a", "c", "SUBJECT_TO", 2), ("f", "e", "CO_OCCURS", 1)}
    dates = spark.createDataFrame([("d1", datetime.date(2020, 1, 1)), ("d3", datetime.date(2024, 5, 1))], "doc string, doc_date date")
    got = [(r["node_id"], r["overall"]) for r in graph.sampled_nodes(graph.node_stats(nodes, edges, links, dates), 2, 3).collect()]
    assert got == [("e", 2 + 3 + 190), ("c", 4 + 6 + 150), ("a", 0 + 6 + 150)]


def test_first_edges_and_links(spark):
    edges = spark.createDataFrame([("a", "b", "r", 5, 2), ("a", "b", "r", 1, 1), ("a", "b", "s", 7, 3)], "src string, dst string, relation string, weight int, seq int")
    assert {tuple(r) for r in graph.first_edges(edges, "seq").collect()} == {("a", "b", "r", 1), ("a", "b", "s", 7)}
    links = spark.createDataFrame([("d", "a"), ("d", "a2"), ("e", "b")], "doc string, node_id string")
    mapping = spark.createDataFrame([("a2", "a")], "alias string, canonical string")
    assert {tuple(r) for r in graph.consolidate_links(links, mapping).collect()} == {("d", "a"), ("e", "b")}


def test_retries_and_stranded_entries(spark):
    letters = spark.createDataFrame([(1, "bad", 1), (2, "bad", 2), (3, "bad", 3)], "doc_id long, error string, retries int")
    done, failed = jobs.retry(letters, lambda b: b.withColumn("error", F.when(F.col("doc_id") == 2, "again")))
    assert [r["doc_id"] for r in done.collect()] == [1] and {(r["doc_id"], r["retries"]) for r in failed.collect()} == {(2, 3), (3, 3)}
    entries = spark.sql("select * from values (1, 'processing', timestamp'2024-01-01 00:00:00'), (2, 'processing', timestamp'2024-01-01 00:01:30'), (3, 'done', timestamp'2024-01-01 00:00:00') as t(doc_id, status, enqueued_at)")
    assert {(r["doc_id"], r["status"]) for r in jobs.stranded(entries, "2024-01-01 00:02:00").collect()} == {(1, "pending"), (2, "processing"), (3, "done")}
