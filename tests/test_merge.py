"""Merge sinks: touched folders only, audits, restarts; and near links against all pairs."""

import os

import numpy as np
import pytest

from ledgerloom.operators import dedup
from ledgerloom.operators.merge import ChunkStore, GraphStore


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_merge_rewrites_touched_folders_only(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"), parts=16)
    node = lambda rows: spark.createDataFrame(rows, store.NODES)
    store.merge("one", nodes=node([(f"n{i}", "t", f"name {i}", 1) for i in range(200)]))
    before = files_of(tmp_path / "g" / "nodes")
    change = node([("n5", "t", "renamed", 2), ("n6", "t", "too old", 0)])
    store.merge("two", nodes=change)
    after = files_of(tmp_path / "g" / "nodes")
    changed = {os.path.dirname(f) for f, _ in set(before.items()) ^ set(after.items())}
    assert len(before) == 16 and 1 <= len(changed) <= 2
    names = {r["node_id"]: r["name"] for r in store.nodes.read().collect()}
    assert len(names) == 200 and names["n5"] == "renamed" and names["n6"] == "name 6"
    audit = lambda: sorted((r["table"], r["key"], r["action"]) for r in store.audit().where("action <> 'inserted'").collect())
    want = [("nodes", '{"node_id":"n5"}', "updated")]
    assert audit() == want
    store.merge("two", nodes=change)  # the same batch again
    assert audit() == want and store.nodes.read().count() == 200 and store.audit().count() == 201


def test_links_have_one_theme(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"), parts=4)
    link = lambda *rows: spark.createDataFrame(list(rows), store.LINKS)
    store.merge("a", links=link(("d", "t1", "theme"), ("d", "p", "party"), ("e", "t1", "theme")))
    store.merge("b", links=link(("d", "t2", "theme"), ("d", "p", "party"), ("f", "q", "party")))
    assert {tuple(r) for r in store.links.read().collect()} == {("d", "t2", "theme"), ("d", "p", "party"), ("e", "t1", "theme"), ("f", "q", "party")}
    store.merge("c", links=link(), edges=spark.createDataFrame([("x", "y", "r", 1.0, 1), ("x", "y", "r", 2.0, 2)], store.EDGES))
    assert [tuple(r) for r in store.edges.read().collect()] == [("x", "y", "r", 2.0, 2)]
    assert {(r["table"], r["action"]) for r in store.audit().collect()} == {("links", "inserted"), ("links", "deleted"), ("edges", "inserted")}


def test_chunks_are_replaced_and_deleted_by_document(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "c"), parts=3)
    rows = lambda *r: spark.createDataFrame(list(r), "doc string, chunk_index int, chunk_text string")
    assert store.read().collect() == []
    store.replace(rows(("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")))
    ids = {(r["doc"], r["chunk_index"]): r["chunk_id"] for r in store.read().collect()}
    store.replace(rows(("a", 0, "new")))
    assert {(r["doc"], r["chunk_index"], r["chunk_text"], r["chunk_id"] == ids[r["doc"], r["chunk_index"]]) for r in store.read().collect()} == {("a", 0, "new", True), ("b", 0, "z", True)}
    store.delete(spark.createDataFrame([("b",), ("none",)], "doc string"))
    store.delete(spark.createDataFrame([("a",)], "doc string"))
    assert store.read().collect() == []


@pytest.mark.parametrize(("k", "blocks"), [(3, None), (8, None), (8, 3), (12, None), (12, 4), (12, 7)])
def test_near_links_equal_all_pairs(spark, k, blocks):
    rng = np.random.default_rng(k)
    values = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 60)] + [-1, 1, -(2**63), 2**63 - 1]
    for v in values[:30]:  # neighbours at all distances
        bits = rng.permutation(64)[: int(rng.integers(1, 15))]
        x = (v % 2**64) ^ sum(1 << int(b) for b in bits)
        values.append(x - 2**64 if x >= 2**63 else x)
    values = list(dict.fromkeys(values))
    groups = spark.createDataFrame([(v, 10 * i, 1) for i, v in enumerate(values)], "simhash long, first_doc long, docs long")
    far = lambda a, b: ((a ^ b) % 2**64).bit_count()
    want = {10 * i: sorted(d for j, w in enumerate(values) if i != j and (d := far(v, w)) <= k) for i, v in enumerate(values)}
    got = {r["first_doc"]: (r["links"], r["nearest"]) for r in dedup.near_links(groups, k, blocks).collect()}
    assert got == {i: (len(d), d[0] if d else None) for i, d in want.items()}
    if k == 8:
        assert dedup.near_candidates(groups, k, blocks).count() < len(values) ** 2 / 8
    assert sum(r + 1 for r in dedup.radii(k, 5 if blocks is None else blocks)) == k + 1 or k < 4
