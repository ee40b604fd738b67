"""Refresh jobs on small tables."""

import math

from ledgerloom.operators import refresh, retrieval
from ledgerloom.sources import files


def test_embeddings_are_kept_or_made(spark):
    chunks = spark.createDataFrame([(1, 0, "red house"), (1, 1, "red"), (2, 0, "house red house"), (3, 0, ""), (4, 0, None)], "doc_id long, chunk_index int, chunk_text string")
    vectors = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, []), (2, 0, None), (9, 0, [1.0])], "doc_id long, chunk_index int, embedding array<float>")
    got = {(r["doc_id"], r["chunk_index"]): r for r in refresh.refresh_embeddings(chunks, vectors, 8).collect()}
    assert len(got) == 5 and got[1, 0]["kept"] and got[1, 0]["embedding"] == [1.0, 2.0]
    for key in ((1, 1), (2, 0)):
        assert not got[key]["kept"] and math.isclose(sum(x * x for x in got[key]["embedding"]), 1)
    assert got[3, 0]["embedding"] == got[4, 0]["embedding"] == [0.0] * 8


def test_one_class_of_files_is_read_anew(spark, tmp_path):
    (tmp_path / "a.md").write_text("new words"), (tmp_path / "b.txt").write_text("not read"), (tmp_path / "c.eml").write_bytes(b"Subject: x\n\nbody")
    (tmp_path / "d.docx").write_bytes(b"broken")
    found = files.scan(spark, {"one": str(tmp_path)})
    at = {r["path"].rpartition("/")[2]: r["path"] for r in found.select("path").collect()}
    docs = spark.createDataFrame([(1, "old a"), (2, "old b"), (3, "old d")], "doc_id long, text string")
    locations = spark.createDataFrame([(1, at["a.md"]), (1, "/gone/0.md"), (2, at["b.txt"]), (3, at["d.docx"])], "doc_id long, path string")
    chunks = retrieval.chunks(docs)
    fresh, parts = refresh.apply_reextraction(docs, chunks, refresh.reextracted(locations, found, "MD"))
    assert {tuple(r) for r in fresh.collect()} == {(1, "new words"), (2, "old b"), (3, "old d")}
    assert {(r["doc_id"], r["chunk_text"]) for r in parts.collect()} == {(1, "new words"), (2, "old b"), (3, "old d")}
    assert refresh.reextracted(locations, found, "docx").count() == 0


def test_links_are_mirrored_once(spark):
    links = spark.createDataFrame([("a", "n1", "MENTIONS", 0.3)], "doc_id string, node_id string, role string, confidence double")
    edges = spark.createDataFrame([("doc_a", "n1", "MENTIONS", 0.9), ("doc_b", "n1", "MENTIONS", None), ("doc_x", "n1", "MENTIONS", 1.0), ("doc_a", "gone", "MENTIONS", 1.0), ("n1", "n2", "R", 1.0)], "src string, dst string, relation string, weight double")
    placed = spark.createDataFrame([("a", "CH-ZG 1", 0.7), ("a", "CH-ZG 1", 0.8), ("b", "G9", None)], "doc_id string, geo_id string, confidence double")
    nodes = spark.createDataFrame([("n1", "{}"), ("location_ch_zg_1", None), ("place", '{"geo_id":"G9"}')], "node_id string, properties string")
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    got = {tuple(r) for r in refresh.mirror_links(links, edges, placed, nodes, docs).collect()}
    assert got == {("a", "n1", "MENTIONS", 0.3), ("b", "n1", "MENTIONS", 1.0), ("a", "location_ch_zg_1", "LOCATED_IN", 0.8), ("b", "place", "LOCATED_IN", 1.0)}
