"""The stored keyword index against searches without one."""

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.operators import retrieval, term_index


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    names = [f"w{i}" for i in range(60)]
    share = 1 / np.arange(1, 61)
    rows = [(i, f"f{i % 7}.txt", " ".join(rng.choice(names, rng.integers(1, 40), p=share / share.sum()))) for i in range(600)]
    rows += [(600 + i, "same.txt", rows[5][2]) for i in range(40)] + [(700, None, None), (701, "x.txt", ""), (None, "x.txt", "w1 w2")]
    return spark.createDataFrame(rows, "doc_id long, filename string, text string")


@pytest.mark.parametrize("every", [True, False])
@pytest.mark.parametrize("first_groups", [1, 4])
def test_index_gives_the_same_rows(spark, docs, tmp_path_factory, every, first_groups):
    path = str(tmp_path_factory.mktemp("index"))
    index = term_index.build(docs, path, docs_per_group=16)
    asked = spark.createDataFrame([(1, "w1 w2"), (2, "w50 w3"), (3, "w59 w58 w57"), (4, "nothing w1"), (5, "same txt"), (6, ""), (7, "W1 w1")], "query_id long, text string")
    terms = retrieval.query_terms(asked)
    top, reads = term_index.search(index, terms, 5, every, first_groups)
    want = retrieval.bm25_terms(docs.where("doc_id is not null"), terms, 5, every)
    assert sorted(map(tuple, top.select("query_id", "doc_id", "rank").collect())) == sorted(map(tuple, want.select("query_id", "doc_id", "rank").collect()))
    got = {r["query_id"]: (r["read"], r["blocks"]) for r in reads.collect()}
    assert all(read <= blocks for read, blocks in got.values()) and sum(r for r, _ in got.values()) < sum(b for _, b in got.values())


def test_index_of_nothing(spark, docs, tmp_path):
    index = term_index.build(docs.limit(0), str(tmp_path / "i"))
    top, reads = term_index.search(index, spark.createDataFrame([(1, "w1")], "query_id long, term string"))
    assert top.collect() == [] == reads.collect()


def test_blocks_of_groups_that_span_batches():
    rows = [(0, 4, ["b", "a", "b"]), (0, 2, ["a"]), (0, 3, None), (1, 9, ["a"]), (1, 9, ["a", "c"]), (2, 5, [])]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.string()))], ["grp", "doc_id", "w"])
    for size in (1, 2, 6):
        got = [r for b in term_index._blocks((batch.slice(i, size) for i in range(0, len(rows), size)), 1.5) for r in b.to_pylist()]
        held = {(r["term"], r["grp"]): [(h["doc_id"], h["tf"], h["len"]) for h in r["held"]] for r in got}
        assert held == {("a", 0): [(2, 1, 1), (4, 1, 3)], ("b", 0): [(4, 2, 3)], ("a", 1): [(9, 2, 1)], ("c", 1): [(9, 1, 1)]} and len(got) == 4
        best = {(r["term"], r["grp"]): r["best"] for r in got}
        assert best["a", 0] == pytest.approx(2.2 / (1 + 1.2 * (0.25 + 0.75 * 1 / 1.5))) and all(r["n"] == len(r["held"]) for r in got)
