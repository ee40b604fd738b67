"""Inverted lists of vectors against the exact search."""

import numpy as np

from ledgerloom.operators import retrieval, vector_index


def test_all_lists_give_the_exact_result_and_some_most_of_it(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "SHARD_ROWS", 40)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8)) * 3
    rows = [(i, (centres[i % 12] + rng.normal(size=8)).tolist()) for i in range(600)] + [(700 + i, [1.0] * 8) for i in range(150)]  # many copies
    odd = [(1000, None), (1001, [0.0] * 8), (1002, [1.0, 2.0]), (1003, []), (None, [1.0] * 8), (1004, [float("nan")] * 8)]
    vectors = spark.createDataFrame(rows + odd, "doc_id long, v array<double>")
    asked = spark.createDataFrame([(i, v) for i, v in rows if i % 50 == 0] + [(5000, [1.0, 2.0]), (5001, None), (5002, [0.0] * 8)], "query_id long, q array<double>")
    index = vector_index.build(vectors, str(tmp_path / "v"), lists=12, sample_rows=300)
    assert index.rows().count() == len(rows) + 2 and len(index.centres) == 12
    good = vectors.where("doc_id is not null and v is not null and not exists(v, c -> isnan(c))")
    exact = retrieval.vector_topk(good, asked.where("q is not null"), 5).cache()
    key = lambda df: sorted(tuple(r) for r in df.select("query_id", "doc_id", "score", "rank").collect())
    assert key(vector_index.search(index, asked, 5, probes=12)) == key(exact)
    told = vector_index.recall(vector_index.search(index, asked, 5, probes=4), exact).first()
    assert told["recall"] >= 0.9


def test_index_of_no_vectors(spark, tmp_path):
    index = vector_index.build(spark.createDataFrame([(1, None)], "doc_id long, v array<double>"), str(tmp_path / "v"))
    assert vector_index.search(index, spark.createDataFrame([(1, [1.0])], "query_id long, q array<double>")).collect() == []
