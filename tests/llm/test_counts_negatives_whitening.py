"""Token counts, hard negatives and whitening against the library, brute force and numpy."""

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import hard_negatives, registry, token_counts, whitening

SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
NEWER = "Ᲊ꟎\U0001df1f\U00010940"  # characters that Unicode tables may place differently


def library_length(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_op11(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = registry.queries()["op11_cached_token_counts"](spark, SF).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for row in docs.itertuples():
        n = library_length(row.text)
        assert tuple(got.loc[row.doc_id]) == (len((row.text or "").encode()), n, n > 512)


TEXTS = [
    None, "", " ", "a", "it's we'll  I'M\n\n x", "<|endoftext|>", "a <|endoftext|><|endoftext|> b", "<|endoftext| >", "tab\there  \t  end ", "é ü 漢字 ١٢٣ 1½ ​ \x1c\x85\xa0x", NEWER, f"a{NEWER} b1{NEWER}2 .{NEWER[0]}!",
    "word " * 2000, "x" * 5000, "9" * 3000, " " * 200_000 + "x", "\n \t" * 1000, "Donaudampfschifffahrtsgesellschaftskapitän" * 3, "🙂🙃 family 👨‍👩‍👧",
]


@pytest.mark.parametrize(("cache", "frequent", "lazy"), [(1 << 18, 1 << 16, 1 << 20), (3, 5, 10), (1, 0, 1 << 20)])
def test_counts_equal_the_library(spark, monkeypatch, cache, frequent, lazy):
    monkeypatch.setattr(token_counts, "LAZY_CHARS", lazy)
    rows = [(i, t, 7, "kept") for i, t in enumerate([*TEXTS, *TEXTS[:4]])] + [(None, "no id", 1, "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_Tokens int, other string")
    got = token_counts.count_tokens(docs, cache=cache, frequent=frequent)
    assert got.columns == ["doc_id", "text", "other", "n_bytes", "n_tokens", "over_limit"]
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        n = library_length(r["text"])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"], r["other"]) == (len((r["text"] or "").encode()), n, n > 512, "kept")


def test_walking_a_text_equals_listing_it():
    splitter = token_counts.PreTokens("byte_bpe_50k")
    for text in filter(None, TEXTS):
        for lazy in (0, 1 << 30):
            token_counts.LAZY_CHARS, before = lazy, token_counts.LAZY_CHARS
            found = list(splitter.of(text)[0])
            token_counts.LAZY_CHARS = before
            assert "".join(found) == text.replace("<|endoftext|>", "")


def test_counts_of_an_empty_table(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_compact_table():
    lengths = {f"k{i}é" * (i % 5 + 1): i % 300 for i in range(5000)} | {"": 0, " a": 1}
    table = token_counts.CompactTable(lengths)
    assert len(table) == len(lengths) and all(table.get(k) == n for k, n in lengths.items())
    assert all(table.get(k) is None for k in ("k", "k0", "zz", "é"))
    assert table.nbytes <= len(lengths) * (4 * token_counts.KEY_CHARS + 4 + 2 + 16)
    assert token_counts.CompactTable({}).get("a") is None


def test_cache_is_bounded():
    calls = []
    cached = token_counts.CachedLengths(token_counts.CompactTable({"a": 9}), lambda k: calls.append(k) or 2, 3)
    assert [cached[k] for k in "abcbda"] == [9, 2, 2, 2, 2, 9] and calls == ["b", "c", "d"] and len(cached) <= 3
    assert cached["y" * 100] == 2 and "y" * 100 not in cached


@pytest.mark.parametrize("shape", [(1, 1, 1), (0, 3, 4), (3, 0, 4), (2, 3, 5), (17, 64, 33), (70, 71, 72), (5, 300, 129), (130, 1, 130)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(sum(shape))
    for scale in (3, 10**4, 2**28):
        a, b = rng.integers(-scale, scale, shape[:2]), rng.integers(-scale, scale, shape[1:])
        for leaf in (1, 4, 32):
            assert (hard_negatives.strassen(a, b, leaf) == a @ b).all()


def test_scores_beyond_longs_are_held():
    a = np.array([[2.0**40, 1.0]])
    assert hard_negatives.scores_of(a, np.array([[2.0**40, 0.0], [-(2.0**40), 5.0], [3.0, 2.0]])).tolist() == [[2**63 - 1, -(2**63), 3 * 2**40 + 2]]


@pytest.mark.parametrize("score", [-101, -5, -1, 0, 1, 4, 5, 99, 100, 12345])
def test_window(score):
    least, greatest = hard_negatives.window_of(score, 80, 100)
    assert [n for n in range(-200, 13000) if 80 * score <= 100 * n <= 100 * score] == list(range(least, greatest + 1))


def brute_negatives(rows, every, k=5):
    good = [(i, label, [int(np.floor(256 * float(x))) for x in v]) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for anchor in sorted({i for i, _, _ in good if i % every == 0}):
        _, label, v = min((r for r in good if r[0] == anchor), key=lambda r: (len(r[2]), r[1], r[2]))
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, lab) for i, lab, w in good if len(w) == len(v))
        positives = [(-s, i) for s, i, lab in scored if lab == label and i != anchor][:k]
        for place, (p, positive) in enumerate(positives, 1):
            hard = [(-s, i) for s, i, lab in scored if lab != label and 80 * p <= -100 * s <= 100 * p][:k]
            out += [(anchor, positive, rank, i, p, s, place) for rank, (s, i) in enumerate(hard, 1)]
    return sorted(out)


def test_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(4, 6))
    rows = []
    for i in range(400):
        label = 0 if i % 3 == 0 else int(rng.integers(0, 4))  # a hot label
        rows.append((i, (centre[label] * 0.2 + rng.normal(size=6) * 0.3).tolist(), label))
    same = [0.5, 0.25, 0.0, -0.5, 0.125, 0.0]
    rows += [(i, same, i % 2) for i in range(400, 480)]  # ties
    rows += [(11, same, 1), (11, same, 1), (20, [0.1] * 6, 3)]  # repeated rows and a repeated anchor
    rows += [(500, None, 1), (520, [None] + same[1:], 1), (540, [float("nan")] * 6, 1), (560, [float("inf")] * 6, 1), (580, same, None), (None, same, 1), (600, [], 1), (620, same[:3], 0), (623, same[:3], 0), (625, same[:3], 1), (640, [0.0] * 6, 1)]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, rank string")
    for tile in (16, 64, 4096):
        got = hard_negatives.mine(vectors, every=20, anchor_tile=max(4, tile // 8), candidate_tile=tile)
        assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, 20)


def test_anchor_tiles_follow_the_anchors(spark):
    """Ids that are all anchors give as many tiles as they need."""
    rng = np.random.default_rng(9)
    rows = [(i * 100, rng.normal(size=4).tolist(), i % 2) for i in range(60)]
    got = hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), anchor_tile=8, candidate_tile=16)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, 100)


def test_negatives_of_an_empty_table(spark):
    assert hard_negatives.mine(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def expected_whitening(vectors, k=8):
    x = np.floor(1024 * np.asarray(vectors, float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum(int(c) ** 2 for c in n * row - sums) for row in x]
    centred = (n * x - sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return deviation, centred @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check_whitening(got, ids, vectors, k):
    deviation, white, explained = expected_whitening(vectors, k)
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert sorted(got["component"].unique()) == list(range(1, k + 1)) and len(got) == k * len(ids)
    sign = np.sign((table * white).sum(axis=0))
    np.testing.assert_allclose(table * sign, white, atol=1e-8)
    assert got.drop_duplicates("vec_id").set_index("vec_id").loc[ids, "deviation"].tolist() == deviation
    np.testing.assert_allclose(got.groupby("component")["explained"].first(), explained, rtol=1e-9)
    assert got["n"].eq(len(ids)).all() and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_op13(spark):
    vectors = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    check_whitening(registry.queries()["op13_block_whitening"](spark, SF).toPandas(), vectors["vec_id"].tolist(), np.stack(vectors["embedding"]), 8)


def test_whitening_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS_PER_BLOCK", 7)
    monkeypatch.setattr(whitening, "COLS_PER_BLOCK", 4)
    monkeypatch.setattr(whitening, "BLOCKS_PER_SPLIT", 3)
    rng = np.random.default_rng(2)
    good = rng.normal(size=(150, 10)) * np.arange(1, 11)
    good[100:] = good[100]  # a third of all rows are copies
    rows = [(i, v.tolist(), "x") for i, v in enumerate(good)]
    bad = [(900, None, "x"), (901, [None] + [0.0] * 9, "x"), (902, [float("nan")] * 10, "x"), (903, [float("inf")] * 10, "x"), (904, [], "x"), (905, [1.0] * 4, "x")]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, component string").repartition(5)
    check_whitening(whitening.whiten(frame, components=3).toPandas(), list(range(150)), good, 3)


def test_whitening_without_variance(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(frame([])).collect() == []
    assert whitening.whiten(frame([(1, None)])).collect() == []
    for rows in ([(1, [0.5, 0.25])], [(1, [0.5, 0.25])] * 3):
        got = whitening.whiten(frame(rows)).collect()
        assert len(got) == 2 * len(rows) and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(len(rows), 0, None, None, None)}
    flat = whitening.whiten(frame([(i, [float(i), 0.5, 0.0]) for i in range(4)] + [(None, [9.0, 0.5, 0.0])]))  # rank one, a null id
    first = flat.where("component = 1").toPandas()
    np.testing.assert_allclose(sorted(abs(first["whitened"])), np.array([0, 1, 2, 3, 6]) / 10**0.5, atol=1e-12)
    assert abs(first["explained"] - 1).max() < 1e-12 and first["identity_error"].max() < 1e-12
    assert flat.where("component > 1 and whitened is null and explained < 1e-12").count() == 10


def test_deviation_beyond_a_long_is_null(spark):
    got = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [3e13, 0.0])], "vec_id long, embedding array<double>"))
    assert got.where(F.col("deviation").isNull()).count() == 4


def test_enormous_components(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [3.0e15, 0.5]), (4, [0.0, 0.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=1).toPandas()
    x = [[min(max(int(np.floor(np.clip(1024 * c, -9e18, 9e18))), -(2**63)), 2**63 - 1) + 100_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((4 * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    told = got.set_index("vec_id")["deviation"]
    assert [None if pd.isna(told[i + 1]) else int(told[i + 1]) for i in range(4)] == [None if w >= 2**63 else w for w in want]
    assert got["whitened"].notna().all() and got["identity_error"].max() < 1e-6
