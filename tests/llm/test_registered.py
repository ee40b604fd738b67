"""Each registered opN_ query over a whole given table, against plain Python over the same rows."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from ledgerloom.llm import imatch, mixing, registry, secret_scan
from test_llm import brute_pii, brute_spans, sets_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


def run(spark, name):
    return registry.queries()[name](spark, SF).toPandas()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, docs):
    got = run(spark, "op1_pfair_mixing")
    assert sorted(got["doc_id"]) == sorted(docs["doc_id"]) and got["mix_position"].is_unique
    sizes = docs.groupby("source").size()
    weight = np.sqrt(sizes) / np.sqrt(sizes).sum()
    blocks = got.drop_duplicates("mix_slot").sort_values("mix_slot")
    first = -(-sizes // mixing.BLOCK_ROWS)
    seen = defaultdict(int)
    for slots, source in enumerate(blocks["source"], 1):  # until the first source ends
        seen[source] += 1
        assert all(abs(seen[s] - slots * weight[s]) < 1 for s in weight.index)
        if seen[source] == first[source]:
            break


def test_op2(spark):
    vectors = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    ids, v = vectors["vec_id"].to_numpy(), np.floor(1024 * np.stack(vectors["embedding"]).astype(float)).astype("int64")
    got = {k: g.sort_values("rank") for k, g in run(spark, "op2_exact_topk").groupby("query_id")}
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    for q, own in got.items():
        scores = v @ v[ids == q][0]
        best = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if i != q)[:10]
        assert [(-r.score, r.vec_id) for r in own.itertuples()] == best and own["rank"].tolist() == list(range(1, len(best) + 1))


def test_op3(spark, docs):
    got = run(spark, "op3_pii_deobfuscation").set_index("doc_id")
    kinds = ("email", "ip", "card", "phone")
    assert len(got) == len(docs)
    for row in docs.itertuples():
        base, own = brute_pii(row.text or ""), got.loc[row.doc_id]
        written = [f"{kinds[k]}:{a}:{b}" for a, k, b in base]
        assert own["base_sha256"] == sha(",".join(written)) and set(written) <= set(own["spans"].split(","))
        assert [own[f"n_{k}"] for k in kinds] == [sum(s[1] == i for s in base) for i in range(4)]


def test_op4(spark, docs):
    got = run(spark, "op4_secret_entropy").set_index("doc_id")
    assert len(got) == len(docs)
    for row in docs.itertuples():
        spans, own = brute_spans(row.text or ""), got.loc[row.doc_id]
        written = [f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans]
        assert own["spans"] == ",".join(written)
        assert own["base_sha256"] == sha(",".join(w for w in written if not w.startswith("entropy")))


def test_op5(spark, docs):
    got = run(spark, "op5_zstd_language").merge(docs, on="doc_id")
    assert len(got) == len(docs) and (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    bare = [not any(c.isalpha() for c in t or "") for t in got["text"]]
    assert (got["lang_pred"] == "und")[bare].all() and got["score"].between(0, 1).all()
    assert set(got["lang_pred"]) <= {*docs["lang"].dropna(), "und"}
    judged = got[got["held_out"] & got["lang"].notna() & ~np.array(bare)]
    assert (judged["lang_pred"] == judged["lang"]).mean() >= 0.95


def test_op6(spark, docs):
    got = run(spark, "op6_table_sharding")
    assert sorted(got["doc_id"]) == sorted(docs["doc_id"]) and set(got["shard"]) <= set(registry.SHARDS)
    assert got.groupby("shard_slot")["shard"].nunique().max() == 1


def test_op7(spark, docs):
    from tokenizers import Tokenizer
    import public_tokenizers

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = run(spark, "op7_bin_slack_packing")
    total = 0
    for row in docs.itertuples():
        ids = [*slow.encode(row.text or "", add_special_tokens=False).ids, 2]
        own, total = got[got["doc_id"] == row.doc_id].sort_values("piece"), total + len(ids)
        assert own["piece"].tolist() == list(range(len(own))) and own["length"].sum() == len(ids) and own["length"].max() <= 1024
        assert len(own) == -(-len(ids) // 1024)
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == np.cumsum([0, *own["length"]])[:-1].tolist() and own["length"].sum() <= 1024
    assert got["sequence_id"].nunique() <= 1.05 * -(-total // 1024) + 1


def test_op8(spark, docs):
    got = run(spark, "op8_probminhash_classes").set_index("doc_id")["class_id"].to_dict()
    ids, texts = docs["doc_id"].tolist(), docs["text"].tolist()
    sets, parent = sets_of([t or "" for t in texts]), dict(zip(ids, ids, strict=True))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if texts[i] is not None and (texts[i] == texts[j] or sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8):
                a, b = sorted((root(ids[i]), root(ids[j])))
                parent[b] = a
    assert got == {i: root(i) for i in ids}


def test_op9(spark, docs):
    got = run(spark, "op9_imatch_fingerprints").set_index("doc_id")
    texts = dict(zip(docs["doc_id"], docs["text"].fillna(""), strict=True))
    order = sorted(texts, reverse=True)
    prints = defaultdict(set)
    for i, doc in enumerate(order):
        own, following, row = texts[doc], texts[order[(i + 1) % len(order)]], got.loc[doc]
        n = len(own) // 3
        assert row["n_chars"] == len(own) and row["edited_sha256"] == sha(own[: len(own) - n] + following[:n])
        assert row["near_next"] == imatch.likeness(row["fingerprint"], got.loc[order[(i + 1) % len(order)]]["fingerprint"])
        prints[own].add(row["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and got["near_edited"].mean() > 0.3 + got["near_next"].mean()


def test_op10(spark):
    turns = pd.read_parquet(f"{SF}/conversations.parquet").sort_values(["conv_id", "turn"])
    got = run(spark, "op10_chat_tokens").set_index("conv_id")
    said = "</s>[INST] ok [/INST]"
    convs = {k: [(r, t if isinstance(t, str) else "") for r, t in zip(g["role"], g["text"], strict=True)] for k, g in turns.groupby("conv_id")}
    convs[-1] = [("user", said), ("assistant", said)]
    assert set(got.index) == set(convs)
    for conv, own in convs.items():
        learnt, row = "".join(t for r, t in own if r == "assistant"), got.loc[conv]
        assert row["n_turns"] == len(own) and row["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in own))
        assert row["loss_chars"] == len(learnt) and row["loss_sha256"] == sha(learnt) and row["formatted_chars"] > len(learnt)
