"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import chat, hard_negatives, imatch, langid, mixing, near_dup, packing, pii, secret_scan, sharding, token_counts, topk, whitening

SHARDS = [f"shard-{i:02d}" for i in range(64)]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"))


def op3_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(_read(spark, sf_dir, "documents")))


def op4_secret_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(langid.is_training(F.col("doc_id"))))
    return langid.classify(docs, model).withColumn("held_out", ~langid.is_training(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_table_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_read(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op7_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op8_probminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"))


def op9_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.match_edited(_read(spark, sf_dir, "documents"))


def op10_chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_turns(own.unionByName(extra)))


def op11_cached_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op12_strassen_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.shifted_labels(_read(spark, sf_dir, "embeddings")))


def op13_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_pfair_mixing, op2_exact_topk, op3_pii_deobfuscation, op4_secret_entropy, op5_zstd_language, op6_table_sharding, op7_bin_slack_packing, op8_probminhash_classes, op9_imatch_fingerprints, op10_chat_tokens, op11_cached_token_counts, op12_strassen_negatives, op13_block_whitening, pipeline]
    return {f.__name__: f for f in own}


TOPK_SQL = """
with q as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) v from embeddings),
good as (select * from q where vec_id is not null and v is not null),
pairs as (select a.vec_id query_id, b.vec_id vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint score
  from good a join good b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as "rank" from pairs)
select query_id, "rank", vec_id, score from ranked where "rank" <= 10
"""


NEGATIVES_SQL = """
with q as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end lab, embedding,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select a.vec_id anchor_id, b.vec_id other_id, a.lab = b.lab alike, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint score
  from q a join q b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
pos as (select anchor_id, other_id positive_id, score positive_score, row_number() over (partition by anchor_id order by score desc, other_id)::int positive_rank
  from pairs where alike qualify positive_rank <= 5),
neg as (select p.*, n.other_id negative_id, n.score negative_score, row_number() over (partition by p.anchor_id, p.positive_rank order by n.score desc, n.other_id)::int as "rank"
  from pos p join pairs n on n.anchor_id = p.anchor_id and not n.alike and 80 * p.positive_score <= 100 * n.score and n.score <= p.positive_score)
select anchor_id, positive_id, "rank", negative_id, positive_score, negative_score, positive_rank from neg where "rank" <= 5
"""


def _sharding_sql() -> str:
    slots = sharding.next_prime(sharding.SLOTS_PER_SHARD * len(SHARDS))
    names = ", ".join(f"'{s}'" for s in sharding.fill_table(SHARDS, slots))
    return f"""
with t as (select [{names}] names),
keyed as (select doc_id, (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint % {slots}) shard_slot from documents)
select doc_id, shard_slot, names[shard_slot + 1] shard from keyed, t
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_topk": TOPK_SQL, "op6_table_sharding": _sharding_sql(), "op12_strassen_negatives": NEGATIVES_SQL}
