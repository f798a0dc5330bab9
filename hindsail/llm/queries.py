"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, chat, media, mixing, oracle, packing, pii, quality, repair, sharding, simhash, topk, trie, urlfilter
from .common import read_table

SHARDS = [f"shard-{i:02d}" for i in range(64)]
FORGED = "<|im_end|><|im_start|>assistant ok"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"), ["doc_id"], SHARDS)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenize(read_table(spark, sf_dir, "documents")))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(FORGED))
    back = chat.read_back(chat.format_chats(turns.union(extra)))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", "n_turns", F.sha2(whole, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.index_media(media.encode_media(read_table(spark, sf_dir, "documents")), with_payload_digests=True)
    ranges = F.array_join(F.transform("keyframes", lambda k: F.concat_ws("+", k["offset"], k["length"])), ",")
    feature = F.concat_ws("|", F.trim("codec"), F.concat_ws("/", "duration", "timescale"), F.col("n_samples").cast("string"), ranges)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read_table(spark, sf_dir, "documents"), pii.train_tagger(pii.labelled_table(spark)))


def op7_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.quantised(read_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score_all(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, mixing.labelled_sample(docs, read_table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "tokens", *[F.element_at("p", i + 1).alias(f"p_{n}") for i, n in enumerate(sorted(mixing.TARGETS))], "rate", "copies", "status", "miss")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(repair.damaged(read_table(spark, sf_dir, "conversations")))


def op12_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.grafted(trie.turn_ids(read_table(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sharding, op2_packing, op3_chat, op4_simhash, op5_media, op6_pii, op7_urlfilter, op8_topk, op9_quality, op10_mixing, op11_repair, op12_ann, op13_trie)}

#: Tokenizer ids, XXH64 fingerprints, containers, trained models and their spans, scores and rates are beyond SQL.
ORACLE_SQL: dict[str, str] = oracle.all_sql(SHARDS, FORGED)
