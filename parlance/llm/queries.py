"""The op1 to op10 queries: each applies its operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import bpe_codec, bpe_count, host_rules, langmix, linkrank, mixing, ogg, oracles, simhash, substring_dedup, toxicity
from parlance.runtime import read_table


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkrank.judge(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_decode(read_table(spark, sf_dir, "documents"))


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langmix.learn(docs.filter(~langmix.held_out(F.col("doc_id"))))
    return langmix.predict(docs, model).select("doc_id", langmix.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "mixture")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(read_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    out = toxicity.held_out(F.col("doc_id"))
    return toxicity.score(docs, toxicity.learn(docs, labels.filter(~out))).select("doc_id", out.alias("held_out"), "score", "predicted")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.cluster(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id", "n_links")


def op9_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_columns(read_table(spark, sf_dir, "documents"))


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(read_table(spark, sf_dir, "documents")).drop("host", "host_rate")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_source_mix, op2_url_filter, op3_bpe_codec, op4_language_mixture, op5_substring_dedup, op6_token_count, op7_toxicity, op8_simhash_dedup, op9_ogg_media, op10_host_rules]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return oracles.ORACLES
