"""A training corpus from `documents`: language, near copies, shared passages, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import bpe_codec, langmix, mixing, simhash, substring_dedup
from parlance.runtime import read_table, shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no learnt language, or with none that has a fair part of the text, go (operator 4)."""
    return langmix.accepted(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id (operator 8)."""
    return simhash.representatives(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out (operator 5)."""
    return substring_dedup.deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target shares: rows are whole documents, once or twice, and spans of them (operator 1)."""
    return mixing.mixed_texts(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them, for every row (operator 3)."""
    return bpe_codec.encode_decode(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("passages", passages), ("source_mix", source_mix), ("tokens", tokens)]

#: Models, XXH64 fingerprints and BPE are beyond SQL; tests compare with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; an empty table gives an empty result."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/parlance/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
