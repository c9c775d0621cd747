"""The opN_ queries: each applies its operator to its whole table and derives the stated columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontamination, lm_scoring, near_dedup, neighbours, oracles, packing, pii, quality, secrets, sharding
from ._shared import table


def vocabulary() -> str:
    """The tokenizer file of op7_packing and the pipeline."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digest(chat_format.with_control_strings(table(spark, sf_dir, "conversations")))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 50 = 0"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.group(table(spark, sf_dir, "documents"), words=3, percent=85)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary())


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_lm_scores": op1_lm_scores,
    "op2_secret_scan": op2_secret_scan,
    "op3_chat_format": op3_chat_format,
    "op4_nearest": op4_nearest,
    "op5_quality": op5_quality,
    "op6_near_dedup": op6_near_dedup,
    "op7_packing": op7_packing,
    "op8_shards": op8_shards,
    "op9_personal_data": op9_personal_data,
    "op10_decontamination": op10_decontamination,
}

ORACLES: dict[str, str] = {
    "op2_secret_scan": oracles.SECRETS,
    "op3_chat_format": oracles.CHAT,
    "op6_near_dedup": oracles.NEAR_DUPLICATES,
    "op10_decontamination": oracles.DECONTAMINATION,
}
