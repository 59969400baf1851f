"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession

from geoloom.llm import chat, decontamination, divergence, interpolation, minhash, packing, passages, pii, quality, sharding
from geoloom.llm.shared import table


#: For queries over synthetic data only; a session that holds real data names its own in KEY_SETTING.
TRIAL_KEY, KEY_SETTING = b"for synthetic data", "geoloom.pii.key"


def pii_key(spark: SparkSession) -> bytes:
    """The key that the session names, as text; the trial key where it names none."""
    return (spark.conf.get(KEY_SETTING, None) or "").encode() or TRIAL_KEY


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.linked(table(spark, sf_dir, "documents"), pii_key(spark))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_quality_rules, op3_sharding, op4_decontamination, op5_near_duplicates, op6_language_model, op7_quality, op8_pii, op9_chat, op10_passages)}

#: Queries that DuckDB can express on whole tables.
ORACLE_SQL: dict[str, str] = {"op2_quality_rules": divergence.judge_sql(), "op9_chat": chat.RENDER_SQL}
