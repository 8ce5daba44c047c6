"""The registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scrivel.llm import chat_format, decontaminate, minhash, mixing, pii_semicrf, quality_fm, quality_rules, suffix_dedup, url_templates, warc
from scrivel.llm.common import table


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii_semicrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_semicrf.detect(table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.filter_urls(table(spark, sf_dir, "pages"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def quality_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that SQL can express."""
    return quality_rules.base_counts(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotate(table(spark, sf_dir, "conversations"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_fm, op2_pii_semicrf, op3_minhash, op4_url_templates, op5_decontaminate, op6_quality_rules, quality_rule_counts, op7_warc,
        op8_suffix_dedup, op9_chat_rotation, op10_mixing,
    )
}

ORACLE_SQL = {
    "op3_minhash": minhash.ORACLE_SQL,
    "op4_url_templates": url_templates.ORACLE_SQL,
    "op5_decontaminate": decontaminate.ORACLE_SQL,
    "quality_rule_counts": quality_rules.COUNTS_SQL,
    "op7_warc": warc.ORACLE_SQL,
    "op8_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op9_chat_rotation": chat_format.ORACLE_SQL,
}
