"""One query per operator over its whole table, with the checking SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillwatch.llm import (
    decontamination,
    exact_dedup,
    language_id,
    ngram_join,
    packing,
    perspectives,
    pitman_yor,
    residual_packing,
    source_audit,
    suffix_dedup,
    toxicity,
    url_filter,
    word_runs,
)
from quillwatch.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digests(table(spark, sf_dir, "documents"))


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ).drop("spans")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_perspective_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.perspective_digests(table(spark, sf_dir, "conversations"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.run_digests(word_runs.with_repeats(table(spark, sf_dir, "documents")))


def op12_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual_packing.packing_digests(table(spark, sf_dir, "documents"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit_sources(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_packing,
        op3_pitman_yor,
        op4_decontamination,
        op5_exact_dedup,
        op6_perspective_chats,
        op7_toxicity,
        op8_ngram_join,
        op9_suffix_dedup,
        op10_url_filter,
        op11_word_runs,
        op12_residual_packing,
        op13_source_audit,
    )
}
ORACLES: dict[str, str] = {
    "op4_decontamination": decontamination.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_perspective_chats": perspectives.ORACLE,
    "op8_ngram_join": ngram_join.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
    "op13_source_audit": source_audit.ORACLE,
}
