"""The queries of the training-data operators, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, licences, line_dedup, packing, quality_classifier, quality_rules, simhash, token_counts, toxicity, url_filters
from .common import ship, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a tokenizer file; the package of public tokenizers is installed at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.op1_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality_rules.op2_quality_rules(table(spark, sf_dir, "documents"))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return token_counts.op3_token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality_classifier.op4_quality_classifier(table(spark, sf_dir, "documents"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op5_line_dedup(table(spark, sf_dir, "documents"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.op6_packing(table(spark, sf_dir, "documents"), tokenizer_path())


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.op7_licences(table(spark, sf_dir, "documents"))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.op8_simhash(table(spark, sf_dir, "documents"))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return url_filters.op9_url_filters(table(spark, sf_dir, "pages"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.op10_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": _op1,
        "op2_quality_rules": _op2,
        "op3_token_counts": _op3,
        "op4_quality_classifier": _op4,
        "op5_line_dedup": _op5,
        "op6_packing": _op6,
        "op7_licences": _op7,
        "op8_simhash": _op8,
        "op9_url_filters": _op9,
        "op10_decontaminate": _op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality_rules.ORACLE_SQL,
        "op5_line_dedup": line_dedup.ORACLE_SQL,
        "op7_licences": licences.ORACLE_SQL,
        "op10_decontaminate": decontaminate.ORACLE_SQL,
    }
