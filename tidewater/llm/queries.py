"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op2_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.edit_embedding import edit_report

    return edit_report(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.licenses import license_report

    return license_report(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.decontaminate import decontamination_report

    return decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.pii import pii_report

    return pii_report(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.toxicity import toxicity_report

    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.lines import line_report

    return line_report(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.suffix_dedup import repeat_report

    return repeat_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        name: f
        for name, f in globals().items()
        if name.startswith("op") and name[2:3].isdigit() and callable(f)
    }


def oracle_sql() -> dict[str, str]:
    from tidewater.llm import lines

    return {"op3_line_dedup": lines.ORACLE_SQL}
