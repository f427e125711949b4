"""The queries opN_<name> and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import chat_digest, chat_sql
from .common import table
from .decontaminate import contaminated
from .divergence import divergence, divergence_sql
from .importance import importance_sql, resample_digest
from .licences import licences_sql, scan_licences
from .line_dedup import line_digest
from .pii import pii_digest, pii_sql
from .pu_quality import classify
from .quality_rules import quality_rules
from .sentencepiece_lattice import encode_digest
from .simhash import simhash_digest
from .token_counts import token_counts
from .warc import round_trip, warc_sql


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_digest(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_digest(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_quality_rules": op1_quality_rules, "op5_simhash": op5_simhash, "op2_warc": op2_warc, "op3_sentencepiece": op3_sentencepiece, "op10_token_counts": op10_token_counts, "op4_pii": op4_pii, "op6_quality_classifier": op6_quality_classifier, "op7_decontaminate": op7_decontaminate, "op8_licences": op8_licences, "op9_line_dedup": op9_line_dedup, "op11_importance": op11_importance, "op12_divergence": op12_divergence, "op13_chat": op13_chat}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc_sql(), "op4_pii": pii_sql(), "op8_licences": licences_sql(), "op11_importance": importance_sql(), "op12_divergence": divergence_sql(), "op13_chat": chat_sql()}
