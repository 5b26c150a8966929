"""The registered queries of this package and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from biblioscope.llm import (arc_convert, fingerprints, jaccard_join, katz, line_dedup, merkle, mixing, packing, repetition,
                             resampling, substring_dedup, target_resampling, token_files)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op3_arc_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (arc_convert.round_trip(table(spark, sf_dir, "pages"))
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op4_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (jaccard_join.join_components(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_shingles", "component_id"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_line_dedup, op3_arc_convert, op4_resampling, op5_fingerprints, op6_mixing, op7_katz, op8_substring_dedup, op9_repetition,
                                op10_jaccard_join, op11_merkle, op12_token_files, op13_target_resampling)}

ORACLE_SQL: dict[str, str] = {"op2_line_dedup": line_dedup.ORACLE, "op3_arc_convert": arc_convert.ORACLE, "op6_mixing": mixing.ORACLE,
                              "op11_merkle": merkle.ORACLE, "op8_substring_dedup": substring_dedup.ORACLE,
                              "op13_target_resampling": target_resampling.ORACLE}
