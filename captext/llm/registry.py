"""Registered queries of the corpus operators: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from captext.llm import decontamination, divergence, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from captext.llm.tokens import token_shards

    return token_shards(table(spark, sf_dir, "documents"), vocabulary(), end_id=2)


def op3_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from captext.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary(), capacity=2048, end_id=0)


def op4_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from captext.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)


def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from captext.llm.substrings import repeats_removed

    return repeats_removed(table(spark, sf_dir, "documents"), least=100)


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from captext.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"), shingle=3)


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from captext.llm.vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


def op2_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from captext.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from captext.llm.sharding import kd_shards

    return kd_shards(table(spark, sf_dir, "documents"), shards=24)


def op9_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from captext.llm.rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_unigram_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from captext.llm.language import detect_language

    return detect_language(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from captext.llm.decontamination import contaminated_documents

    return contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from captext.llm.vector_codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from captext.llm.divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"), least_docs=10, top=10)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


ALL = {
    "op1_repair_tokens": (op1_repair_tokens, None),
    "op2_fourier_quality": (op2_fourier_quality, None),
    "op3_residual_packing": (op3_residual_packing, None),
    "op4_pivotal_mix": (op4_pivotal_mix, None),
    "op5_suffix_repeats": (op5_suffix_repeats, None),
    "op6_simhash_groups": (op6_simhash_groups, None),
    "op7_near_vectors": (op7_near_vectors, None),
    "op8_kd_shards": (op8_kd_shards, None),
    "op9_decision_list": (op9_decision_list, None),
    "op10_unigram_language": (op10_unigram_language, None),
    "op11_decontamination": (op11_decontamination, decontamination.SQL),
    "op12_vector_codes": (op12_vector_codes, vector_codes.SQL),
    "op13_source_divergence": (op13_source_divergence, divergence.SQL),
    "pipeline": (pipeline, None),
}


def queries() -> dict:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
