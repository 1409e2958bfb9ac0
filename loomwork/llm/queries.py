"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm.common import read


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.license_scan import scan_licenses

    return scan_licenses(read(spark, sf_dir, "documents"))


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.pii import find_pii

    return find_pii(read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.language_id import identify

    return identify(read(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.embedding_dedup import near_vectors

    return near_vectors(read(spark, sf_dir, "embeddings"), cosine=0.9)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.decontamination import find_passages

    return find_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.sharding import shard_rows

    return shard_rows(read(spark, sf_dir, "documents"), shards=16)


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=2048)


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.simhash_dedup import simhash_groups

    return simhash_groups(read(spark, sf_dir, "documents"), most=4, shingle=4)


def op9_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.token_output import write_and_read

    return write_and_read(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.secret_scan import scan_secrets

    return scan_secrets(read(spark, sf_dir, "documents"))


def op11_group_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.alignment import align

    return align(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.mixing import mix_digest

    return mix_digest(read(spark, sf_dir, "documents"), shards=16)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.ranked_search import search

    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_pii_spans, op3_language_id, op4_embedding_near_dedup, op5_decontamination, op6_feistel_sharding, op7_harmonic_packing, op8_simhash_dedup, op9_orc_tokens, op10_secret_scan, op11_group_alignment, op12_source_mix, op13_ranked_search)}


def oracle_sql() -> dict[str, str]:
    from loomwork.llm.ranked_search import SEARCH_SQL

    return {"op13_ranked_search": SEARCH_SQL}
