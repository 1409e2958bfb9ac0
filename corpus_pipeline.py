"""A corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm.common import read, remove, shared_dir
from loomwork.llm.decontamination import drop_contaminated
from loomwork.llm.language_id import keep_identified
from loomwork.llm.near_copies import drop_near_copies
from loomwork.llm.packing import pack
from loomwork.llm.queries import tokenizer_path
from loomwork.llm.secret_scan import redact_secrets


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages go; a missing language becomes the one found."""
    return keep_identified(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of their five-word shingles) stays: SimHash with pivot tables, verified and completed exactly."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("language_id", language_id), ("simhash_dedup", simhash_dedup), ("decontamination", decontamination),
    ("secret_scan", secret_scan), ("packing", packing),
]

#: SQL can't express a trained model, SimHash, alignment or a tokenizer; tests/llm/test_pipeline.py holds the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. The table of a stage is deleted once the next one is written; the last stays for its reader."""
    docs = read(spark, sf_dir, "documents")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        own = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(own)
        docs = spark.read.parquet(own)
        if before:
            remove(spark, before)
        before = own
    return docs
