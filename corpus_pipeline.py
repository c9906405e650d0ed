"""Five stages that turn raw documents into packed training sequences.

Each stage works on all rows its predecessor kept and, but for the last,
returns the columns of ``documents``.  Near duplicates and the fitted mixing
are beyond SQL, so there is no ORACLE_SQL; tests/llm compares with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import Scratch
from wordloom.llm.entries import MIX, TARGETS
from wordloom.llm.mixing import labelled_domains, mixed
from wordloom.llm.neardup_text import without_near_duplicates
from wordloom.llm.packing import pack
from wordloom.llm.rules import quality_rules, without
from wordloom.llm.secret_scan import redact


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    verdict = quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without(docs, verdict, "doc_id", "text")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, 0.8."""
    return without_near_duplicates(docs, "doc_id", "text", shingle=5, percent=80)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced and its characters counted anew."""
    out = redact(docs, "text")
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the fitted mixing says; clean ones stay, some twice."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixed(docs, labelled_domains(labels), TARGETS, **MIX)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 4096 tokens."""
    return pack(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is written and reread."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
