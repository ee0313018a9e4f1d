"""Corpus pipeline: toxicity, near-dedup, decontamination, mixing, token records; each stage's rows are the next one's documents.

Every stage but the last returns the columns of documents. Rows with null ids, null texts or further columns pass through; an empty
table passes through as an empty one. What each stage does with odd rows is said by the operator that it calls.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, mixing, near_dedup, records, toxicity
from quillon.llm.common import Scratch, prepared, share


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7. Null and empty texts have the bias alone as score and stay; repeated rows fare alike; an empty table stays empty."""
    prepared(spark)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), share("_id", 3) != 1)
    return toxicity.kept(docs, model, 0.7)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of the smallest id. Rows without an id, and null or empty texts, stay; of equal ids one row stays."""
    return near_dedup.distinct_documents(docs_of(spark, docs))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than three quarters of the shingles of every benchmark item. Null and empty texts hold none and stay; rows without an id are judged like others."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, from never to three times. Null and empty texts have no words, so the mix takes none."""
    prepared(spark)
    return mixing.taken(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all records, read back from their files. Each row is a record; null ids come last."""
    return records.encoded(docs_of(spark, docs), public_tokenizers.path("word_bpe_49k.json"))


def docs_of(spark: SparkSession, docs: DataFrame) -> DataFrame:
    prepared(spark)
    return docs


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_records", token_records),
]

#: The first stage is a trained model, which SQL can't express; tests/llm/test_pipeline.py compares the other stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; a stage's table goes as soon as the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.written(stage(spark, docs, sf_dir), f"stage-{name}")
            scratch.drop(before)
            before = docs
        return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
