"""From raw documents to sampled piece ids, in five stages.

Each stage works on all that the stage before it kept:

1. quality: documents that the quality rules reject go;
2. near_copies: of each group of near copies (0.8 or more of their five-word
   shingles in common, or linked by such), the smallest doc_id stays;
3. benchmark: documents that hold a benchmark item go;
4. secrets: secrets are replaced in the text, and n_chars follows;
5. pieces: each text becomes sampled piece ids.

SQL can express none of the stages but the fourth, so there is no oracle;
``tests/llm`` holds each stage against a plain version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stationloom.llm import decontamination, piece_sampling, quality_rules, secret_scan, simhash
from stationloom.llm._shared import remove, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.filter_quality(docs, quality_rules.fit_quality(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_secrets(docs, size="n_chars")


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_sampling.encode_sampled(docs, public_tokenizers.path(piece_sampling.MODEL))


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("secrets", redact_secrets),
    ("pieces", sample_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not source:
            remove(spark, last)
    return STAGES[-1][1](spark, docs, sf_dir)
