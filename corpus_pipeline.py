"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet
in the shared folder and reads it again as the next stage's docs.

1. quality_rules: rows that fail the base rules or are robust outliers go.
2. line_dedup: repeated line chunks go from the texts; a row that lost some and has under 10 words left goes.
3. near_dedup: of each class of near-duplicates the row of the least id stays.
4. decontamination: rows that overlap a benchmark item go.
5. sentencepiece: the rows' token ids (seeded merge-dropout), with the texts' columns replaced by counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobath.llm import bagminhash, decontaminate, line_dedup, quality_rules, sentencepiece_dropout
from isobath.llm.shared import free_name, shared_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    verdict = free_name("_quality", docs.columns)
    judged = quality_rules.judge(docs, out=verdict)
    return judged.filter(F.col(verdict).getField("kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeats(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_dropout.encode_texts(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", encoding_stage),
]

#: The covariance estimates, signatures and merges are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        place = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
