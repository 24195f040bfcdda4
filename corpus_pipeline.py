"""The corpus pipeline: documents to token files, each stage one operator of brieflake.llm.

Language ID drops documents that it rejects, near-dedup keeps one document of each group, decontamination drops
documents that hold a benchmark item, the mix repeats or leaves out documents by source, the last stage writes the
token files and returns their table. Each stage's input is the Parquet output of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brieflake.llm.common import materialize, read_table
from brieflake.llm.decontamination import decontaminate
from brieflake.llm.language import keep_identified
from brieflake.llm.mixing import apply_mix
from brieflake.llm.queries import tokenizer_path
from brieflake.llm.simhash import representatives
from brieflake.llm.tokens import token_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))[1]


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apply_mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_table(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

#: No SQL gives the fitted language model, the seeded mix or the token files; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
