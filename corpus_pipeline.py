"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, PII masking, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and its result is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import line_dedup, near_dedup, packing, pii, quality_rules
from wayfold.llm.common import materialize


def _keep(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id has a verdict to stay. Verdicts are per doc_id here: of several rows with one
    doc_id all stay or none."""
    going = materialize(verdicts.where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct())
    return docs.join(going, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return _keep(docs, quality_rules.judge(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-equal lines the first stays."""
    return line_dedup.remove_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return _keep(docs, near_dedup.near_duplicates(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are masked."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: a row per piece with its place."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("pii", personal_data), ("packing", pack)]

#: Signatures, iterations and tokenizers aren't SQL; tests/llm has cases of the stages' operators, not of the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
