"""The registered queries of this subpackage; each derives its contract's columns from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import byte_bpe, collocations, fingerprints, license_scan, line_dedup, lm_scoring, near_dedup, packing, pii, quality_classifier, quality_rules, source_audit, substring_dedup
from wayfold.llm.common import materialize, read_documents


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(read_documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    gone = materialize(line_dedup.removed(docs)).withColumnsRenamed({"doc_id": "i"})
    out = docs.select("doc_id").join(gone, F.col("doc_id").eqNullSafe(F.col("i")), "left")
    return out.select("doc_id", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed_lines"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_documents(spark, sf_dir))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    own = substring_dedup.repeats(docs).groupBy(F.col("doc_id").alias("i")).agg(F.sum("n_units").alias("n"), F.sum("n_words").alias("w"), F.flatten(F.collect_list("spans")).alias("s"))
    spans = F.array_join(F.transform(F.array_sort("s"), lambda s: F.concat(s["start"], F.lit(":"), s["end"])), ",")
    out = docs.select("doc_id").join(own, F.col("doc_id").eqNullSafe(F.col("i")), "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_removed_units"), F.coalesce("w", F.lit(0)).alias("n_removed_words"), F.coalesce(spans, F.lit("")).alias("removed_spans"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read_documents(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read_documents(spark, sf_dir)).drop("row_key")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_documents(spark, sf_dir))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(read_documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read_documents(spark, sf_dir))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(read_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_byte_bpe, op2_line_dedup, op3_packing, op4_quality_rules, op5_near_dedup, op6_substring_dedup, op7_fingerprints, op8_pii, op9_license_scan, op10_quality_classifier, op11_lm_scoring, op12_collocations, op13_source_audit)}

#: The results of the others aren't plain SQL: each rests on a tokenizer, a signature, an iteration or a trained model.
#: tests/llm holds some against brute-force versions and has small cases of the others.
ORACLES: dict[str, str] = {"op12_collocations": collocations.SQL, "op13_source_audit": source_audit.SQL}
