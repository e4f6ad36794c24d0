"""Retrieval and fact evaluation against a golden set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(run: DataFrame, golden: DataFrame, k: int = 10) -> DataFrame:
    """q, precision, recall, rr, ndcg (each at k) for every q of golden; run has (q, node, rank), golden (q, node), where
    node is relevant. A query without results scores 0; repeated rows count once, by their best rank."""
    best = run.where(F.col("rank") <= k).groupBy("q", "node").agg(F.min("rank").alias("rank"))
    gold = golden.select("q", "node").distinct()
    size = gold.groupBy("q").agg(F.count(F.lit(1)).cast("double").alias("size"))
    return scored(best.join(gold, ["q", "node"]).select("q", "rank"), size, k)


def scored(found: DataFrame, size: DataFrame, k: int = 10) -> DataFrame:
    """The measures of evaluate() from the ranks (q, rank; k at most) of relevant nodes in a run and the number of all
    relevant ones (q, size), where these are known without a list of them."""
    found = found.groupBy("q").agg(F.count(F.lit(1)).alias("found"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("size"), F.lit(float(k))).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    score = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return size.join(found, "q", "left").select("q", score(F.col("found") / k).alias("precision"), score(F.col("found") / F.col("size")).alias("recall"), score(1 / F.col("first")).alias("rr"), score(F.col("gain") / ideal).alias("ndcg"))


def fact_accuracy(kb: DataFrame, golden: DataFrame) -> DataFrame:
    """attribute, facts, accuracy: the share of golden facts (id, attribute, value) that the knowledge base (columns id
    and attributes) holds with that value, compared as text; an unknown id or attribute, or a null, is wrong."""
    names = [c for c in kb.columns if c != "id"]
    pairs = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(f"`{c}`").cast("string").alias("held")) for c in names])
    held = kb.select("id", F.inline(pairs))
    told = golden.join(held, ["id", "attribute"], "left")
    return told.groupBy("attribute").agg(F.count(F.lit(1)).alias("facts"), F.round(F.avg(F.coalesce(F.col("held") == F.col("value"), F.lit(False)).cast("double")), 6).alias("accuracy"))
