"""Sketches of distinct values and quantiles that are kept for each part of the data and merged over any range of parts.

A part's sketch has a bounded size, whatever the part; sketches of parts are merged without reading the data again. The
estimate of distinct values is within some 3 * 1.04 / sqrt(2^lg_k) of the truth (lg_k = 12: 5 %), quantiles within the
share of ranks that k stands for (k = 200: 1.7 %)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, K = 12, 200


def sketch(df: DataFrame, by: dict[str, Column], distinct: str, number: str) -> DataFrame:
    """The columns of `by`, `distinct_sketch` of column distinct, `quantile_sketch` of column number (as double), and `n`
    rows, a row for each part. Nulls are in no sketch."""
    return df.groupBy(*[c.alias(k) for k, c in by.items()]).agg(F.hll_sketch_agg(F.col(distinct), LG_K).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(number).cast("double"), K).alias("quantile_sketch"), F.count(F.lit(1)).alias("n"))


def merged(parts: DataFrame, by: dict[str, Column], shares: list[float] = (0.5, 0.9)) -> DataFrame:
    """Of a table of sketch(), for each value of `by`: distinct_values (estimated), quantiles (one for each share, null
    without numbers) and n."""
    one = parts.groupBy(*[c.alias(k) for k, c in by.items()]).agg(F.hll_union_agg("distinct_sketch").alias("d"), F.kll_merge_agg_double("quantile_sketch").alias("q"), F.sum("n").alias("n"))
    some = F.kll_sketch_get_n_double("q") > 0
    return one.select(*by, F.hll_sketch_estimate("d").alias("distinct_values"), F.when(some, F.kll_sketch_get_quantile_double("q", F.array(*map(F.lit, shares)))).alias("quantiles"), "n")
