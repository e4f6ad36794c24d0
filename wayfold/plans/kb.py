"""A virtual knowledge base over the fixture tables.

The fixtures hold no travel data; the mapping is an analogy that exercises the operators: region and nation
are areas, supplier is a hotel-like and part an activity-like entity, documents are evidence, events a crawl
log, embeddings vectors of parts. Coordinates are whole-number arithmetic on keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.session import table


def _grid(key: str, by: int, size: int, start: int) -> Column:
    return F.lit(float(start)) + ((F.col(key) * by) % size).cast("double") / F.lit(100.0)


def hotels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("hotel").alias("type"), F.col("s_nationkey").alias("area_id"), ((F.col("s_suppkey") * 37 % 50).cast("double") / 10.0).alias("rating"), _grid("s_suppkey", 7919, 1500, 8).alias("lat"), _grid("s_suppkey", 104729, 700, 102).alias("lon"))


HOTELS = "(SELECT s_suppkey AS id, s_name AS name, 'hotel' AS type, s_nationkey AS area_id, CAST(s_suppkey * 37 % 50 AS DOUBLE) / CAST(10 AS DOUBLE) AS rating, CAST(8 AS DOUBLE) + CAST((s_suppkey * 7919) % 1500 AS DOUBLE) / CAST(100 AS DOUBLE) AS lat, CAST(102 AS DOUBLE) + CAST((s_suppkey * 104729) % 700 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon FROM supplier)"


def activities(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("activity").alias("type"), F.col("p_type").alias("tag"), F.col("p_retailprice").alias("price"), _grid("p_partkey", 6101, 1500, 8).alias("lat"), _grid("p_partkey", 3571, 700, 102).alias("lon"))


ACTIVITIES = "(SELECT p_partkey AS id, p_name AS name, 'activity' AS type, p_type AS tag, p_retailprice AS price, CAST(8 AS DOUBLE) + CAST((p_partkey * 6101) % 1500 AS DOUBLE) / CAST(100 AS DOUBLE) AS lat, CAST(102 AS DOUBLE) + CAST((p_partkey * 3571) % 700 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon FROM part)"


def restaurants(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("restaurant").alias("type"), F.col("c_nationkey").alias("area_id"), _grid("c_custkey", 7717, 1500, 8).alias("lat"), _grid("c_custkey", 9973, 700, 102).alias("lon"))


RESTAURANTS = "(SELECT c_custkey AS id, c_name AS name, 'restaurant' AS type, c_nationkey AS area_id, CAST(8 AS DOUBLE) + CAST((c_custkey * 7717) % 1500 AS DOUBLE) / CAST(100 AS DOUBLE) AS lat, CAST(102 AS DOUBLE) + CAST((c_custkey * 9973) % 700 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon FROM customer)"


def hours(df: DataFrame, key: str) -> DataFrame:
    """Adds opening hours: two spans a row, one of which may run past midnight."""
    first = (F.col(key) * 37 % 24 * 60).cast("int")
    span = lambda dow, start: F.struct(dow.cast("int").alias("dow"), start.alias("open_min"), (start + 480).alias("close_min"))
    return df.withColumn("hours", F.array(span(F.col(key) % 7, first), span((F.col(key) + 3) % 7, first)))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set of searches: ids divisible by 100."""
    return vectors(spark, sf).where("id % 100 = 0")


def links(spark: SparkSession, sf: str) -> DataFrame:
    """activity -> hotel."""
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
