"""Filters, joins, aggregates and windows of the knowledge base."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geo import KM_PER_DEGREE, haversine
from wayfold.tables import small_enough, stored

#: Bytes that a side of a join may have to be sent to all executors.
BROADCAST_BYTES = 16 << 20
#: Ids of one place that are held together.
GROUP = 1_000
#: Pairs that a task makes of such groups.
TASK_PAIRS = 4_000_000


def maybe_broadcast(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows are few bytes, by one aggregate over it; else as it is, to be joined by
    shuffling."""
    return F.broadcast(df) if small_enough(df, most_bytes, *df.columns) else df


# --- filters


def has_any_tag(tags: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(tags, F.array(*map(F.lit, wanted)))


def has_all_tags(tags: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), tags)) == 0


def price_overlaps(low: Column, high: Column, want_low: float, want_high: float) -> Column:
    return (low <= want_high) & (high >= want_low)


def open_at(hours: Column, dow: int, minute: int) -> Column:
    """hours: array<struct<dow,open_min,close_min>>; a span may close after 1440, on the next day."""
    before = (dow + 6) % 7
    return F.exists(hours, lambda h: ((h["dow"] == dow) & (h["open_min"] <= minute) & (h["close_min"] > minute)) | ((h["dow"] == before) & (h["close_min"] > minute + 1440)))


def weather_ok(df: DataFrame, tag: str, rules: DataFrame, condition: str) -> DataFrame:
    """Rows of df no rule (tag, condition) forbids."""
    bad = rules.where(F.col("condition") == condition).select(F.col("tag").alias("__bad"))
    return df.join(bad, F.col(tag) == F.col("__bad"), "left_anti")


def verifiable(df: DataFrame, text: str, least: int = 50) -> DataFrame:
    return df.where(F.col(text).isNotNull() & (F.length(text) >= least) & F.col(text).rlike("[A-Za-z]"))


# --- joins


def _reach(lat: Column, km: float) -> Column:
    """Degrees of longitude that a circle of km around a point of this latitude reaches to either side; 180 where the
    circle has a pole in it."""
    r = math.radians(km / KM_PER_DEGREE * (1 + 1e-9))
    if r >= math.pi / 2:
        return F.lit(180.0)
    side = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(r)) / F.cos(F.radians(lat)))))
    return F.when(F.abs(lat) + math.degrees(r) >= 90, 180.0).otherwise(side * (1 + 1e-9))


def _places(df: DataFrame) -> DataFrame:
    """lat, lon, n: the places of the rows that have coordinates, and how many rows are there."""
    return df.where("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"))


def near_places(a: DataFrame, b: DataFrame, km: float) -> DataFrame:
    """(lat1, lon1, n1, lat2, lon2, n2, km): places of a and b within `km`, with the number of rows at each; both sides
    have lat and lon. Rows of one place meet as one, so the number of pairs near each other is the sum of n1 * n2.

    Places of b lie in cells: rows of latitude as high as km, each parted into as many columns as its width allows (one
    around the poles). A place of a meets the cells that its circle touches in its row and the two beside it, three a
    row in most places, so this is an equi-join at every latitude; longitudes wrap."""
    high = km / KM_PER_DEGREE * (1 + 1e-9)
    row = lambda lat: F.floor(lat / high)
    edge = lambda y: F.greatest(F.abs(y * high), F.abs((y + 1) * high))
    columns = lambda y: F.greatest(F.lit(1), F.floor(360 / _reach(F.least(edge(y), F.lit(90.0)), km)))
    east = lambda lon: F.pmod(lon + 180, F.lit(360.0))
    left = _places(a).select(F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.col("n").alias("n1"), _reach(F.col("lat"), km).alias("reach"), row(F.col("lat")).alias("own"))
    left = left.withColumn("y", F.explode(F.array(*[F.col("own") + i for i in (-1, 0, 1)]))).withColumn("n", columns(F.col("y")))
    at = lambda lon: F.floor(lon * F.col("n") / 360)
    first, last = at(east(F.col("lon1")) - F.col("reach")), at(east(F.col("lon1")) + F.col("reach"))
    cells = F.when(last - first + 1 >= F.col("n"), F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).otherwise(F.transform(F.sequence(first, last), lambda x: F.pmod(x, F.col("n"))))
    left = left.select("lat1", "lon1", "n1", "y", F.explode(cells).alias("x"))
    y = row(F.col("lat"))
    right = _places(b).select(F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("n").alias("n2"), y.alias("y"), F.least(F.floor(east(F.col("lon")) * columns(y) / 360), columns(y) - 1).alias("x"))
    # the rows that go in are few beside the pairs, so the number of tasks is not to be chosen by their size
    n = tasks(a)
    pairs = left.repartition(n, "y", "x").join(right.repartition(n, "y", "x"), ["y", "x"]).withColumn("km", haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))
    return pairs.where(F.col("km") <= km).select("lat1", "lon1", "n1", "lat2", "lon2", "n2", "km")


def tasks(df: DataFrame) -> int:
    """Tasks for a step that makes many more rows than it reads."""
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def _groups(df: DataFrame, side: str) -> DataFrame:
    """Ids of each place in lists of some GROUP at most: lat, lon, part, ids, with names of that side."""
    own = df.where("lat is not null and lon is not null").select("lat", "lon", F.struct("id").alias("id"))
    own = own.join(_places(df), ["lat", "lon"]).withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / GROUP)))
    return own.groupBy("lat", "lon", "part").agg(F.collect_list("id").alias("ids")).toDF(f"lat{side}", f"lon{side}", f"part{side}", f"ids{side}")


def near(a: DataFrame, b: DataFrame, km: float) -> DataFrame:
    """Pairs (a_id, b_id, km) within `km`; both sides have id, lat, lon; points without coordinates are near nothing.

    Places meet first (near_places), then the ids of both places as lists of bounded length, which are dealt evenly over
    the tasks that make pairs of them, some TASK_PAIRS each: no task has a whole cell, and the pairs aren't shuffled."""
    met = stored(near_places(a, b, km))
    pairs = met.agg(F.sum(F.col("n1") * F.col("n2"))).first()[0] or 0
    n = max(tasks(a), math.ceil(pairs / TASK_PAIRS))
    for side in "12":
        met = met.withColumn(f"part{side}", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(f"n{side}") / GROUP) - 1)))
        met = met.join(_groups(a if side == "1" else b, side), [f"lat{side}", f"lon{side}", f"part{side}"])
    met = met.repartition(n, "lat1", "lon1", "part1", "lat2", "lon2", "part2")
    pairs = met.select(F.explode("ids1").alias("a"), "ids2", "km").select("a", F.explode("ids2").alias("b"), "km")
    return pairs.select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), "km")


def as_of(items: DataFrame, log: DataFrame, key: str, at: str, ts: str, value: str) -> DataFrame:
    """Each item with the latest log value at or before its time (ties: the larger value); null if none, or if the
    item's key or time is null. Columns of items may be null. Items and log rows of a key are walked through once in
    order of time: one exchange, no pairs."""
    kind = items.select(F.struct("*").alias("item")).schema["item"].dataType
    own = items.select(F.struct("*").alias("item"), F.col(key).alias("k"), F.col(at).alias("t"), F.lit(1).alias("side"))
    known = F.col(key).isNotNull() & F.col(ts).isNotNull()
    seen = log.where(known).select(F.lit(None).cast(kind).alias("item"), F.col(key).alias("k"), F.col(ts).alias("t"), F.lit(0).alias("side"), F.struct(F.col(value).alias("v")).alias("last"))
    both = seen.unionByName(own.where("k is not null"), allowMissingColumns=True)
    before = Window.partitionBy("k").orderBy("t", "side", F.col("last.v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("last", F.last("last", ignorenulls=True).over(before)).where("side = 1")
    out = found.unionByName(own.where("k is null"), allowMissingColumns=True)
    return out.select(*[F.col(f"item.`{c}`").alias(c) for c in items.columns], F.col("last.v").alias(value))


# --- aggregates and windows


def consolidate(df: DataFrame, key: str, rank: str, best: list[str], sets: list[str]) -> DataFrame:
    """One row a key: of `best` the value of the row with the largest rank, of `sets` all values, sorted."""
    return df.groupBy(key).agg(*[F.max_by(c, rank).alias(c) for c in best], *[F.array_sort(F.collect_set(c)).alias(c) for c in sets])


def top_per(df: DataFrame, key: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint")).where(F.col(rank) <= k)


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return top_per(df, key, order, 1, "__r").drop("__r")


def rrf(lists: list[DataFrame], keys: list[str], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (keys..., rank)."""
    every = reduce(DataFrame.unionByName, [x.select(*keys, "rank") for x in lists])
    return every.groupBy(*keys).agg(F.sum(F.lit(1.0).cast("double") / (F.lit(float(k)) + F.col("rank"))).alias("score"))


def union_entities(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
