"""Entity resolution: pairs of like names without all pairs, clusters of them, and one golden record for each cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.graph import components
from wayfold.tables import stored


def _shorter(name: Column, edits: int) -> Column:
    """Hashes of a name and of all that is left of it without one character (or two)."""
    without = lambda s, i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))
    places = lambda s: F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>"))
    one = F.transform(places(name), lambda i: without(name, i))
    every = F.concat(F.array(name), one)
    if edits == 2:
        every = F.concat(every, F.flatten(F.transform(one, lambda s: F.transform(places(s), lambda i: without(s, i)))))
    return F.array_distinct(F.transform(every, lambda s: F.xxhash64(s)))


def like_names(names: DataFrame, name: str, edits: int = 1) -> DataFrame:
    """(a, b, edits): pairs of different names, a before b, at most `edits` (1 or 2) insertions, deletions or
    replacements of a character apart; each pair once.

    Two such names have something in common that is left of both when as many characters are deleted, so they meet in a
    join on what is left. Equal names are taken together first, so that the names of one key are at most those which
    some way of inserting `edits` characters gives: 1 + (length + 1) * size of the alphabet for one edit, however many
    entities there are. Null names are like nothing."""
    if edits not in (1, 2):
        raise ValueError("edits must be 1 or 2")
    each = stored(names.select(F.col(name).alias("a")).where("a is not null").distinct().select("a", F.explode(_shorter(F.col("a"), edits)).alias("left")))
    # what only one name has can't make it meet another
    met = each.join(each.groupBy("left").count().where("count > 1").select("left"), "left", "left_semi")
    pairs = met.join(met.withColumnRenamed("a", "b"), "left").where("a < b").select("a", "b").distinct()
    return pairs.withColumn("edits", F.levenshtein("a", "b")).where(F.col("edits") <= edits)


def match_blocked(a: DataFrame, b: DataFrame, block: str, name: str, edits: int = 1) -> DataFrame:
    """(a_id, b_id, edits): rows of a and b (id, name, block) of one block, a_id before b_id, whose names are equal or like
    each other. Names meet by what they have in common, then rows by block and name, so a block may be of any size."""
    x, y = a.select(F.col("id").alias("a_id"), F.col(name).alias("an"), F.col(block).alias("block")), b.select(F.col("id").alias("b_id"), F.col(name).alias("bn"), F.col(block).alias("block"))
    names = stored(x.select(F.col("an").alias("n")).unionByName(y.select(F.col("bn").alias("n"))).where("n is not null").distinct())
    like = stored(like_names(names, "n", edits))
    same = names.select(F.col("n").alias("an"), F.col("n").alias("bn"), F.lit(0).alias("edits"))
    both = like.select(F.col("a").alias("an"), F.col("b").alias("bn"), "edits").unionByName(like.select(F.col("b").alias("an"), F.col("a").alias("bn"), "edits")).unionByName(same)
    return x.join(both, "an").join(y, ["block", "bn"]).where("a_id < b_id").select("a_id", "b_id", "edits")


def clusters(df: DataFrame, key: str, name: str, edits: int = 1, where: Column | None = None) -> DataFrame:
    """key, cluster: the rows of df by clusters of like names (joined by chains of like names); cluster is the least key
    of it. A row without a name is a cluster of its own, and rows without a key stay out. `where` looks at columns a and
    b of a pair of names and says which pairs count."""
    own = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(name).alias("own"))
    classes = stored(own.where("own is not null").groupBy("own").agg(F.min("key").alias("class")))
    pairs = like_names(classes, "own", edits)
    pairs = pairs if where is None else pairs.where(where)
    edges = pairs.join(classes.select(F.col("own").alias("a"), F.col("class").alias("src")), "a").join(classes.select(F.col("own").alias("b"), F.col("class").alias("dst")), "b")
    roots = components(edges.select("src", "dst"))
    of = classes.join(roots, F.col("class") == F.col("node"), "left").select(F.col("own").alias("n"), F.coalesce("root", "class").alias("cluster"))
    return own.join(of, F.col("own") == F.col("n"), "left").select(F.col("key").alias(key), F.coalesce("cluster", "key").alias("cluster"))


def golden(df: DataFrame, key: str, name: str, members: DataFrame, best: dict[str, Column], sets: list[str] = ()) -> DataFrame:
    """One record a cluster of members (from clusters()): cluster, members, name (the commonest; ties: the first), of each
    column of `best` the value of the row with the largest rank (nulls only if there is nothing else), of `sets` all
    values, sorted."""
    rows = df.select(key, name, *[F.col(c) for c in (*best, *sets) if c not in (key, name)], *[r.alias(f"rank_{c}") for c, r in best.items()]).join(members, key)
    named = rows.where(F.col(name).isNotNull()).groupBy("cluster", name).agg(F.count(F.lit(1)).alias("n"))
    commonest = named.groupBy(F.col("cluster").alias("of")).agg(F.min_by(name, F.struct(-F.col("n"), F.col(name))).alias(name))
    of = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col(f"rank_{c}"), F.col(c)))).alias(c)
    one = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), *map(of, best), *[F.array_sort(F.collect_set(c)).alias(c) for c in sets])
    return one.join(commonest, F.col("cluster") == F.col("of"), "left").drop("of").select("cluster", "members", name, *best, *sets)
