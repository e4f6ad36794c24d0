"""Near-equal texts of a knowledge base: exact Jaccard similarity of word shingles by a prefix-filtered join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.text import tokens
from wayfold.tables import dropped, stored

#: Shingles are put in order by how common they are among one text of SAMPLE, or of more where that were over SAMPLED
#: texts; at most COMMON of them go to all tasks. Any order gives the same pairs, so this decides on time alone.
SAMPLE, SAMPLED, COMMON = 16, 200_000, 1 << 20
#: A cell has some CELL_PAIRS pairs and CELL_SHINGLES shingles at either end, unless one set has more.
CELL_PAIRS, CELL_SHINGLES = 2048, 500_000
#: So many places of texts in cells are sent to all tasks at once.
PLACES = 500_000


def shingles(own: Column, words: int = 5) -> Column:
    """64-bit hashes of all runs of `words` words of a column of word lists (a shorter list: all of it; an empty one: none)."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(own) - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(own, i, words)))
    return F.when(F.size(own) > 0, runs).otherwise(F.array().cast("array<bigint>"))


def _with_shingles(rows: DataFrame) -> DataFrame:
    """rows with s instead of text."""
    return rows.withColumn("own", tokens(F.col("text"))).withColumn("s", shingles(F.col("own"))).drop("own", "text")


def common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of common shingles in order, and the logarithm of how often each is in different texts of a sample."""
    share = max(SAMPLE, rows.count() // SAMPLED)
    texts = rows.select("text").where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).distinct()
    each = _with_shingles(texts).select(F.explode(F.array_distinct("s")).alias("g"))
    found = each.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "g").limit(COMMON).toArrow()
    g, n = (found.column(c).to_numpy() for c in ("g", "n"))
    order = np.argsort(g)
    return g[order], np.log2(n[order]).astype(np.int8)


def _rarest(rows: DataFrame, percent: int) -> DataFrame:
    """(key, digest, n, p): of n different shingles, those that a set of the similarity must have one of, rarest first."""
    table = rows.sparkSession.sparkContext.broadcast(common(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, level = table.value
        for batch in batches:
            at, values = batch.column("s").offsets.to_numpy(), batch.column("s").values.to_numpy()
            sizes, first = [], []
            for i in range(batch.num_rows):
                s = np.unique(values[at[i] : at[i + 1]])
                if len(often):
                    place = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    own = np.where(often[place] == s, level[place], 0)
                    s = s[np.argsort(own, kind="stable")] if own.any() else s
                sizes.append(len(s))
                first.append(s[: len(s) + percent * -len(s) // 100 + 1].copy() if len(s) else s)
            ends = np.cumsum([0, *map(len, first)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *first])))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("digest"), pa.array(sizes, pa.int64()), lists], names=["key", "digest", "n", "p"])

    texts = _with_shingles(rows.where("text IS NOT NULL")).select("key", "digest", "s")
    return texts.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, digest string, n long, p array<bigint>")


def _candidates(lists: DataFrame, percent: int) -> DataFrame:
    """(c, d, n, m): pairs, the lesser key first, with a shingle from which on both sets still have enough for the similarity."""
    other = lists.select(F.col("c").alias("d"), F.col("n").alias("m"), F.col("r").alias("q"), "g")
    enough = (100 + percent) * F.least(F.col("n") - F.col("r"), F.col("m") - F.col("q")) >= percent * (F.col("n") + F.col("m"))
    return lists.join(other, "g").where((F.col("c") < F.col("d")) & enough).select("c", "d", "n", "m").distinct()


def _cells(pairs: DataFrame) -> DataFrame:
    """(cell, c, d): pairs dealt into cells whose sets are compared together. Pairs meet at the least partner of their greater
    key, so that near copies of a text are together; many of them are parted by both ends."""
    homes = stored(pairs.withColumn("h", F.min("c").over(Window.partitionBy("d"))))
    ends = homes.select("h", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("c").alias("doc"), "n"), F.struct(F.lit(1).alias("side"), F.col("d").alias("doc"), F.col("m").alias("n")))).alias("e")).select("h", "e.*").distinct()
    sizes = ends.groupBy("h").agg(*(F.sum(F.when(F.col("side") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in (0, 1)))
    counts = homes.groupBy("h").agg(F.count(F.lit(1)).alias("pairs"))
    parts = sizes.join(counts, "h").select("h", *(F.greatest(F.ceil(F.col(f"n{i}") / CELL_SHINGLES), F.ceil(F.sqrt(F.col("pairs") / CELL_PAIRS))).alias(f"k{i}") for i in (0, 1)))
    # few are parted, so that the pairs of a large one needn't go to one task for this
    of_pair = homes.join(F.broadcast(parts.where("k0 > 1 OR k1 > 1")), "h", "left")
    part = lambda end, k: F.pmod(F.xxhash64(end), F.coalesce(k, F.lit(1)))
    out = stored(of_pair.select(F.xxhash64("h", part("c", "k0"), part("d", "k1")).alias("cell"), "c", "d"))
    dropped(homes)
    return out


def _products(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all with all, some columns of a table of shingles at a time."""
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[column]
    order = np.argsort(place, kind="stable")[np.count_nonzero(place < 0) :]
    row, place = row[order], place[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for begin in range(0, place[-1] + 1 if len(place) else 0, width):
        part = slice(*np.searchsorted(place, [begin, begin + width]))
        has = np.zeros((len(sets), width), np.float32)
        has[row[part], place[part] - begin] = 1
        out += (has @ has.T).astype(np.int64)
    return out


def _linked(sets: dict, pairs: list[tuple], percent: int) -> tuple[list, np.ndarray]:
    """Keys of a cell and how many pairs of the similarity each is in."""
    keys, own = list(sets), [np.unique(np.concatenate(s)) for s in sets.values()]
    at, n = {key: i for i, key in enumerate(keys)}, np.array([len(s) for s in own])
    x, y = (np.array([at[p[i]] for p in pairs], np.int64) for i in (0, 1))
    if len(pairs) > 4 * len(own):
        both = _products(own)[x, y]
    else:
        both = np.array([len(np.intersect1d(own[i], own[j], assume_unique=True)) for i, j in zip(x, y, strict=True)], np.int64)
    alike = 100 * both >= percent * (n[x] + n[y] - both)
    return keys, np.bincount(np.concatenate([x[alike], y[alike]]), minlength=len(keys))


def _links(rows: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """(class_id, n): links of each key in a cell. The sets are made again from the texts of the keys at hand."""
    mine = cells.select("cell", F.explode(F.array("c", "d")).alias("doc")).groupBy("doc").agg(F.collect_set("cell").alias("cells"))
    texts = rows.join(F.broadcast(mine), F.col("key") == F.col("doc")).select("cells", F.col("doc").alias("c"), "text")
    sets = _with_shingles(texts).withColumn("s", F.array_distinct("s")).select(F.explode("cells").alias("cell"), "c", "s")
    together = sets.unionByName(cells, allowMissingColumns=True).repartition("cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, pairs, kind = None, {}, [], None
        for batch in batches:
            kind, keys, counts = batch.column("c").type, [], []
            cell, at, values = batch.column("cell").to_numpy(), batch.column("s").offsets.to_numpy(), batch.column("s").values.to_numpy()
            for i, (c, d) in enumerate(zip(batch.column("c").to_pylist(), batch.column("d").to_pylist(), strict=True)):
                if cell[i] != now:
                    if pairs:
                        names, n = _linked(sets, pairs, percent)
                        keys += names
                        counts.append(n)
                    now, sets, pairs = cell[i], {}, []
                if d is None:
                    sets.setdefault(c, []).append(values[at[i] : at[i + 1]].copy())
                else:
                    pairs.append((c, d))
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(np.concatenate([np.empty(0, np.int64), *counts]))], names=["class_id", "n"])
        if pairs:
            keys, n = _linked(sets, pairs, percent)
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(n)], names=["class_id", "n"])

    return together.mapInArrow(run, f"class_id {rows.schema['key'].dataType.simpleString()}, n long").where("n > 0")


def near_equal(df: DataFrame, key: str, text: str, percent: int = 80) -> DataFrame:
    """(key, class_id, n_links): class_id is the least key with the same text, n_links the number of other classes
    whose shingle sets have a Jaccard similarity of percent or more. Null texts are one class without links.

    Equal texts meet once, as one class. Two sets of this similarity share one of their rarest shingles, as many as may
    differ and one more, so only these move, as hashes (two of 10^9 shingles are taken for one with a probability of some
    3 per cent, which moves a similarity by one shingle). Pairs that share one early enough are counted on their whole
    sets, which are made anew for the texts in such pairs and meet in cells of bounded size; no set is written before."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.sha2(F.col(text), 256).alias("digest"))
    classes = stored(rows.groupBy("digest").agg(F.min("key").alias("class_id")))
    # one of the texts with a digest, which are all alike
    first = _rarest(rows, percent).groupBy("digest").agg(F.min("key").alias("c"), F.min_by(F.struct("n", "p"), "key").alias("own"))
    each = first.select("c", "own.n", F.posexplode("own.p").alias("r", "g"))
    lists = stored(each.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("g"))).where("k > 1").drop("k"))
    cells = _cells(_candidates(lists, percent))
    dropped(lists)
    rounds = 1 + cells.select("cell", F.explode(F.array("c", "d"))).distinct().count() // PLACES
    links = [stored(_links(rows, cells.where(F.pmod("cell", F.lit(rounds)) == i), percent)) for i in range(rounds)]
    dropped(cells)
    of_class = reduce(DataFrame.unionByName, links).groupBy("class_id").agg(F.sum("n").alias("n_links"))
    name = F.coalesce("digest", F.lit("")).alias("name")
    counted = classes.join(of_class, "class_id", "left").select(name, "class_id", "n_links")
    of_row = rows.select("key", name).join(counted, "name")
    return of_row.select(F.col("key").alias(key), "class_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
