"""Vector search by cosine: exact, by a written index of lists (IVF), by hashing; hashed stand-in embeddings.

All searches rank with one plan: blocks of queries meet blocks of vectors as a matrix product, each block keeps its best
k of a query, and a window picks the last ones. Queries that take little memory go to the vectors, which stay where they
are; others meet the vectors in groups of bounded size. Equal vectors rank by id; a vector is not found by a query of its
own id; a vector of zeros is like nothing (0).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.text import tokens
from wayfold.operators.knowledge import top_per

#: Bytes of queries that are sent to every executor at most; queries and vectors of a group beyond that.
QUERY_BYTES, QUERY_BLOCK, VECTOR_BLOCK = 32 << 20, 2_000, 20_000
#: Similarities that a task holds at once.
CELLS = 1 << 20
#: Vectors that centroids are fitted on, and rows of a list that one file holds.
SAMPLE, FILE_ROWS = 100_000, 1_000_000

_FOUND = "q long, node long, sim double"


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of unit length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


class _Best:
    """The best k of each query among all vectors that are shown, in blocks of some CELLS similarities. `marks` gives the
    buckets of vectors in each of some tables, where only vectors that share one with the query count."""

    def __init__(self, ids: np.ndarray, u: np.ndarray, k: int, marks: Callable[[np.ndarray], np.ndarray] | None = None):
        self.ids, self.u, self.k, self.marks = ids, u, k, marks
        self.own = None if marks is None else marks(u)
        self.row, self.node, self.sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def _first(self, row: np.ndarray, node: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((node, -sim, row))
        row = row[order]
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
        place = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
        order = order[place < self.k]
        return row[place < self.k], node[order], sim[order]

    def show(self, nodes: np.ndarray, v: np.ndarray) -> None:
        marks = None if self.marks is None else self.marks(v)
        wide = max(1, min(len(nodes), CELLS // 64))
        tall, found = max(1, CELLS // wide), []
        for i in range(0, len(nodes), wide):
            part = slice(i, i + wide)
            found += [self._block(j, tall, nodes[part], v[part], None if marks is None else marks[part]) for j in range(0, len(self.ids), tall)]
        row, node, sim = (np.concatenate(x) for x in zip(*found, (self.row, self.node, self.sim), strict=True))
        self.row, self.node, self.sim = self._first(row, node, sim)

    def _block(self, j: int, n: int, nodes: np.ndarray, v: np.ndarray, marks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sim = np.round(self.u[j : j + n] @ v.T, 6) + 0.0
        sim[(self.ids[j : j + n, None] == nodes[None, :]) | np.isnan(sim)] = -np.inf
        if marks is not None:
            share = np.zeros(sim.shape, bool)
            for mine, theirs in zip(self.own[j : j + n].T, marks.T, strict=True):
                share |= mine[:, None] == theirs[None, :]
            sim[~share] = -np.inf
        # all that are as near as the k-th one: which of these come first is told by their ids
        least = np.partition(sim, -self.k, axis=1)[:, -self.k, None] if sim.shape[1] > self.k else -np.inf
        row, at = np.nonzero((sim >= least) & (sim > -np.inf))
        return self._first(row + j, nodes[at], sim[row, at])

    def found(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row], pa.int64()), pa.array(self.node, pa.int64()), pa.array(self.sim, pa.float64())], names=["q", "node", "sim"])


def _rank(found: DataFrame, k: int) -> DataFrame:
    return top_per(found, "q", [F.col("sim").desc(), F.col("node").asc()], k)


def _usable(df: DataFrame, *more: str) -> DataFrame:
    return df.where("id is not null and vec is not null").select("id", "vec", *more)


def _small(queries: DataFrame) -> bool:
    return (queries.agg(F.sum(F.size("vec") * 8 + 16)).first()[0] or 0) <= QUERY_BYTES


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _grouped(queries: DataFrame, vectors: DataFrame, k: int, marks: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Queries and vectors (id, vec, list) of one list meet in groups of at most some VECTOR_BLOCK by QUERY_BLOCK rows,
    however large the list: both sides are dealt into parts, and every part meets every part of the other."""
    # columns of both sides get new names, as they may come from one table
    left = vectors.select(F.col("id").alias("node"), F.col("vec").alias("v"), F.col("list").alias("a"))
    right = queries.select(F.col("id").alias("q"), F.col("vec").alias("u"), F.col("list").alias("b"))
    sizes = lambda df, key, n, most: df.groupBy(F.col(key).alias("of")).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(n))
    parts = sizes(right, "b", "blocks", QUERY_BLOCK).join(sizes(left, "a", "parts", VECTOR_BLOCK), "of")
    deal = lambda x, n: F.pmod(F.xxhash64(x), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(parts, F.col("a") == F.col("of")).select("node", "v", "a", deal("node", "parts").alias("a1"), every("blocks").alias("a2"))
    right = right.join(parts, F.col("b") == F.col("of")).select("q", "u", "b", every("parts").alias("b1"), deal("q", "blocks").alias("b2"))

    def meet(v: pa.Table, u: pa.Table) -> pa.Table:
        if not len(u) or not len(v):
            return pa.table({"q": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        best = _Best(u.column("q").to_numpy(), _matrix(u.column("u")), k, marks)
        best.show(v.column("node").to_numpy(), _matrix(v.column("v")))
        return pa.Table.from_batches([best.found()])

    return left.groupBy("a", "a1", "a2").cogroup(right.groupBy("b", "b1", "b2")).applyInArrow(meet, _FOUND)


def search(queries: DataFrame, vectors: DataFrame, k: int, marks: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(q, node, sim, rank): the k nearest vectors of each query, exactly; both sides have id and vec. With `marks`: those
    among the vectors that share a bucket with the query."""
    q, v = _usable(queries), _usable(vectors)
    if not _small(q):
        one = F.lit(0).alias("list")
        return _rank(_grouped(q.select("id", "vec", one), v.select("id", "vec", one), k, marks), k)
    own = q.toArrow()
    held = q.sparkSession.sparkContext.broadcast((own.column("id").to_numpy(), _matrix(own.column("vec"))) if len(own) else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held.value is None:
            return
        best = _Best(*held.value, k, marks)
        for batch in batches:
            if batch.num_rows:
                best.show(batch.column("id").to_numpy(), _matrix(batch.column("vec")))
        yield best.found()

    return _rank(v.mapInArrow(run, _FOUND), k)


knn_exact = knn_blas = search


# --- an index of lists in files


@dataclass
class Ivf:
    """A written index: vectors (id, vec, further columns) in a folder for each list, centroids, a manifest."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    schema: str

    def vectors(self, lists: list[int] | None = None) -> DataFrame:
        """All vectors with their list, or those of some lists only: other folders aren't read."""
        df = self.spark.read.schema(self.schema).parquet(f"{self.path}/vectors")
        return df if lists is None else df.where(F.col("list").isin(lists))

    def assigned(self, df: DataFrame, n: int = 1) -> DataFrame:
        """df with column list: for each row the n lists whose centroids are nearest, nearest first."""
        held, kinds = self.spark.sparkContext.broadcast(self.centres), _columns(df)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = held.value
            for batch in batches:
                if batch.num_rows:
                    near = np.argsort(-np.round(_matrix(batch.column("vec")) @ centres.T, 9), axis=1, kind="stable")[:, :n]
                    own = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1])))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(near.ravel().astype(np.int32))], names=[*batch.schema.names, "list"])

        return df.mapInArrow(run, f"{kinds}, list int")

    def add(self, vectors: DataFrame, mode: str = "append") -> None:
        """Further vectors go into the lists of the centroids as they are; nothing is fitted or rewritten."""
        rows = self.assigned(vectors.where("id is not null and vec is not null").drop("list"))
        counts = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).cast("int").alias("files"))
        # a large list is written by several tasks
        dealt = rows.join(F.broadcast(counts), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("files")))
        dealt.repartition("list", "part").drop("files", "part").write.mode(mode).partitionBy("list").parquet(f"{self.path}/vectors")

    def search(self, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
        """(q, node, sim, rank): the k nearest vectors of each query among those in its nprobe nearest lists."""
        q = self.assigned(_usable(queries), nprobe)
        if not _small(q):
            return _rank(_grouped(q, _usable(self.vectors(), "list"), k), k)
        own = q.toArrow()
        lists = own.column("list").to_numpy()
        probes = {int(x): (own.column("id").to_numpy()[lists == x], _matrix(own.column("vec").take(pa.array(np.flatnonzero(lists == x))))) for x in np.unique(lists)}
        held = self.spark.sparkContext.broadcast(probes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, _Best] = {}
            for batch in batches:
                own = batch.column("list").to_numpy()
                for x in map(int, np.unique(own)):
                    part = batch.take(pa.array(np.flatnonzero(own == x)))
                    best.setdefault(x, _Best(*held.value[x], k)).show(part.column("id").to_numpy(), _matrix(part.column("vec")))
            for b in best.values():
                yield b.found()

        return _rank(_usable(self.vectors(sorted(probes)), "list").mapInArrow(run, _FOUND), k)


def ivf_write(vectors: DataFrame, path: str, nlist: int, sample: int = SAMPLE, seed: int = 7) -> Ivf:
    """A new index of vectors (id, vec, further columns). Centroids are fitted on the vectors with the least hashes of
    their ids, `sample` at most; all vectors are put into lists. An empty table has no index (ValueError)."""
    spark, rows = vectors.sparkSession, vectors.where("id is not null and vec is not null")
    total = rows.count()
    if not total:
        raise ValueError("no vectors to index")
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int(min(1.0, sample / total) * (1 << 20)))
    fit = (rows if total <= sample else rows.where(part)).select(array_to_vector("vec").alias("f"))
    model = KMeans(k=min(nlist, total), seed=seed, distanceMeasure="cosine", featuresCol="f").fit(fit)
    centres = np.array(model.clusterCenters())
    own = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(centres)], "list int, centre array<double>")
    own.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    schema = f"{_columns(rows.drop('list'))}, list int"
    index = Ivf(spark, path, centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300), schema)
    index.add(rows, "overwrite")
    spark.createDataFrame([(len(centres), "cosine", schema)], "nlist int, metric string, schema string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return index


def ivf_open(spark: SparkSession, path: str) -> Ivf:
    """An index that ivf_write has written; without a manifest it is not complete, and reading fails."""
    told = spark.read.json(f"{path}/manifest").first()
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    if len(rows) != told.nlist:
        raise ValueError(f"{path}: {len(rows)} centroids, {told.nlist} expected")
    centres = np.array([r.centre for r in rows])
    return Ivf(spark, path, centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300), told.schema)


# --- hashing


def _marks(dim: int, bits: int, tables: int, seed: int) -> Callable[[np.ndarray], np.ndarray]:
    """Of vectors of unit length their bucket in each table, by the sides of `bits` random planes."""
    planes = np.random.default_rng(seed).standard_normal((dim, bits * tables))
    kind = np.uint8 if bits <= 8 else np.int64

    def run(x: np.ndarray) -> np.ndarray:
        parts = [((x[i : i + 1000] @ planes > 0).reshape(-1, tables, bits) @ (1 << np.arange(bits))).astype(kind) for i in range(0, len(x), 1000)]
        return np.concatenate(parts) if parts else np.zeros((0, tables), kind)

    return run


def _dim(vectors: DataFrame) -> int:
    first = vectors.select(F.size("vec").alias("n")).first()
    return first.n if first else 1


def lsh_pairs(queries: DataFrame, vectors: DataFrame, bits: int, tables: int, seed: int = 11) -> DataFrame:
    """(q, node): vectors that share a bucket with a query in one of the tables; a bucket is the sides of `bits` random
    planes. A pair at angle t shares one with probability 1 - (1 - (1 - t / pi) ^ bits) ^ tables."""
    q, v = _usable(queries), _usable(vectors)
    marks = _marks(_dim(v), bits, tables, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = marks(_matrix(batch.column("vec"))) + (np.arange(tables, dtype=np.int64) << bits)
                row = pa.array(np.repeat(np.arange(batch.num_rows), tables))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(row), pa.array(own.ravel())], names=["id", "bucket"])

    a = q.mapInArrow(run, "id long, bucket long").withColumnRenamed("id", "q")
    b = v.mapInArrow(run, "id long, bucket long").withColumnRenamed("id", "node")
    return a.join(b, "bucket").where("q != node").select("q", "node").distinct()


def knn_lsh(queries: DataFrame, vectors: DataFrame, k: int, bits: int = 8, tables: int = 112, seed: int = 11) -> DataFrame:
    """(q, node, sim, rank) among the vectors that share a bucket with the query, the pairs of lsh_pairs(). Fewer bits or
    more tables find more and look at more; see the README for shares and recall. Vectors stay where they are and queries
    come to them; buckets are compared block by block, so that neither pairs nor buckets are shuffled."""
    return search(queries, vectors, k, _marks(_dim(_usable(vectors)), bits, tables, seed))


def mean_vectors(vectors: DataFrame, by: str) -> DataFrame:
    """by, n, mean: the mean of the vectors (vec) of each group, by a built-in aggregate with partial sums; what a
    centroid moves to. Null vectors don't count."""
    rows = vectors.where("vec is not null").select(by, array_to_vector(F.col("vec").cast("array<double>")).alias("v"))
    means = rows.groupBy(by).agg(Summarizer.metrics("count", "mean").summary(F.col("v")).alias("s"))
    return means.select(by, F.col("s.count").alias("n"), vector_to_array("s.mean").alias("mean"))


def hash_embedding(df: DataFrame, text: str, dim: int = 64) -> DataFrame:
    """A stand-in for a model: signed hashed bag of words, unit length (all zeros without words)."""
    h = F.transform(tokens(F.col(text)), lambda t: F.xxhash64(t))
    bins = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(F.col("__h"), lambda x: F.pmod(x, F.lit(dim)) == i), F.lit(0.0), lambda s, x: s + F.when(x.bitwiseAND(F.lit(1 << 40)) == 0, 1.0).otherwise(-1.0)))
    norm = F.sqrt(F.aggregate("__v", F.lit(0.0), lambda s, x: s + x * x))
    out = df.withColumn("__h", h).withColumn("__v", bins).withColumn("__n", norm)
    return out.withColumn("vec", F.transform("__v", lambda x: F.when(F.col("__n") > 0, x / F.col("__n")).otherwise(0.0).cast("float"))).drop("__h", "__v", "__n")
