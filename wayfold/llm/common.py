"""Helpers shared by the training-data operators: shared-folder tables, skew-safe joins, components."""

from __future__ import annotations

import atexit
import re
import tempfile
import threading
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than 1/HOT_SHARE of a join's left rows is hot, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 160

#: Rows that a task of a small table gets at least.
SMALL_ROWS = 50_000

#: Tables by thread, so that operators which run side by side drop their own ones only.
_written: dict[int, list[tuple[SparkSession, str]]] = {}


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session gets a temporary
    one (tests), and a cluster an error, as its executors share no temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="wayfold-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def materialize(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again: short lineage that survives lost executors.
    Tables known to have few rows are made by few tasks, whatever the number of shuffle partitions."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/wayfold-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(max(8, rows // SMALL_ROWS))).write.parquet(path)
    _written.setdefault(threading.get_ident(), []).append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def tables_so_far() -> int:
    return len(_written.get(threading.get_ident(), ()))


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may be over
            return


def drop_tables(since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the tables that this thread wrote after tables_so_far() gave `since`, but for those in keep (results
    of materialize() that a caller still reads)."""
    kept, own = {k.written_at for k in keep}, _written.setdefault(threading.get_ident(), [])
    gone, own[since:] = [x for x in own[since:] if x[1] not in kept], [x for x in own[since:] if x[1] in kept]
    _delete(gone)


def _drop_all() -> None:
    for own in _written.values():
        _delete(own)
    _written.clear()


atexit.register(_drop_all)


def slim(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that further ones can't clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def hot_keys(df: DataFrame, key: str, share: int = HOT_SHARE) -> list:
    """Keys with more than 1/share of the rows; at most `share` values by the pigeonhole principle."""
    total = df.count()
    floor = max(200, total // share)
    rows = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where((F.col("__n") > floor) & F.col(key).isNotNull()).collect()
    return [r[0] for r in rows]


def skew_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """left join right where right has one row a key. Rows of hot left keys meet a broadcast of at most
    HOT_SHARE right rows; all others go through a plain shuffled join. Both should be written tables."""
    hot = hot_keys(left, left_key)
    on = F.col(left_key) == F.col(right_key)
    if not hot:
        return left.join(right, on, how)
    cold = left.where(~F.col(left_key).isin(hot) | F.col(left_key).isNull()).join(right, on, how)
    warm = left.where(F.col(left_key).isin(hot)).join(F.broadcast(right.where(F.col(right_key).isin(hot))), on, how)
    return cold.unionByName(warm)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distributed union-find: (node, root) for every node of the edges; root is one node of its component.

    Each round points every node to its smallest neighbour (an aggregate with map-side combine, so a star's
    centre costs one row a task), then relabels the edges by these parents and drops those inside one node.
    Keys should be hash-like: then a round removes a constant share of the nodes, so rounds grow with the
    logarithm of the input. The rounds' parent tables are composed backwards at the end.
    Self-edges and nulls are ignored; no edges give no rows."""
    start = tables_so_far()
    e = materialize(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a != b").distinct())
    levels = []
    while n := e.count():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("parent")), n)
        levels.append((parent, n))
        step = materialize(skew_join(e, parent.withColumnRenamed("parent", "pa"), "a", "node").select("pa", "b"), n)
        e = skew_join(step, parent.withColumnRenamed("parent", "pb"), "b", "node").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        e = materialize(e.where("a != b").distinct(), n)
    if not levels:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # in the last round both ends of every edge have one parent; a parent without edges in the next round is a root
    last, n = levels.pop()
    roots = materialize(last.select("node", F.col("parent").alias("root")), n)
    while levels:
        below, n = levels.pop()
        up = roots.select(F.col("node").alias("up"), "root")
        roots = materialize(skew_join(below, up, "parent", "up", "left").select("node", F.coalesce("root", "parent").alias("root")), n)
    drop_tables(start, (roots,))
    return roots


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, conditions)
