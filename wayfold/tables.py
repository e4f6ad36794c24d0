"""Intermediate tables in the folder that all executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session gets a temporary folder and a cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="wayfold-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again; it goes with dropped() or when the process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    for df in tables:
        path = getattr(df, "stored_at", None)
        spark = _written.pop(path, None)
        if spark:
            try:
                at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            except Exception:  # noqa: BLE001  the session may be over
                return


def small_enough(df: DataFrame, most_bytes: int, *columns: str) -> bool:
    """Whether the named columns of df take most_bytes at most, by the lengths of their text and 48 bytes a row. One
    aggregate; what is sent to every executor should be checked by it first."""
    own = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in columns), F.lit(48))
    return (df.agg(F.sum(own)).first()[0] or 0) <= most_bytes


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_written.items()):
        table = type("Table", (), {"stored_at": path})()
        dropped(table)
