"""Processed zone, graph and index exports."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_processed(df: DataFrame, path: str, partition: str | None = "type") -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, fmt: str = "parquet") -> None:
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").format(fmt).option("header", "true").save(f"{path}/{name}")


def export_index(vectors: DataFrame, centroids: DataFrame, path: str) -> None:
    """Vectors by centroid (a probe prunes to its partitions), centroids, and a manifest row."""
    vectors.write.mode("overwrite").partitionBy("centroid").parquet(f"{path}/vectors")
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    centroids.selectExpr("count(*) AS nlist", "'cosine' AS metric").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def write_jdbc(df: DataFrame, url: str, name: str, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=name, **options).mode("append").save()
