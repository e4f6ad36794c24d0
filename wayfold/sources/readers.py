"""Raw zone readers, HTML parsing, JDBC, and a custom source for JSON lines with provenance."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wayfold.functions.text import html_title, url_host


def read_raw(spark: SparkSession, path: str, fmt: str, schema: str | None = None, **options: str) -> DataFrame:
    """Any of json, csv, parquet, text, orc; malformed records land in _corrupt_record where the schema has it."""
    reader = spark.read.format(fmt).options(**options)
    if schema:
        reader = reader.schema(schema)
    if fmt in ("json", "csv"):
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return reader.load(path)


def parse_html(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Adds title, host and body_text (tags, scripts and styles taken out)."""
    body = F.regexp_replace(F.col(html), r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ")
    return df.withColumns({"title": html_title(F.col(html)), "host": url_host(F.col(url)), "body_text": F.trim(F.regexp_replace(F.regexp_replace(body, "<[^>]*>", " "), r"\s+", " "))})


def read_jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, **options: str) -> DataFrame:
    """A relational table; with key and bounds it is read in parallel ranges."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()


class JsonLinesSource(DataSource):
    """format("wayfold_jsonl"): records of literal JSON lines given as option `lines`; a partition per part."""

    @classmethod
    def name(cls) -> str:
        return "wayfold_jsonl"

    def schema(self) -> str:
        return "id string, name string, source_url string"

    def reader(self, schema):
        return _JsonLinesReader(self.options)


class _JsonLinesReader(DataSourceReader):
    def __init__(self, options):
        self.lines = [x for x in options.get("lines", "").split("\n") if x]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(min(4, max(1, len(self.lines))))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for line in self.lines[partition.value :: min(4, max(1, len(self.lines)))]:
            r = json.loads(line)
            yield r.get("id"), r.get("name"), r.get("source_url")
