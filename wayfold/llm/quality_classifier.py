"""Quality classifier: gradient-boosted trees over statistics of a document's text."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.boosting import Forest, train
from wayfold.llm.byte_bpe import slices
from wayfold.llm.common import materialize, slim

THRESHOLD, FOLDS = 0.3, 5
#: The forest is fitted on at most so many labelled rows, those with the least digests of their ids.
SAMPLE = 20_000
CHARACTERS = "#*$%&|<>!?.,:;@=_/{}()[]\"'-"
UPPER, DIGIT = re.compile(r"[A-Z]+"), re.compile(r"[0-9]+")
NAMES = ["log_words", "log_chars", "chars_word", "unique_words", "next_same", "upper", "digits", "lines", "unique_lines", "words_line", "longest_word", "non_ascii", "packed", "short_words", *CHARACTERS]


def statistics(text: str) -> list[float]:
    """Numbers of the text alone; all are defined for an empty one."""
    words = text.split()
    n, c = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    raw = text.encode()
    return [
        np.log1p(len(words)), np.log1p(len(text)), len(text) / n, len(set(words)) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        sum(map(len, UPPER.findall(text))) / c, sum(map(len, DIGIT.findall(text))) / c,
        np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)),
        min(100, max(map(len, words), default=0)), len(raw) / c, len(zlib.compress(raw, 1)) / c,
        sum(len(w) < 4 for w in words) / n,
        *[text.count(x) / n for x in CHARACTERS],
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, x (binary: float32 statistics) and digest (of the id, for folds and the sample)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = [np.array(statistics(t or ""), np.float32).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(x, pa.binary())], names=["doc_id", "x"])

    return slim(docs, "doc_id", "text").mapInArrow(run, "doc_id long, x binary")


def fit(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """A forest from labelled rows that aren't held out. Ids labelled twice with different classes are left
    out, as are null labels; several rows with one id count once each."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y1")).where("y = y1").select("doc_id", "y")
    own = rows.where(~F.col("held_out")).join(known, "doc_id").select("x", "y", F.xxhash64("doc_id").alias("o"), "doc_id")
    table = own.orderBy("o", "doc_id", "x").limit(sample).select("x", "y").toArrow()
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float32).reshape(-1, len(NAMES)).astype(np.float64)
    return train(x, table.column("y").to_numpy().astype(np.float64))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out (crc32 of the id as text mod FOLDS is 0), score and predicted, for every row.

    Null texts are empty; empty ones are scored like any other. A null doc_id is not held out and learns from
    no label. No usable labels: a constant score of 0.5. An empty table gives no rows."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    rows = materialize(features(docs).withColumn("held_out", held))
    forest = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4000):
                batch = whole.slice(i, 4000)
                x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, len(NAMES)).astype(np.float64)
                score = np.round(forest.value.score(x), 9)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "x", "held_out").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
