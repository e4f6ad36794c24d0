"""Best-fit-decreasing packing of token sequences into fixed-size training sequences.

Which bin best-fit decreasing picks depends on lengths alone, and there are at most `capacity` of them. So
the driver packs the histogram of lengths: bins with one remaining capacity are runs at one leaf of a segment
tree, the tightest open bin is found by a descent of the tree, and a run of equal documents is placed at once.
That is the packing of one global best-fit-decreasing pass, at a cost that doesn't grow with the documents.
Executors then number the pieces of each length and look up their places.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayfold.llm.byte_bpe import byte_characters, slices
from wayfold.llm.common import materialize, slim
from wayfold.llm.token_cache import TokenCache

TOKENIZER_FILE, CAPACITY, END_ID = "word_bpe_49k.json", 2048, 0
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+[,.]?").fullmatch
#: Pieces of one length are numbered in groups of about so many documents.
GROUP_ROWS = 20_000


class WordTokenizer:
    """Ids by the tokenizers library. Its rules never join across blanks and line ends, so that each stretch
    between them is encoded once and remembered. Strings of special tokens in a text are ordinary text."""

    def __init__(self, content: str):
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.chars = dict(enumerate(byte_characters()))
        self.ends = {c: self.tokenizer.encode(c, add_special_tokens=False).ids for c in ",."}
        self.cache = TokenCache(self.encode_stretch)

    def encode_stretch(self, stretch: str) -> list[int]:
        """A plain Latin word, with a comma or stop or without, goes to the merges directly: lower-casing and
        the byte characters are all that the tokenizer's other steps do to it."""
        if PLAIN(stretch):
            end = self.ends.get(stretch[-1])
            word = (stretch[:-1] if end else stretch).lower()
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.chars)
            ids = [t.id for t in self.model.tokenize(word)]
            return ids + end if end else ids
        return self.tokenizer.encode(stretch, add_special_tokens=False).ids

    def encode(self, text: str) -> array:
        return self.cache.ids(text.replace("\n", " ").split(" "))


class CapacityTree:
    """Open bins by remaining capacity; a max-free segment tree of counts finds the tightest that is large enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _add(self, leaf: int, n: int) -> None:
        i = leaf + self.size
        while i:
            self.counts[i] += n
            i >>= 1

    def push(self, remaining: int, first_bin: int, n: int) -> None:
        if n:
            self.runs[remaining].append((first_bin, n))
            self._add(remaining, n)

    def pop(self, remaining: int) -> tuple[int, int]:
        first_bin, n = self.runs[remaining].pop()
        self._add(remaining, -n)
        return first_bin, n

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least `length` that has an open bin."""
        i = length + self.size
        if self.counts[i]:
            return length
        while i > 1:
            if not i & 1 and self.counts[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.counts[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Places for all documents of a histogram {length: documents}: rows (length, first ordinal, first bin,
    documents a bin, offset). Document `o` of that length goes to bin first_bin + (o - first) // k at
    offset + (o - first) % k * length. Rows are ordered by length and first ordinal."""
    tree, bins, rows = CapacityTree(capacity), 0, []
    for length in sorted((n for n, count in histogram.items() if count), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit into {capacity}")
        left, done = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                k = capacity // length
                first, n, room = bins, -(-left // k), capacity
                bins += n
            else:
                first, n = tree.pop(room)
                k = room // length
            full = min(n, left // k)
            if full:
                rows.append((length, done, first, k, capacity - room))
                tree.push(room - k * length, first, full)
                done, left = done + full * k, left - full * k
            if left and full < n:  # fewer than k are left: one bin takes them
                rows.append((length, done, first + full, left, capacity - room))
                tree.push(room - left * length, first + full, 1)
                done, left, full = done + left, 0, full + 1
            tree.push(room, first + full, n - full)
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenize(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids and the end id, cut into pieces of at most `capacity`. Null text: the end id alone."""
    with open(tokenizer_path or public_tokenizers.path(TOKENIZER_FILE), encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordTokenizer(content.value)
        for batch in batches:
            for part in slices(batch):
                out: list[list] = [[], [], [], [], []]
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = coder.encode(text or "")
                    ids.append(END_ID)
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        for column, value in zip(out, (doc_id, piece, start, len(own), zlib.crc32(own.tobytes())), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return slim(docs, "doc_id", "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents: a row per piece with sequence_id and offset.

    Null and empty texts are one end id; repeated rows are packed each; a null doc_id stays null; an empty
    table gives no rows; a longer document is cut into whole pieces and a rest. The driver gets the histogram
    only (at most `capacity` rows); the table of places is bounded by it, not by the documents."""
    spark = docs.sparkSession
    pieces = materialize(tokenize(docs, tokenizer_path, capacity))
    groups = max(64, pieces.count() // GROUP_ROWS)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    counts = materialize(pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")))
    plan = best_fit_decreasing({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    numbered = pieces.withColumn("rn", F.row_number().over(own)).join(first, ["length", "salt"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rn") - 1).alias("ordinal"))
    places = spark.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, ordinal = (batch.column(c).to_numpy() for c in ("length", "ordinal"))
            row = table[np.searchsorted(keys, (length << 44) + ordinal, side="right") - 1]
            nth = ordinal - row[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(run, PIECES + ", sequence_id long, offset long")
