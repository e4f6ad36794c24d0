"""Substring dedup by line and word-window hashing, with original offsets.

Units are lines (a paragraph of several lines goes line by line), normalised to lower-case letters and digits
between single blanks. Those of MIN_WORDS words or more are hashed; shorter ones (greetings, headings, stock phrases)
repeat in clean texts too and go only between two removed lines. So that a passage is found inside longer
lines or across them as well, windows of WINDOW words are seeds, whatever lines they span: of every REACH + 1
consecutive windows the one with the least hash is one, so that a passage of WINDOW + REACH = 50 words shares at
least a seed with its copy, and seeds within it leave no gap. Digests of units and seeds are grouped over the
corpus; the occurrence with the smallest (doc_id, offset) stays and later ones go. A row of seeds that go is extended
at both ends, word by word, as far as the text equals that around the kept occurrence.

The functions run Spark jobs as they build their result: intermediate tables are written in the shared folder.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.byte_bpe import slices
from wayfold.llm.common import materialize, skew_join, slim

#: Lines of fewer words don't count as repeats by themselves.
MIN_WORDS = 20
#: Words of a seed, and the most words by which a repeated passage goes on beyond its last seed.
WINDOW, REACH = 26, 24
#: Scripts without blanks: each character is a token, two count as a word.
DENSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u309f\u30a1-\u30fa\u30fc-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORDS = re.compile(rf"[^\W_{DENSE}]+|[{DENSE}]")
ONE_DENSE = re.compile(f"[{DENSE}]")
PLAIN_WORDS = re.compile(r"[^\W_]+")
#: What goes with the last word of a cut inside a unit.
TAIL = re.compile(r"[^\w\s]*[^\S\n]*")


def lines(text: str) -> tuple[list[str], list[int], list[int], list[int]]:
    """The text's words, and for each line its place, the words before it and the words it counts for."""
    dense = ONE_DENSE.search(text) is not None
    find = WORDS.findall if dense else PLAIN_WORDS.findall
    words: list[str] = []
    starts, before, counts, at = [], [], [], 0
    for line in text.split("\n"):
        own = find(line)
        starts.append(at)
        before.append(len(words))
        counts.append(len(own) - sum(map(bool, map(ONE_DENSE.match, own))) // 2 if dense else len(own))
        words += own
        at += len(line) + 1
    return words, starts, before, counts


class _Hashes(dict):
    """Word to the hash of its lower case."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.lower())
        return value


_BASE = 0x9E3779B97F4A7C15
_hashes = _Hashes()


def _hashed(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _rolling(a: np.ndarray, n: int, least: np.ufunc) -> np.ndarray:
    """least over every n consecutive values."""
    size = 1
    while size < n:
        step = min(size, n - size)
        a = least(a[:-step], a[step:])
        size += step
    return a


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


_INVERSE = pow(_BASE, -1, 1 << 64)


def digests(words: list[str], before: list[int], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(unit, digest) of the lines of MIN_WORDS words or more (unit: the line's number), then of the seeds (-1 - the
    place of the first word). Digests are polynomials over the words' hashes, by differences of running sums."""
    n = len(words)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_hashed(words) * _powers(_BASE, n), dtype=np.uint64, out=sums[1:])
    inverse = _powers(_INVERSE, n + 1)
    ends = np.array([*before[1:], n])
    own = np.flatnonzero(np.array(counts) >= MIN_WORDS)
    a, b = np.array(before)[own], ends[own]
    # a line's digest takes its length in, so that it is no seed's
    at_lines = _mixed((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    if n < WINDOW + REACH:  # no passage of that length is in it
        return own, at_lines.view(np.int64)
    h = _mixed((sums[WINDOW:] - sums[:-WINDOW]) * inverse[: n - WINDOW + 1])
    least = _rolling(h, REACH + 1, np.minimum)
    pad = np.zeros(REACH, np.uint64)
    chosen = np.flatnonzero(_rolling(np.concatenate([pad, least, pad]), REACH + 1, np.maximum) == h)
    return np.concatenate([own, -1 - chosen]), np.concatenate([at_lines, h[chosen]]).view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row (tells rows with one doc_id apart) and text, of all texts with characters."""
    return slim(docs, "doc_id", "text").where("text != ''").select("doc_id", F.xxhash64("text").alias("row"), "text")


def scan(docs: DataFrame) -> DataFrame:
    """A row per line of MIN_WORDS words or more and per seed: doc_id, row, unit (the line's number; of a seed: -1 -
    the place of its first word), digest, and prior: where the digest stands first in the same text, if earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, rows = part.column("doc_id"), part.column("row")
                sizes, units, found, priors = [], [], [], []
                for text in part.column("text").to_pylist():
                    words, _, before, counts = lines(text)
                    unit, digest = digests(words, before, counts)
                    _, first, back = np.unique(digest, return_index=True, return_inverse=True)
                    prior = unit[first[back]] if len(digest) else unit
                    sizes.append(len(unit))
                    units.append(unit)
                    found.append(digest)
                    priors.append(np.where(prior == unit, _NONE, prior))
                at = pa.array(np.repeat(np.arange(part.num_rows), sizes))
                prior = np.concatenate(priors).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.take(at), rows.take(at), pa.array(np.concatenate(units).astype(np.int32)), pa.array(np.concatenate(found)), pa.array(prior, mask=prior == _NONE)], names=["doc_id", "row", "unit", "digest", "prior"])

    return _keyed(docs).mapInArrow(run, "doc_id long, row long, unit int, digest long, prior int")


_NONE = np.iinfo(np.int32).min


def _with_text(docs: DataFrame, own: DataFrame) -> DataFrame:
    """own (by doc_id and row) with the row's text; equal rows count once."""
    own = own.withColumnsRenamed({"doc_id": "i", "row": "r"})
    return _keyed(docs).join(own, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("row") == F.col("r"))).drop("i", "r")


def _around(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """d, before, after: the hashes of up to REACH words on either side of kept seeds, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out: list[list] = [[], [], []]
                for text, places in zip(part.column("text").to_pylist(), part.column("places").to_pylist(), strict=True):
                    h = _hashed(lines(text)[0])
                    for p in places:
                        at = p["pos"]
                        out[0].append(p["d"])
                        out[1].append(h[max(0, at - REACH) : at][::-1].tobytes())
                        out[2].append(h[at + WINDOW : at + WINDOW + REACH].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["d", "before", "after"])

    places = kept.groupBy("doc_id", "row").agg(F.collect_list(F.struct("d", "pos")).alias("places"))
    return _with_text(docs, places).mapInArrow(run, "d long, before binary, after binary").dropDuplicates(["d"])


def _cut(text: str, gone: list[int], found: list[dict]) -> tuple[int, int, list[tuple[int, int]]]:
    """Units of which something goes, words that go, and the spans."""
    tokens = [m.span() for m in (WORDS if ONE_DENSE.search(text) else PLAIN_WORDS).finditer(text)]
    starts, out = [a for a, _ in tokens], bytearray(len(tokens))
    h = _hashed([text[a:b] for a, b in tokens]) if any(s["before"] or s["after"] for s in found) else None
    a = 0
    for s in sorted(found, key=lambda s: s["pos"]):  # from a row's first seed to its last all words go
        if s["left"]:
            a = s["pos"]
            for x in np.frombuffer(s["before"] or b"", np.uint64):
                if not a or h[a - 1] != x:
                    break
                a -= 1
            if s["own"] is not None and s["pos"] - s["own"] < WINDOW:  # it overlaps its kept occurrence, which stays whole
                a = max(a, s["own"] + WINDOW)
        if s["right"]:
            b = s["pos"] + WINDOW
            for x in np.frombuffer(s["after"] or b"", np.uint64):
                if b == len(tokens) or h[b] != x:
                    break
                b += 1
            out[a:b] = b"\1" * (b - a)
    _, at, before, counts = lines(text)
    at.append(len(text))
    before.append(len(tokens))
    # a line's end goes with it
    parts = [(at[i], at[i + 1], n, before[i], before[i + 1]) for i, n in enumerate(counts) if before[i] < before[i + 1]]
    for i in gone:
        out[before[i] : before[i + 1]] = b"\1" * (before[i + 1] - before[i])
    whole = [out.find(0, p, q) < 0 for *_, p, q in parts]
    i = 1
    while i < len(parts):  # short lines between removed ones
        j = i
        while j < len(parts) and not whole[j] and parts[j][2] < MIN_WORDS:
            j += 1
        if i < j < len(parts) and whole[i - 1] and whole[j]:
            for *_, p, q in parts[i:j]:
                out[p:q] = b"\1" * (q - p)
            whole[i:j] = [True] * (j - i)
        i = j + 1
    spans: list[tuple[int, int]] = []
    touched = 0
    for (a, b, _, p, q), all_of_it in zip(parts, whole, strict=True):
        cuts = [(a, b)] if all_of_it else []
        while not all_of_it and (x := out.find(1, p, q)) >= 0:
            p = y if (y := out.find(0, x, q)) >= 0 else q
            cuts.append((starts[x], min(starts[p] if p < len(starts) else b, TAIL.match(text, tokens[p - 1][1]).end())))
        touched += bool(cuts)
        for x, y in cuts:
            if spans and spans[-1][1] == x:
                x = spans.pop()[0]
            spans.append((x, y))
    return touched, sum(out), spans


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, row, spans (array of start, end) to remove, n_units (of which something goes) and n_words of these,
    for each document that has any. Of equal doc_ids the row with the smaller digest ranks first; a null doc_id
    ranks last."""
    found = materialize(scan(docs).withColumn("rank", F.coalesce("doc_id", F.lit((1 << 63) - 1))))
    seen = found.groupBy("digest").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
    seen = materialize(seen.where("n > 1").select(F.col("digest").alias("d"), "first"))
    hits = materialize(skew_join(found, seen, "digest", "d"))
    # among rows of one doc_id the least row digest has the first occurrence
    tied = hits.where("rank = first").groupBy("d").agg(F.min("row").alias("least"), F.max("row").alias("most")).where("least != most").select(F.col("d").alias("t"), "least")
    hits = skew_join(hits, materialize(tied), "d", "t", "left")
    hits = materialize(hits.select("doc_id", "row", "unit", "d", "prior", ((F.col("rank") == F.col("first")) & (F.col("least").isNull() | (F.col("row") == F.col("least")))).alias("here")))
    gone = hits.where("not here or prior is not null")
    pos = (-1 - F.col("unit")).alias("pos")
    lost = gone.where("unit < 0").select("doc_id", "row", "d", pos, F.when(F.col("here"), -1 - F.col("prior")).alias("own")).distinct()
    order = Window.partitionBy("doc_id", "row").orderBy("pos")
    apart = lambda x: F.coalesce(x > WINDOW, F.lit(True))
    lost = materialize(lost.withColumns({"left": apart(F.col("pos") - F.lag("pos").over(order)), "right": apart(F.lead("pos").over(order) - F.col("pos"))}))
    # a row of seeds is extended from its ends only
    ends = materialize(lost.where("left or right"))
    kept = hits.where("unit < 0 and here and prior is null").join(ends.select("d").distinct(), "d", "left_semi").select("doc_id", "row", "d", pos).distinct()
    around = materialize(_around(docs, kept)).withColumnRenamed("d", "k")
    ends = skew_join(ends, around, "d", "k", "left").withColumns({"before": F.when(F.col("left"), F.col("before")), "after": F.when(F.col("right"), F.col("after"))})
    every = ends.select("doc_id", "row", F.lit(None).cast("int").alias("unit"), F.struct("pos", "own", "left", "right", "before", "after").alias("seed"))
    every = every.unionByName(gone.where("unit >= 0").select("doc_id", "row", "unit", F.lit(None).cast(every.schema["seed"].dataType).alias("seed")))
    by_doc = every.groupBy("doc_id", "row").agg(F.collect_set("unit").alias("gone"), F.collect_list("seed").alias("seeds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, row, text, gone, found in zip(*[part.column(c).to_pylist() for c in ("doc_id", "row", "text", "gone", "seeds")], strict=True):
                    n_units, n_words, spans = _cut(text, gone, found)
                    rows.append({"doc_id": doc_id, "row": row, "n_units": n_units, "n_words": n_words, "spans": [{"start": a, "end": b} for a, b in spans]})
                yield pa.RecordBatch.from_pylist(rows, schema=_SPANS)

    cut = _with_text(docs, by_doc).mapInArrow(run, "doc_id long, row long, n_units long, n_words long, spans array<struct<start:int,end:int>>")
    return cut.where("n_units > 0").dropDuplicates(["doc_id", "row"])


_SPANS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_units", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated units cut out, and a column removed_spans (array<struct<start,end>>: offsets in the
    original text, in code points, ends exclusive; empty where nothing goes). All rows and columns stay;
    null and empty texts stay as they are; an empty table gives no rows. Of equal rows each is cut alike, so
    exact copies of a row under one doc_id all count as its first occurrence."""
    if "removed_spans" in docs.columns:
        raise ValueError("docs already has a column removed_spans")
    names = docs.columns
    own = repeats(docs).select(F.col("doc_id").alias("__id"), F.col("row").alias("__r"), F.col("spans").alias("__spans"))
    out = docs.withColumn("__row", F.xxhash64("text")).join(own, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__r")), "left")
    out = out.withColumn("removed_spans", F.coalesce("__spans", F.array().cast("array<struct<start:int,end:int>>")))
    ends = F.transform(F.concat(F.array(F.lit(0)), F.transform("removed_spans", lambda s: s["end"])), lambda e, i: F.substring(F.col("text"), e + 1, F.coalesce(F.get(F.col("removed_spans"), i)["start"], F.length("text")) - e))
    return out.withColumn("text", F.when(F.size("removed_spans") > 0, F.array_join(ends, "")).otherwise(F.col("text"))).select(*names, "removed_spans")
