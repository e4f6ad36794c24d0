"""Phrase collocations: phrases of two or three words that are much commoner than their parts suggest.

First pass: every task counts the words and phrases of its texts in a count-min sketch, two rows of hashed cells, of
which it ships the cells it has touched; the tasks' sketches are summed block by block. A cell counts to the least count
of a candidate only, so a sum of cells may be too large for a phrase (others share them) but never too small to pass.
Second pass: phrases all of whose cells, and all of whose parts' cells, reach that count are counted exactly. So every
frequent phrase is counted, with few of the rare ones. Scores, cuts and subsumption are joins of the counts.

The sketch's width follows the length of the texts up to MOST_CELLS, which bounds what is sent to every worker (a bit
a cell). Beyond some 10^9 phrases more rare ones survive the sketch and are counted in vain; the result is the same.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.byte_bpe import slices
from wayfold.llm.common import materialize, skew_join, slim

#: Candidates have two or three words and occur so often; a longer candidate with so many per cent of the occurrences
#: subsumes a shorter one; so many phrases a language are returned.
LEAST, SUBSUMES, TOP = 10, 50, 2000
#: Cells of a row of the sketch at most and at least, cells of a block, bytes of text a cell.
MOST_CELLS, LEAST_CELLS, BLOCK, BYTES_A_CELL = 1 << 27, 1 << 16, 1 << 16, 2
#: Words that a task looks at together, and words it knows by number before it starts anew.
CHUNK, KNOWN = 1_000_000, 1 << 20

#: Small letters for A to Z, `.` for all that parts pieces (so no word has one), blank for tab; the rest stays.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x2E if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b for b in range(256))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class _Words(dict):
    """word -> number; 0 is the end of a piece. hashes holds a hash for each number."""

    def __init__(self):
        super().__init__({b".": 0})
        self.names, self.hashes = [b"."], [0]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.names)
        self.names.append(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return n


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, _Words]]:
    """(language, word numbers with 0 between pieces, words) of stretches of about CHUNK words."""
    words, held, size = _Words(), defaultdict(list), 0
    for whole in batches:
        for batch in slices(whole):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = list(map(words.__getitem__, text.translate(_FOLD).replace(b".", b" . ").split()))
                held[lang].append(np.array([0, *own, 0], np.int64))
                size += len(own)
                if size >= CHUNK or len(words) >= KNOWN:
                    for name, parts in held.items():
                        yield name, np.concatenate(parts), words
                    held.clear()
                    size = 0
                    if len(words) >= KNOWN:
                        words = _Words()
    for name, parts in held.items():
        yield name, np.concatenate(parts), words


def _phrases(lang: str, ids: np.ndarray, words: _Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For one, two and three words: where in ids the phrases that lie within a piece begin, and their hashes."""
    h = np.array(words.hashes, np.uint64)[ids] ^ np.uint64(xxhash.xxh3_64_intdigest(lang, 1))
    out, inside, total = [], ids > 0, np.zeros(len(ids), np.uint64)
    for k in range(3):
        n = len(ids) - k
        if n <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.uint64)))
            continue
        total = total[:n] * _MIX[0] + h[k:] * _MIX[1]
        inside = inside[:n] & (ids[k:] != 0)
        at = np.flatnonzero(inside)
        x = total[at]
        x = (x ^ (x >> np.uint64(29))) * _MIX[2]
        out.append((at, x ^ (x >> np.uint64(32))))
    return out


def _cells(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(width - 1)
    return (hashes & mask).astype(np.uint32), ((hashes >> np.uint64(32)) & mask).astype(np.uint32) + np.uint32(width)


def sketch(docs: DataFrame, width: int) -> np.ndarray:
    """A bit for each of two rows of `width` cells: whether it counts LEAST or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, words in _chunks(batches):
            touched = np.concatenate([c for _, h in _phrases(lang, ids, words) for c in _cells(h, width)])
            cells, n = np.unique(touched, return_counts=True)
            n = np.minimum(n, LEAST).astype(np.uint8)
            if not len(cells):
                continue
            block, first = np.unique(cells // BLOCK, return_index=True)
            ends = [*first[1:].tolist(), len(cells)]
            low = (cells % BLOCK).astype(np.uint16)
            parts = [(low[a:b] >> 8).astype(np.uint8).tobytes() + (low[a:b] & 255).astype(np.uint8).tobytes() + n[a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(parts, pa.binary())], names=["block", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                high, low, n = np.frombuffer(raw, np.uint8).reshape(3, -1)
                at = high.astype(np.int64) * 256 + low
                if block not in counts:
                    counts[block] = np.zeros(BLOCK, np.uint8)
                counts[block][at] = np.minimum(counts[block][at] + n, LEAST)
        for block, held in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(held >= LEAST).tobytes()], pa.binary())], names=["block", "bits"])

    parts = docs.mapInArrow(run, "block int, cells binary")
    bits = parts.repartition("block").mapInArrow(merge, "block int, bits binary").toArrow()
    out = np.zeros(2 * width // 8, np.uint8)
    for block, raw in zip(bits.column("block").to_pylist(), bits.column("bits").to_pylist(), strict=True):
        out[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(raw, np.uint8)
    return out


def frequent(docs: DataFrame, width: int) -> DataFrame:
    """lang, phrase, words, f: all phrases of one to three words that occur LEAST times or more, and as phrase '' of no
    words the number of words of the language."""
    held = docs.sparkSession.sparkContext.broadcast(sketch(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        passes = lambda cells: (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1
        for lang, ids, words in _chunks(batches):
            phrase, size, f, ok = [b""], [0], [], None
            for k, (at, h) in enumerate(_phrases(lang, ids, words)):
                first, second = _cells(h, width)
                own = np.zeros(len(ids) + 1, bool)
                own[at] = (passes(first) & passes(second)).astype(bool)
                if k:  # both phrases of one word less must pass as well
                    own[:-1] &= ok[:-1] & ok[1:]
                else:
                    f.append(len(at))
                ok, start = own, np.flatnonzero(own)
                # words of these phrases, numbered anew so that three numbers fit into one
                used = np.unique(np.concatenate([ids[start + j] for j in range(k + 1)]))
                number = np.zeros(len(words.names), np.int64)
                number[used] = np.arange(len(used))
                packed = np.zeros(len(start), np.int64)
                for j in range(k + 1):
                    packed = packed << 21 | number[ids[start + j]]
                found, n = np.unique(packed, return_counts=True)
                columns = [used[found >> 21 * j & (1 << 21) - 1].tolist() for j in range(k, -1, -1)]
                phrase += [b" ".join(x) for x in zip(*([words.names[i] for i in c] for c in columns), strict=True)]
                size += [k + 1] * len(found)
                f += n.tolist()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f), pa.string()), pa.array(phrase, pa.binary()), pa.array(size, pa.int32()), pa.array(f, pa.int64())], names=["lang", "phrase", "words", "f"])

    parts = docs.mapInArrow(run, "lang string, phrase binary, words int, f long")
    whole = parts.groupBy("lang", F.col("phrase").cast("string").alias("phrase"), "words").agg(F.sum("f").alias("f"))
    return whole.where((F.col("words") == 0) | (F.col("f") >= LEAST))


def mine(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language.

    A null lang is 'und', a null text empty. Every row is a text: repeated rows count again, doc_id and further columns
    are not looked at. Languages without candidates and an empty table give no rows."""
    d = slim(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = min(MOST_CELLS, max(LEAST_CELLS, 1 << (size // BYTES_A_CELL).bit_length()))
    # a phrase has no line feed, so the key is that of one language and phrase
    key = lambda phrase: F.concat("lang", F.lit("\n"), phrase)
    counts = materialize(frequent(d, width).withColumn("key", key(F.col("phrase"))))
    w, join = F.split("phrase", " "), lambda *x: F.concat_ws(" ", *x)
    of = counts.where("words > 1").select("lang", "phrase", "words", "f", "key", w[0].alias("w1"), w[1].alias("w2"), F.get(w, F.lit(2)).alias("w3"))
    part = lambda role, p: F.struct(F.lit(role).alias("role"), key(p).alias("part"))
    three = F.array(part("l1", F.col("w1")), part("r1", join("w2", "w3")), part("l2", join("w1", "w2")), part("r2", F.col("w3")))
    two = F.array(part("l1", F.col("w1")), part("r1", F.col("w2")))
    parts = materialize(of.select(F.col("key").alias("of"), F.inline(F.when(F.col("words") == 2, two).otherwise(three))))
    # a common word is part of many phrases
    known = skew_join(parts, counts.select("key", F.col("f").alias("value")), "part", "key").select("of", "role", "value")
    own = of.select(F.col("key").alias("of"), F.lit("a").alias("role"), F.col("f").alias("value"))
    longer = of.where("words = 3").select(F.explode(F.array(key(join("w1", "w2")), key(join("w2", "w3")))).alias("of"), F.lit("longer").alias("role"), F.col("f").alias("value"))
    every = own.unionByName(known).unionByName(longer)
    of_role = lambda role: F.max(F.when(F.col("role") == role, F.col("value"))).alias(role)
    rows = every.groupBy("of").agg(*[of_role(x) for x in ("a", "l1", "r1", "l2", "r2", "longer")])
    rows = rows.where(F.col("longer").isNull() | (100 * F.col("longer") < SUBSUMES * F.col("a")))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    score = lambda k: F.call_function("div", (whole("a") * whole("a")).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"), whole(f"l{k}") * whole(f"r{k}"))
    rows = rows.withColumns({"s1": score(1), "s2": score(2)})
    later = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    pick = lambda x: F.when(later, F.col(f"{x}2")).otherwise(F.col(f"{x}1"))
    at = F.length("of") - F.length(F.substring_index("of", "\n", -1)) - 1
    rows = rows.select(F.left("of", at).alias("lang"), F.substring_index("of", "\n", -1).alias("phrase"), "a", pick("l").alias("l"), pick("r").alias("r"), pick("s").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k) x),
c AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM c WHERE k = 1 GROUP BY 1),
x AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM c WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, k, phrase, a, j, array_to_string(w[1:j], ' ') AS front, array_to_string(w[j + 1:], ' ') AS back FROM (SELECT *, unnest(range(1, k)) AS j FROM x) y),
s AS (SELECT cuts.lang, cuts.phrase, a, p.f AS l, q.f AS r, 1000000 * a * a // (p.f * q.f) AS score, row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY 1000000 * a * a // (p.f * q.f), j) AS best FROM cuts JOIN c p ON p.lang = cuts.lang AND p.phrase = cuts.front AND p.k = j JOIN c q ON q.lang = cuts.lang AND q.phrase = cuts.back AND q.k = cuts.k - j),
gone AS (SELECT DISTINCT b.lang, b.phrase FROM (SELECT lang, a AS longer, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM x WHERE k = 3) t JOIN x b ON b.lang = t.lang AND b.phrase = t.phrase AND b.k = 2 WHERE 100 * longer >= 50 * b.a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s ANTI JOIN gone USING (lang, phrase) WHERE best = 1) r JOIN n USING (lang) WHERE rank <= 2000
"""
