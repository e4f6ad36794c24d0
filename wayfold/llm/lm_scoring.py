"""Language-model scoring: a hashed maximum-entropy model of all training texts, and the probability of every text.

The model (maxent.py) predicts leaves: the end of a text and the commonest words have one each, all other words share
the leaves that their last bytes name. A word's probability is its leaf's given the words before, times its share of the
leaf by counts; in a shared leaf, a word that no training text has keeps the share of half an occurrence. Training
texts are first counted by context and leaf, in one distributed pass. Gradient updates then run over these counts: tasks
sum up what each weight has seen and what the model expects, Spark adds these up by blocks of weights, and the new
weights go to all tasks. The model has a fixed size; counts of tokens have not: those of the HEAD commonest tokens go to
all tasks, the others meet their words in a join (none of them is frequent).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm import maxent
from wayfold.llm.byte_bpe import slices
from wayfold.llm.common import materialize, slim

FOLDS, HELD_OUT = 5, 1
#: Tokens whose counts are sent to all tasks, at most; the commonest words that have a leaf for themselves.
HEAD, OWN_LEAF = 1 << 18, maxent.LEAVES // 2
#: Steps of the gradient updates, and how much weights of rare rows are held back.
RATES, EASE = (1.2, 0.8, 0.6), 10.0
#: Tokens that a task counts at once, rare tokens whose leaf it remembers, leaves that it counts or scores at once.
CHUNK, REMEMBERED, TOGETHER = 1_000_000, 200_000, 1_000_000
#: Codes whose gradient a task adds up.
TASK_CODES = 4_000_000
#: Rows of weights in a block that is added up together; bits of a code that name the block it is counted in.
BLOCK, BLOCK_BITS = 1 << 8, 12

#: The end of a text, which is a token; no word is empty.
END = b""


def tokens(text: bytes) -> list[bytes]:
    """Words of a text in small letters (A to Z only), parted by blanks and tab to carriage return, and the end."""
    own = text.lower().split()
    own.append(END)
    return own


def token_counts(docs: DataFrame) -> DataFrame:
    """token, n (occurrences in all texts), c (in training texts) from (held_out, text as binary)."""

    def counted(every: list[bytes], own: list[bytes]) -> pa.RecordBatch:
        n, c = Counter(every), Counter(own)
        n.update(own)
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([c[t] for t in n], pa.int64())], names=["token", "n", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        for whole in batches:
            for batch in slices(whole):
                for out, text in zip(batch.column("held_out").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    held[not out].extend(tokens(text))
                    if len(held[0]) + len(held[1]) >= CHUNK:
                        yield counted(*held)
                        held = ([], [])
        yield counted(*held)

    return docs.select("held_out", "text").mapInArrow(run, "token binary, n long, c long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def _form(token: bytes) -> int:
    return OWN_LEAF + zlib.crc32(token[-3:]) % (maxent.LEAVES - OWN_LEAF)


class _Head(dict):
    """token -> its place in the head, or -1 - leaf for any other token."""

    def __init__(self, names: list[bytes]):
        super().__init__(zip(names, range(len(names)), strict=True))
        self.rare: dict[bytes, int] = {}

    def __missing__(self, token: bytes) -> int:
        found = self.rare.get(token)
        if found is None:
            if len(self.rare) >= REMEMBERED:
                self.rare.clear()
            found = self.rare[token] = -1 - _form(token)
        return found


def _head(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray, np.ndarray, int]:
    """Tokens, training counts and leaves of the commonest tokens, and the count that they reach and no other token
    does. Counts are put into bins of equal logarithms, so that no ranking of all tokens is needed."""
    bins = counts.groupBy(F.floor(F.log2(F.col("n").cast("double")) * 8).alias("bin")).agg(F.count(F.lit(1)).alias("tokens"), F.min("n").alias("least")).orderBy(F.col("bin").desc()).collect()
    least, held = 1 << 62, 0
    for r in bins:
        held += r.tokens
        if held > most:
            break
        least = r.least
    rows = counts.where(F.col("n") >= least).select("token", "c").toArrow()
    names, c = rows.column("token").to_pylist(), rows.column("c").to_numpy().astype(np.int64)
    leaf = np.array([_form(t) for t in names], np.int64)
    order = sorted((i for i in range(len(names)) if names[i] != END and c[i]), key=lambda i: (-c[i], names[i]))
    leaf[order[: OWN_LEAF - 1]] = np.arange(1, 1 + len(order[: OWN_LEAF - 1]))
    leaf[[i for i, t in enumerate(names) if t == END]] = 0
    return names, c, leaf, least


def _mass(counts: DataFrame, least: int, c: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """Smoothed training tokens of each leaf: half an occurrence more for each known token, and for an unknown one in
    each shared leaf. The end is in the training texts, or there are none and its leaf is as good as impossible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(maxent.LEAVES)
        for batch in batches:
            own = np.fromiter(map(_form, batch.column("token").to_pylist()), np.int64, batch.num_rows)
            total += np.bincount(own, batch.column("c").to_numpy() + 0.5, maxent.LEAVES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(maxent.LEAVES, dtype=np.int32)), pa.array(total)], names=["leaf", "mass"])

    mass = np.bincount(leaf, np.where(c > 0, c + 0.5, 0), maxent.LEAVES).astype(np.float64)
    for r in counts.where((F.col("n") < least) & (F.col("c") > 0)).select("token", "c").mapInArrow(run, "leaf int, mass double").groupBy("leaf").agg(F.sum("mass").alias("mass")).collect():
        mass[r.leaf] += r.mass
    mass[OWN_LEAF:] += 0.5
    return mass


def _leaves(docs: DataFrame, names: list[bytes], c: np.ndarray, leaf: np.ndarray) -> DataFrame:
    """Of each text its leaves (16-bit numbers), number of tokens, known tokens and sum of log10(c + 0.5) of those in
    the head, and its other tokens."""
    held = docs.sparkSession.sparkContext.broadcast((names, np.log10(c + 0.5), c > 0, leaf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs, known, leaf = held.value
        place = _Head(names)
        if not len(leaf):  # so that there is a place to look at
            logs, known, leaf = np.zeros(1), np.zeros(1, bool), np.zeros(1, np.int64)
        for whole in batches:
            for batch in slices(whole):
                parts = [tokens(x) for x in batch.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, parts)])
                at = np.fromiter(chain.from_iterable(map(place.__getitem__, own) for own in parts), np.int64, ends[-1])
                head = at >= 0
                own = np.where(head, leaf[np.maximum(at, 0)], -1 - at).astype("<u2")
                leaves = pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer((2 * ends).astype(np.int32).tobytes()), pa.py_buffer(own.tobytes())])
                of_text = lambda x: np.add.reduceat(np.where(head, x[np.maximum(at, 0)], 0), ends[:-1]) if len(parts) else x[:0]  # noqa: B023, E731
                others = np.flatnonzero(~head)
                every = list(chain.from_iterable(parts))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(others, ends).astype(np.int32)), pa.array([every[i] for i in others.tolist()], pa.binary()))
                made = [leaves, pa.array(np.diff(ends)), pa.array(of_text(known.astype(np.int64))), pa.array(of_text(logs)), lists]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *made], names=["doc_id", "held_out", "leaves", "n_tokens", "head_known", "head_log", "others"])

    out = docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, leaves binary, n_tokens long, head_known long, head_log double, others array<binary>")
    return materialize(out.withColumn("row", F.monotonically_increasing_id()))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for whole in batches:
        for batch in slices(whole, "leaves", 2 * TOGETHER):
            yield batch, [np.frombuffer(x, "<u2") for x in batch.column("leaves").to_pylist()]


def _counted(codes: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes, and how often each occurs (n times where given)."""
    if n is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.diff(np.append(first, len(codes))) if n is None else np.add.reduceat(n, first) if len(first) else n


def _planes(x: np.ndarray) -> bytes:
    """Bytes of numbers by significance, which Spark's codecs shorten well."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _numbers(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind)[:, 0]


def context_counts(rows: DataFrame) -> DataFrame:
    """block, codes, n: how often every context and leaf occurs in rows that aren't held out, a row a block of codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches):
            codes, n = _counted(maxent.positions(texts)[1])
            block, first = np.unique(codes >> np.uint32(32 - BLOCK_BITS), return_index=True)
            ends = np.append(first[1:], len(codes))
            parts = [[_planes(x[i:j]) for i, j in zip(first, ends, strict=True)] for x in (codes, n.astype("<u4"))] if len(codes) else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), *(pa.array(x, pa.binary()) for x in parts)], names=["block", "codes", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for block, codes, n in zip(*(batch.column(c).to_pylist() for c in ("block", "codes", "n")), strict=True):
                own = held.setdefault(block, [])
                own.append((_numbers(codes, "<u4"), _numbers(n, "<u4").astype(np.int64)))
                if sum(len(c) for c, _ in own[1:]) > max(200_000, len(own[0][0])):  # doubles at least before it is merged
                    held[block] = [_counted(*map(np.concatenate, zip(*own, strict=True)))]
        for block, own in held.items():
            codes, n = _counted(*map(np.concatenate, zip(*own, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_planes(codes)], pa.binary()), pa.array([_planes(n)], pa.binary())], names=["block", "codes", "n"])

    kind = "block int, codes binary, n binary"
    return materialize(rows.where(~F.col("held_out")).select("leaves").mapInArrow(run, kind).repartition("block").mapInArrow(merge, kind))


def train(rows: DataFrame, mass: np.ndarray) -> maxent.Model:
    """A model of the leaves of rows that aren't held out. A round sends each task's sums once, in blocks; what weights
    see is the same in all rounds and summed in the first. Blocks in which a task has nothing aren't sent."""
    model, seen, sizes = maxent.untrained(mass), None, maxent.ROWS
    blocks, counts = sum(sizes) // BLOCK, context_counts(rows)
    # a task sends sums for the whole model, so it should have many codes; there are 2^32 of them at most
    codes = counts.agg(F.sum(F.octet_length("codes"))).first()[0] or 0
    counts = counts.coalesce(1 + codes // (4 * TASK_CODES))
    for rate in RATES:
        held = rows.sparkSession.sparkContext.broadcast((model, seen is None))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            model, first = held.value
            kinds = [tuple(np.zeros((n, maxent.CLASSES)) for n in sizes) for _ in range(1 + first)]
            for batch in batches:
                for codes, n in zip(batch.column("codes").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    maxent.sums(model, _numbers(codes, "<u4"), _numbers(n, "<i8"), kinds[1] if first else None, kinds[0])
            for kind, levels in enumerate(kinds):
                for k, part in enumerate(np.concatenate(levels).reshape(blocks, -1)):
                    if part.any():
                        yield pa.RecordBatch.from_arrays([pa.array([kind * blocks + k], pa.int32()), pa.array([part.astype(np.float32).tobytes()], pa.binary())], names=["block", "sums"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for block, raw in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                    total[block] = total.get(block, 0.0) + np.frombuffer(raw, np.float32).astype(np.float64)
            for block, x in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], names=["block", "sums"])

        added = counts.select("codes", "n").mapInArrow(run, "block int, sums binary").repartition("block").mapInArrow(merge, "block int, sums binary").toArrow()
        whole = np.zeros((2 * blocks, BLOCK * maxent.CLASSES), np.float32)
        for block, raw in zip(added.column("block").to_pylist(), added.column("sums").to_pylist(), strict=True):
            whole[block] = np.frombuffer(raw, np.float32)
        levels = lambda x: tuple(np.split(x.reshape(-1, maxent.CLASSES), [sizes[0]]))
        seen = levels(whole[blocks:]) if seen is None else seen
        model = maxent.step(model, seen, levels(whole[:blocks]), rate, EASE)
        held.unpersist()
    return model


def score(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams) and score (the model), a row for each
    row of docs; scores are log10 probabilities of whole texts.

    A null text is empty and has one token, its end. A row without a doc_id is not held out and learns. Repeated rows
    learn and are scored each. Without training texts no token is known and the model is the unigram model, whose leaves
    are all alike. An empty table gives no rows; further columns are not looked at."""
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    d = slim(docs, "doc_id", "text").select("doc_id", out.alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counts = materialize(token_counts(d))
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    names, c, leaf, least = _head(counts, head)
    mass = _mass(counts, least, c, leaf)
    rows = _leaves(d, names, c, leaf)
    model = rows.sparkSession.sparkContext.broadcast((train(rows, mass), np.log10(np.maximum(mass, 1e-9))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, logs = model.value
        for batch, texts in _texts(batches):
            value = maxent.log_probabilities(own, texts) / np.log(10) - np.array([logs[t].sum() for t in texts])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("row", "doc_id", "held_out", "n_tokens", "head_known", "head_log")), pa.array(value)], names=["row", "doc_id", "held_out", "n_tokens", "head_known", "head_log", "of_leaves"])

    scored = rows.drop("others").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, head_known long, head_log double, of_leaves double")
    # tokens outside the head are at most 1/HEAD of all occurrences each, so no key of this join is large
    rare = rows.select("row", F.explode("others").alias("token")).join(counts.where(F.col("n") < least).select("token", "c"), "token")
    rare = rare.groupBy(F.col("row").alias("of")).agg(F.sum((F.col("c") > 0).cast("long")).alias("known"), F.sum(F.log10(F.col("c") + 0.5)).alias("log"))
    every = scored.join(rare, F.col("row") == F.col("of"), "left")
    own = F.col("head_log") + F.coalesce("log", F.lit(0.0))
    space = float(np.log10(total + 0.5 * (kinds + 1)))
    return every.select("doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (own - F.col("n_tokens") * space).alias("base_score"), (own + F.col("of_leaves")).alias("score"))
