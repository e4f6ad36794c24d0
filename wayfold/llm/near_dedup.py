"""MinHash near-duplicates by a signature-coordinate inverted join.

Documents with one shingle set are one class. A class has a signature of COORDINATES minima; (coordinate,
value) pairs are the tokens of an inverted index. Two classes that agree on at least MATCHES coordinates must
share one of the COORDINATES - MATCHES + 1 rarest pairs of either (prefix filtering), so only these are
posted. Within a posting list links are first sought between its centre and the members; components that
these links form are skipped afterwards (merge skipping): only members of different components meet again,
in blocks of bounded size, and only pairs that agree on MATCHES coordinates leave a block. Every link is
confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.byte_bpe import slices
from wayfold.llm.common import components, drop_tables, materialize, skew_join, slim, tables_so_far

#: With 64 coordinates and Jaccard similarity 0.8, fewer than 34 agree with probability 3e-6.
SHINGLE, PERCENT, COORDINATES, MATCHES = 4, 80, 64, 34
#: Slots of the table of frequencies by which pairs are ordered, a byte each on every executor: as many as half the
#: classes, within these bounds (64 MB), so that a slot counts some 128 pairs up to 130 million classes.
LEAST_SLOTS, MOST_SLOTS = 1 << 20, 1 << 26
#: Signatures that a task counts before it hands on its table of slots.
COUNTED = 200_000
#: So many ids are sent to all executors to pick their rows; more are joined by shuffling.
BROADCAST_IDS = 1_000_000
#: A posting list of a pair that n classes share is dealt out to n / BLOCK blocks.
BLOCK = 512


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _WordHash()
_A = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(20240607).integers(1, 2**63, COORDINATES, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; A-Z in lower case, ASCII blanks part words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    out = h[:n].copy()
    for k in range(1, size):
        out *= _A
        out ^= out >> np.uint64(29)
        out += h[k : k + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of COORDINATES multiplicative hashes, high 32 bits."""
    out = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(shingles), 4096):
        part = (shingles[i : i + 4096] ^ (shingles[i : i + 4096] >> np.uint64(31)))[None, :] * _SEEDS[:, None]
        np.minimum(out, (part >> np.uint64(32)).astype(np.uint32).min(axis=1), out=out)
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, cls (digest of the shingle set, null if empty), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, cls, sig = [], [], []
                for text in part.column("text").to_pylist():
                    s = shingle_set(text)
                    n.append(len(s))
                    cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sig.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "cls", "sig"])

    return slim(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, cls binary, sig binary")


_SLOT_KEYS = np.arange(COORDINATES, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def _slots(sig: np.ndarray, slots: int) -> np.ndarray:
    """Slot of each (coordinate, value) of signatures in rows; slots is a power of two."""
    h = (sig.astype(np.uint64) + _SLOT_KEYS) * _A
    return (h >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def frequencies(classes: DataFrame, slots: int | None = None) -> np.ndarray:
    """log2 of the number of classes by slot of their (coordinate, value) pairs, a byte a slot. Tasks count all their
    pairs and hand on the counts of slots, which an aggregate adds up."""
    total = classes.count()
    slots = slots or min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (total // 2).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.int64)
        for batch in batches:
            if batch.num_rows:
                counts += np.bincount(_slots(_matrix(batch.column("sig").to_pylist()), slots).ravel(), minlength=slots)
        at = np.flatnonzero(counts)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000].astype(np.int32)), pa.array(counts[at[i : i + 100_000]])], names=["slot", "n"])

    few = classes.select("sig").coalesce(max(12, total // COUNTED))  # fewer partial tables; reading signatures is light
    held = few.mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1")
    levels = np.zeros(slots, np.uint8)
    for batch in held.select("slot", F.floor(F.log2("n")).cast("int").alias("level")).toArrow().to_batches():
        levels[batch.column("slot").to_numpy()] = batch.column("level").to_numpy()
    return levels


def _matrix(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, COORDINATES)


KEEP = COORDINATES - MATCHES + 1


def _prefix(sig: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and levels of all pairs of signatures in rows, and the coordinates of the KEEP rarest, rarest first."""
    level = levels[_slots(sig, len(levels))]
    mixed = (sig.astype(np.uint64) + _SLOT_KEYS) * np.uint64(0xFF51AFD7ED558CCD)
    keys = mixed ^ (mixed >> np.uint64(33))
    order = np.argsort((level.astype(np.uint64) << np.uint64(56)) | (keys >> np.uint64(8)), axis=1, kind="stable")[:, :KEEP]
    return keys.view(np.int64), level, order


def postings(classes: DataFrame, levels: np.ndarray) -> DataFrame:
    """(key, salt, salts, coord, cls): each class under its KEEP rarest pairs."""
    table = classes.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                cls = batch.column("cls")
                keys, level, order = _prefix(_matrix(batch.column("sig").to_pylist()), table.value)
                rows = np.repeat(np.arange(len(keys)), KEEP)
                salts = np.maximum(1, (1 << np.take_along_axis(level, order, axis=1).ravel().astype(np.int64)) // BLOCK)
                own = np.array([int.from_bytes(c.as_py()[:4], "little") for c in cls], np.int64)[rows]
                yield pa.RecordBatch.from_arrays([pa.array(np.take_along_axis(keys, order, axis=1).ravel()), pa.array((own % salts).astype(np.int32)), pa.array(salts.astype(np.int32)), pa.array(order.ravel().astype(np.int32)), cls.take(pa.array(rows))], names=["key", "salt", "salts", "coord", "cls"])

    return classes.select("cls", "sig").mapInArrow(run, "key long, salt int, salts int, coord int, cls binary")


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that agree on MATCHES coordinates: collisions are counted on both signatures."""
    sig = classes.select(F.col("cls").alias("c"), "sig")
    one = materialize(skew_join(pairs, sig, "b", "c").select("a", "b", F.col("sig").alias("sb")))
    two = skew_join(one, sig, "a", "c").select("a", "b", "sb", F.col("sig").alias("sa"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_matrix(batch.column("sa").to_pylist()) == _matrix(batch.column("sb").to_pylist())).sum(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(same >= MATCHES))

    return materialize(two.mapInArrow(run, "a binary, b binary"))


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links: pairs with 100 * intersection >= PERCENT * union of their full sets."""
    ends = pairs.select(F.col("a").alias("e")).unionByName(pairs.select(F.col("b").alias("e"))).distinct()
    few = pairs.count() <= BROADCAST_IDS // 4  # then only the sets at hand move
    s = sets.select(F.col("cls").alias("c"), "shingles").join(F.broadcast(ends) if few else ends, F.col("c") == F.col("e"), "left_semi")
    one = materialize(skew_join(pairs, s, "b", "c").select("a", "b", F.col("shingles").alias("sb")))
    two = skew_join(one, s, "a", "c").select("a", "b", "sb", F.col("shingles").alias("sa"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return materialize(two.mapInArrow(run, "a binary, b binary"))


def _full_sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(cls, shingles) of the classes in reps (cls, rep): the shingle sets of their first documents' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingle_set(t).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["cls", "shingles"])

    reps = materialize(reps)
    ids = reps.select(F.col("rep").alias("doc_id"))
    own = slim(docs, "doc_id", "text").join(F.broadcast(ids) if reps.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    # a doc_id may stand on several rows: all their sets are made, one of each class stays
    return materialize(own.mapInArrow(run, "cls binary, shingles binary").join(reps.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]))


def _mixed(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the lists that hold several components, with root, their class's component, and main, that of
    the list's least class."""
    comp = materialize(lists.join(labels.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    mixed = comp.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min_by("root", "cls").alias("main")).where("lo != hi")
    return materialize(skew_join(comp, materialize(mixed.select(F.col("key").alias("k"), "main")), "key", "k").drop("k"))


def _strays(rows: DataFrame, classes: DataFrame, sets: DataFrame | None, levels: np.ndarray) -> DataFrame:
    """Links between classes of one list in different components, as many as join a block's components.

    Strays, the classes outside a list's main component, meet all members of all the list's blocks. Pairs
    that agree on MATCHES coordinates, taken from the list of the first coordinate under which both are
    posted, are compared on their sets (32 bits of each shingle's hash; the caller confirms on all bits).
    Nothing leaves a block but links, at most one less than the components in it. Without sets: the keys k of
    the lists in which any such pair is left to compare."""
    table = classes.sparkSession.sparkContext.broadcast(levels)
    rows = rows.join(classes.select(F.col("cls").alias("c"), "sig"), F.col("cls") == F.col("c")).drop("c")
    probe = sets is None
    small = None if probe else sets.select(F.col("cls").alias("d"), "shingles")

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = pa.array([(np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes() for x in batch.column("shingles")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _ROW), short], names=[*_ROW, "short"])

    rows = rows.withColumn("short", F.lit(None).cast("binary")) if probe else rows.join(small, F.col("cls") == F.col("d")).select(*_ROW, "shingles").mapInArrow(halve, "key long, salt int, salts int, coord int, cls binary, root binary, main binary, sig binary, short binary")
    # a member waits in its own block; a stray also goes to all blocks of its list
    own = F.struct(F.col("salt").alias("at"), F.lit(1).alias("side"))
    all_blocks = F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda at: F.struct(at.alias("at"), F.lit(0).alias("side")))
    places = F.when(F.col("root") != F.col("main"), F.concat(F.array(own), all_blocks)).otherwise(F.array(own))
    both = rows.withColumn("p", F.explode(places)).select("key", F.col("p.at").alias("salt"), F.col("p.side").alias("side"), "coord", "cls", "root", "sig", "short")
    both = both.repartition("key", "salt").sortWithinPartitions("key", "salt")

    def block(part: pa.Table) -> tuple[list[bytes], list[bytes]]:
        side = part.column("side").to_numpy()
        at_l, at_r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(at_l) or not len(at_r):
            return [], []
        sig, coord = _matrix(part.column("sig").to_pylist()), part.column("coord")[0].as_py()
        root = np.unique(np.array(part.column("root").to_pylist(), dtype=object), return_inverse=True)[1]
        posted = np.zeros(sig.shape, bool)
        np.put_along_axis(posted, _prefix(sig, table.value)[2], True, axis=1)
        top = list(range(root.max() + 1))

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        a, b, held = [], [], None
        for i in range(0, len(at_l), 64):
            own = at_l[i : i + 64]
            agree = sig[own][:, None, :] == sig[at_r][None, :, :]
            near = (agree.sum(axis=2) >= MATCHES) & (root[own][:, None] != root[at_r][None, :])
            if not near.any():
                continue
            x, y = np.nonzero(near)
            # the pair's first common list is another one
            earlier = (agree[x, y, :coord] & posted[own[x], :coord] & posted[at_r[y], :coord]).any(axis=1)
            near[x[earlier], y[earlier]] = False
            if probe:
                if near.any():
                    return [part.column("cls")[0].as_py()], [part.column("cls")[0].as_py()]
                continue
            if held is None:
                cls, raw = part.column("cls").to_pylist(), [np.frombuffer(v, np.uint32) for v in part.column("short").to_pylist()]
                sizes = np.array([len(v) for v in raw])
                ids = np.unique(np.concatenate(raw), return_inverse=True)[1]
                ends = np.r_[0, np.cumsum(sizes)]
                held = [ids[ends[k] : ends[k + 1]] for k in range(len(raw))]
                flags, flat, starts = np.zeros(ids.max() + 1, np.int32), np.concatenate([held[k] for k in at_r]), np.r_[0, np.cumsum(sizes[at_r])[:-1]]
            for k in np.flatnonzero(near.any(axis=1)):
                one = own[k]
                flags[held[one]] = 1
                common = np.add.reduceat(flags[flat], starts)
                flags[held[one]] = 0
                for m in np.flatnonzero(near[k] & (100 * common >= PERCENT * (sizes[one] + sizes[at_r] - common))):
                    p, q = find(root[one]), find(root[at_r[m]])
                    if p != q:
                        top[p] = q
                        a.append(min(cls[one], cls[at_r[m]])), b.append(max(cls[one], cls[at_r[m]]))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in _and_none(batches):
            if batch is not None:
                if not batch.num_rows:
                    continue
                new = pa.Table.from_batches([batch])
                held = pa.concat_tables([held, new]) if held is not None else new
            if held is None:
                continue
            held = held.combine_chunks()
            key, salt = held.column("key").to_numpy(), held.column("salt").to_numpy()
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
            ends = np.r_[starts[1:], len(key)]
            whole = len(starts) if batch is None else len(starts) - 1  # the last block may go on in the next batch
            of, a, b = [], [], []
            for lo, hi in zip(starts[:whole], ends[:whole], strict=True):
                if hi - lo > 1:
                    x, y = block(held.slice(lo, hi - lo))
                    of += [key[lo]] * len(x)
                    a += x
                    b += y
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["key", "a", "b"])
            held = held.slice(starts[-1]) if batch is not None else None

    found = both.mapInArrow(run, "key long, a binary, b binary")
    return materialize(found.select(F.col("key").alias("k")).distinct() if probe else found.select("a", "b").distinct())


_ROW = ("key", "salt", "salts", "coord", "cls", "root", "main", "sig")


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, slots: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included) and kept.

    Null, empty and blank texts have no shingles and no links. A class all of whose rows lack a doc_id has no
    links to others; its component_id is null and it is kept. Other rows without a doc_id share their class's
    component and are not kept. Equal rows are one class, so of several rows with one doc_id and text all are
    kept or none. An empty table gives no rows."""
    spark = docs.sparkSession
    start = tables_so_far()
    docs_sketch = materialize(sketch(docs))
    classes = materialize(docs_sketch.where("cls is not null").groupBy("cls").agg(F.min("sig").alias("sig"), F.min("doc_id").alias("rep")))
    levels = frequencies(classes, slots)
    posted = postings(classes, levels)
    # blocks are bounded, so that one exchange and a window serve where an aggregate and a join would take two
    block = Window.partitionBy("key", "salt")
    lists = posted.withColumns({"n": F.count(F.lit(1)).over(block), "own": F.min("cls").over(block)}).where("n > 1 or salts > 1")
    lists = materialize(lists)
    # the centre of a block with its members, the centre of the list with those of its blocks
    pairs = lists.select(F.col("own").alias("a"), F.col("cls").alias("b"))
    blocks = materialize(lists.where("salts > 1").select("key", "own").distinct())
    heads = blocks.groupBy("key").agg(F.min("own").alias("a"))
    pairs = pairs.unionByName(blocks.join(heads, "key").select("a", F.col("own").alias("b")))
    pairs = materialize(pairs.where("a != b").distinct())
    pairs = _agreeing(pairs, classes)

    reps = classes.select("cls", "rep")
    ends = lambda p: p.select(F.col("a").alias("cls")).unionByName(p.select(F.col("b").alias("cls"))).distinct()
    sets = _full_sets(docs, ends(pairs).join(reps, "cls"))
    links = _confirm(pairs, sets)
    # of a list with two members nothing is left to compare
    rows = _mixed(lists.where("n > 2 or salts > 1").select("key", "salt", "salts", "coord", "cls"), components(links))
    rows = materialize(rows.join(_strays(rows, classes, None, levels), F.col("key") == F.col("k"), "left_semi"))
    fresh = rows.select("cls").distinct().join(sets.select("cls"), "cls", "left_anti").join(reps, "cls")
    sets = sets.unionByName(_full_sets(docs, fresh))
    links = links.unionByName(_confirm(_strays(rows, classes, sets, levels), sets))
    labels = components(links).select(F.col("node").alias("cls"), "root")
    full = classes.join(labels, "cls", "left").select("cls", "rep", F.coalesce("root", "cls").alias("root"))
    full = materialize(full)
    least = materialize(full.groupBy("root").agg(F.min("rep").alias("component_id")).withColumnRenamed("root", "r"))
    of_class = materialize(skew_join(full, least, "root", "r").select(F.col("cls").alias("c"), "component_id"))
    drop_tables(start, (docs_sketch, of_class))
    out = skew_join(docs_sketch.select("doc_id", "n_shingles", "cls"), of_class, "cls", "c", "left")
    out = out.withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
