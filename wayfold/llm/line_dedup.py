"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, union-find; one line stays of each
component, the first by (doc_id, line).

A line's shingles are its runs of WIDTH characters (a shorter line: itself); a character beyond the first 65,536
code points counts as two. Equal lines are one class. Signatures are taken over all runs of WIDTH bytes of a line,
which are its shingles but for letters of several bytes. Bands post a class under BANDS keys of ROWS minima each:
at similarity 0.8 some key is shared with probability 1 - (1 - 0.8^3)^7 = 0.993, at 0.9 with 0.9999. In each list
the members are compared with its centre and with one member of each group that shares further minima, and then every
member outside a list's largest component with all members of other components, as far as AGREE minima agree. So a
pair on one list is missed only where fewer do. The likeliest pair of every two components comes first, so that the
pairs within a grown component need no look. A pair whose bitmaps of shingles differ in more places than its sets may
is never looked at: that loses nothing. A bit tells whether an odd number of the line's shingles fall on it, so that
shingles of both lines cancel out, and bitmaps of long lines part pairs as well.

The functions run Spark jobs as they build their result: intermediate tables are written in the shared folder.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import components, drop_tables, materialize, skew_join, slim, tables_so_far
from wayfold.llm.text_columns import BLANKS

WIDTH, PERCENT, BANDS, ROWS = 8, 80, 7, 3
MINIMA = BANDS * ROWS
#: A minimum is the least of the runs' hashes after an exclusive or with its constant: the run next to a random point.
POINTS = [random.Random(f"minimum {i}").getrandbits(32) - (1 << 31) for i in range(MINIMA)]
#: Of 21 minima, three bits of each, so many have to agree; at similarity 0.8 fewer do with probability 2e-4.
AGREE = 10
#: Words of 64 bits in a class's bitmap (a power of two); a shingle's hash turns one bit over.
WORDS = 16
BITMAP = ("runs", *[f"w{w}" for w in range(WORDS)])
#: Neighbouring runs that the signature takes in one row, and shingles that the bitmap does.
STEP, PLACED = 32, 8
#: So many keys are sent to all executors to pick their lines or lists; more are joined by shuffling.
BROADCAST_KEYS = 1_000_000
#: In each of GROUPINGS ways, members of a list that share SHARED more minima are a group.
GROUPINGS, SHARED = 8, 6
SHARES = [sum(7 << 3 * i for i in random.Random(f"grouping {g}").sample(range(MINIMA), SHARED)) for g in range(GROUPINGS)]
#: Rounds in which of any two components one pair is compared; what lies between components then is compared in full.
ROUNDS = 1
#: Members of a list that the full comparison holds against each other in one place.
BLOCK = 500


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 0), own, the normalised line (lower case, blanks trimmed at the ends), and key, its 64-bit
    digest, of all lines with a word."""
    split = slim(docs, "doc_id", "text").select("doc_id", F.posexplode(F.split(F.lower("text"), "\n")).alias("line", "own"))
    # trimming walks through the line, so that only those with a blank at an end are trimmed
    blank = (F.ascii("own") <= 32) | (F.substring(F.col("own").cast("binary"), -1, 1) <= F.unhex(F.lit("20")))
    own = split.select("doc_id", "line", F.when(blank, F.btrim("own", F.lit(BLANKS))).otherwise(F.col("own")).alias("own")).where("own != ''")
    return own.select("doc_id", "line", F.xxhash64("own").alias("key"), "own")


def _rank() -> Column:
    """Order of documents: a null doc_id comes last."""
    return F.coalesce("doc_id", F.lit((1 << 63) - 1))


def hashed(bytes_of: DataFrame) -> DataFrame:
    """key, rank, i, h0, h1, ...: hashes of STEP neighbouring runs a row, of (key, rank, u, last), a line's bytes and the
    place of its last run."""
    starts = bytes_of.select("key", "rank", "u", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(STEP))).alias("i"))
    # beyond the end the last run is taken again, which changes no minimum; a plain if is less code than least()
    return starts.select("key", "rank", "i", *[F.expr(f"hash(substring(u, if(last - i > {k}, i + {k}, last), {WIDTH}))").alias(f"h{k}") for k in range(STEP)])


def signatures(lines: DataFrame) -> DataFrame:
    """A row per class: key, n_lines, first_doc, bands and sketch, three bits of each minimum. A row of the aggregate
    takes STEP runs, so that its buffers are touched once for these."""
    bytes_of = lines.select("key", _rank().alias("rank"), F.col("own").cast("binary").alias("u")).withColumn("last", F.greatest(F.lit(1), F.octet_length("u") - (WIDTH - 1)))
    hashes = hashed(bytes_of)
    minima = [F.min(F.least(*[F.col(f"h{k}").bitwiseXOR(F.lit(p)) for k in range(STEP)])).alias(f"m{i}") for i, p in enumerate(POINTS)]
    made = hashes.groupBy("key").agg(F.count_if(F.col("i") == 1).alias("n_lines"), F.min("rank").alias("first_doc"), *minima)
    bands = F.array(*[F.xxhash64(F.lit(b), *[F.col(f"m{b * ROWS + r}") for r in range(ROWS)]) for b in range(BANDS)])
    bits = [F.shiftleft(F.col(f"m{i}").bitwiseAND(F.lit(7)).cast("long"), 3 * i) for i in range(MINIMA)]
    sketch = bits[0]
    for b in bits[1:]:
        sketch = sketch.bitwiseOR(b)
    return made.select("key", "n_lines", "first_doc", bands.alias("bands"), sketch.alias("sketch"))


def agreeing(a: str, b: str) -> Column:
    """Minima whose three bits are equal in two sketches."""
    x = F.col(a).bitwiseXOR(F.col(b))
    differ = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseAND(F.lit(sum(1 << 3 * i for i in range(MINIMA))))
    return MINIMA - F.bit_count(differ)


def bitmaps(texts: DataFrame) -> DataFrame:
    """k, runs, w0 to w15 of (k, own): the number of the line's shingles, and the bits on which an odd number of their
    hashes fall."""
    # dealt by k, so that counting needs no exchange of the shingles
    sets = texts.repartition("k").select("k", shingle_set("own").alias("s"))
    starts = sets.select("k", "s", F.explode(F.sequence(F.lit(0), F.size("s") - 1, F.lit(PLACED))).alias("i"))
    hashes = starts.select("k", F.size("s").cast("long").alias("n"), *[F.get("s", F.col("i") + j).alias(f"h{j}") for j in range(PLACED)])
    # the upper four bits name the word, the lower six the bit; beyond the end there are nulls, which are on no word
    placed = [(F.col(f"word{j}"), F.col(f"bit{j}")) for j in range(PLACED)]
    words = [F.shiftrightunsigned(f"h{j}", 65 - WORDS.bit_length()).alias(f"word{j}") for j in range(PLACED)]
    hashes = hashes.select("k", "n", *words, *[F.expr(f"shiftleft(1L, cast(h{j} & 63 as int))").alias(f"bit{j}") for j in range(PLACED)])
    odd = lambda w: reduce(Column.bitwiseXOR, [F.when(word == w, bit).otherwise(F.lit(0).cast("long")) for word, bit in placed])
    return hashes.groupBy("k").agg(F.max("n").alias("runs"), *[F.bit_xor(odd(w)).alias(f"w{w}") for w in range(WORDS)])


def may_link(other: str) -> Column:
    """False only for pairs that are surely below PERCENT: on every place where the bitmaps differ falls a shingle of one
    line alone, and of two sets with n and m members at most (n + m) * (100 - PERCENT) / (100 + PERCENT) are. The
    second line's columns end with `other`."""
    apart = sum((F.bit_count(F.col(f"w{w}").bitwiseXOR(F.col(f"w{w}{other}"))) for w in range(1, WORDS)), F.bit_count(F.col("w0").bitwiseXOR(F.col(f"w0{other}"))))
    return apart * (100 + PERCENT) <= (F.col("runs") + F.col(f"runs{other}")) * (100 - PERCENT)


def _few(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has up to BROADCAST_KEYS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _lists(classes: DataFrame) -> DataFrame:
    """(key, sketch, bands, place, band, n, centre): the lists of several (n) classes. place is that of band among the
    class's bands, centre the list's least key."""
    posted = classes.select("key", "sketch", "bands", F.posexplode("bands").alias("place", "band"))
    many = posted.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("centre")).where("n > 1")
    many = materialize(many.select(F.col("band").alias("l"), "n", "centre"))
    if many.count() <= BROADCAST_KEYS:
        return materialize(posted.join(F.broadcast(many), F.col("band") == F.col("l")).drop("l"))
    # the largest lists (so few that all executors can hold their names) are kept out of the exchange
    largest = many.agg(F.sum("n")).first()[0] // BROADCAST_KEYS + BLOCK
    hot = F.broadcast(many.where(F.col("n") > largest))
    cold = posted.join(hot, F.col("band") == F.col("l"), "left_anti").join(many.where(F.col("n") <= largest), F.col("band") == F.col("l"))
    return materialize(cold.unionByName(posted.join(hot, F.col("band") == F.col("l"))).drop("l"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often lambdas within body refer to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _runs(own: str) -> Column:
    """Hashes of all runs of WIDTH characters (a shorter line: itself), found in two-byte units."""
    units = F.encode(F.col(own), "UTF-16BE")
    starts = lambda u: F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(u) - (2 * WIDTH - 1)), F.lit(2))
    return _let(units, lambda u: F.transform(starts(u), lambda i: F.xxhash64(F.substring(u, i, F.lit(2 * WIDTH)))))


def shingle_set(own: str) -> Column:
    """Hashes of the shingles of a line."""
    return F.array_distinct(_runs(own))


def _ends(pairs: DataFrame) -> DataFrame:
    """end: the classes of pairs (a, b), each once."""
    return pairs.select(F.explode(F.array("a", "b")).alias("end")).distinct()


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links: pairs (a, b, size; size is that of both shingle sets together) that have Jaccard similarity of PERCENT or
    more. The lines move, being far smaller than their sets, and only those of the pairs where these are few."""
    start = tables_so_far()
    ends = materialize(_ends(pairs))
    if ends.count() <= BROADCAST_KEYS:
        texts = texts.join(F.broadcast(ends), F.col("k") == F.col("end"), "left_semi")
    one = materialize(skew_join(pairs, texts, "b", "k").select("a", "b", "size", F.col("own").alias("ob")))
    met = skew_join(one, texts, "a", "k").select("a", "b", "size", F.size(F.array_intersect(_runs("own"), _runs("ob"))).alias("both"))
    links = materialize(met.where(100 * F.col("both") >= PERCENT * (F.col("size") - F.col("both"))).select("a", "b"))
    drop_tables(start, (links,))
    return links


def _first_pairs(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) that agree on AGREE minima, of each member with its list's centre and with one member of each of its
    groups: their number grows with that of the members."""
    start = tables_so_far()
    # a group of a list of two is the list; a class is on a list, and so in a group, once
    dealt = lists.where("n > 2").select("key", "sketch", F.explode(F.array(*[F.xxhash64("band", F.lit(g), F.col("sketch").bitwiseAND(F.lit(m))) for g, m in enumerate(SHARES)])).alias("group"))
    dealt = materialize(dealt)
    # numbers are picked one by one, as a struct would be sorted for
    order = F.xxhash64("key", "group")
    one = dealt.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min_by("key", order).alias("centre"), F.min_by("sketch", order).alias("sb")).where("n > 1")
    one = materialize(one.select(F.col("group").alias("g"), "centre", "sb"))
    in_groups = skew_join(dealt, one, "group", "g").select("key", "sketch", "centre", "sb")
    centres = materialize(lists.where("key = centre").select(F.col("band").alias("l"), F.col("sketch").alias("sb")))
    in_lists = skew_join(materialize(lists.where("key != centre").select("key", "sketch", "centre", "band")), centres, "band", "l").select("key", "sketch", "centre", "sb")
    alike = in_lists.unionByName(in_groups).where((F.col("key") != F.col("centre")) & (agreeing("sketch", "sb") >= AGREE))
    pairs = materialize(alike.select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b")).distinct())
    drop_tables(start, (pairs,))
    return pairs


def _linkable(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """(a, b, size) of the pairs that may link."""
    start = tables_so_far()
    one = materialize(skew_join(pairs, maps, "a", "k").drop("k"))
    other = maps.select("k", *[F.col(c).alias(f"{c}_b") for c in BITMAP])
    out = materialize(skew_join(one, other, "b", "k").where(may_link("_b")).select("a", "b", (F.col("runs") + F.col("runs_b")).alias("size")))
    drop_tables(start, (out,))
    return out


def _compared(lists: DataFrame, pairs: DataFrame) -> DataFrame:
    """end: the classes whose lines may still be compared. On a list of two only its pair is, if it agrees."""
    return lists.where("n > 2").select(F.col("key").alias("end")).unionByName(_ends(pairs)).distinct()


def _spanning(lists: DataFrame, maps: DataFrame, labels: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs (a, b, agree, size) on one list that lie in different components, agree on AGREE minima and may link, but for
    those of done, each from the first list that both are on. A list is dealt over blocks of some BLOCK members by their keys; members outside
    its largest component go to all of them."""
    start = tables_so_far()
    named = labels.withColumnsRenamed({"node": "x"})
    # of a list of two the pair is already compared
    held = materialize(lists.where("n > 2").join(_few(named), F.col("key") == F.col("x"), "left").select("band", "place", "bands", "key", "sketch", F.coalesce("root", "key").alias("root")))
    sizes = held.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    several = sizes.groupBy("band").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("root", "n").alias("main")).where("parts > 1")
    several = materialize(several.select(F.col("band").alias("l"), "main", F.ceil(F.col("all") / BLOCK).alias("blocks")))
    # the bitmaps come last, to members of the lists that are left
    left = held.join(F.broadcast(several), F.col("band") == F.col("l")) if several.count() <= BROADCAST_KEYS else skew_join(held, several, "band", "l")
    held = materialize(materialize(left.drop("l")).join(maps, F.col("key") == F.col("k")).drop("k"))
    members = held.select(F.col("band").alias("l"), F.pmod("key", "blocks").alias("block"), F.col("key").alias("other"), F.col("root").alias("its"), F.col("sketch").alias("sb"), F.col("bands").alias("bb"), *[F.col(c).alias(f"{c}_b") for c in BITMAP])
    strays = held.where("root != main").withColumn("own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sure = agreeing("sketch", "sb")
    before = F.arrays_overlap(F.slice("bands", F.lit(1), F.col("place")), F.slice("bb", F.lit(1), F.col("place")))
    met = strays.join(members, (F.col("band") == F.col("l")) & (F.col("own") == F.col("block")) & (F.col("root") != F.col("its")) & ((F.col("its") == F.col("main")) | (F.col("key") < F.col("other"))) & (sure >= AGREE) & may_link("_b") & ~before)
    met = met.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"), sure.alias("agree"), (F.col("runs") + F.col("runs_b")).alias("size"))
    out = materialize(met.join(done, ["a", "b"], "left_anti"))
    drop_tables(start, (out,))
    return out


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b, agree, size, ra, rb: the pairs whose ends lie in different components, and these."""
    named = _few(labels)
    for end, root in (("a", "ra"), ("b", "rb")):
        pairs = pairs.drop(root).join(named.select(F.col("node").alias("x"), F.col("root").alias(root)), F.col(end) == F.col("x"), "left").withColumn(root, F.coalesce(root, end)).drop("x")
    return materialize(pairs.where("ra != rb"))


def _join_components(pairs: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """labels after all links among pairs."""
    for k in range(ROUNDS + 1):
        pairs = _between(pairs, labels)
        if pairs.isEmpty():
            break
        if k < ROUNDS:
            order = F.col("agree") * (1 << 48) + F.shiftrightunsigned(F.xxhash64("a", "b"), 16)
            of_two = pairs.groupBy(F.least("ra", "rb").alias("p"), F.greatest("ra", "rb").alias("q"))
            tried = materialize(of_two.agg(*[F.max_by(c, order).alias(c) for c in ("a", "b", "size")]).select("a", "b", "size"))
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        else:
            tried = pairs.select("a", "b", "size")
        found = _confirm(tried, texts)
        labels = materialize(components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)))
    return labels


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, labels): doc_id, line, rank and key of all lines; a row per class; and (node, root) of the
    classes that are linked with others."""
    start = tables_so_far()
    lines = lines_of(docs)
    classes = materialize(signatures(lines))
    lists = _lists(classes)
    pairs = _first_pairs(lists)
    # the second and last pass over the texts: places of all lines, and the text of a class that may be compared
    wanted = materialize(_compared(lists, pairs))
    wanted = materialize(classes.join(_few(wanted), F.col("key") == F.col("end"), "left_semi").select(F.col("key").alias("k"), "first_doc"))
    rows = lines.withColumn("rank", _rank()).join(_few(wanted), F.col("key") == F.col("k"), "left")
    rows = materialize(rows.select("doc_id", "line", "rank", "key", F.when(F.col("rank") == F.col("first_doc"), F.col("own")).alias("own")))
    texts = materialize(rows.where("own is not null").select(F.col("key").alias("k"), "own").dropDuplicates(["k"]))
    maps = materialize(bitmaps(texts))
    pairs = _linkable(pairs, maps)
    drop_tables(start, (classes, lists, rows, texts, maps, pairs))
    labels = materialize(components(_confirm(pairs, texts)))
    pairs = _spanning(lists, maps, labels, pairs)
    drop_tables(start, (classes, rows, texts, labels, pairs))
    labels = _join_components(pairs, labels, texts)
    drop_tables(start, (classes, rows, labels))
    return rows.select("doc_id", "line", "rank", "key"), classes, labels


def classes(docs: DataFrame) -> DataFrame:
    """(node, root) of the line classes that are linked with others."""
    start = tables_so_far()
    labels = _linked(docs)[2]
    drop_tables(start, (labels,))
    return labels


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line: the lines that go, as a line of their component stands earlier by (doc_id, line).

    Blank lines never go. Null and empty texts have no lines. A null doc_id ranks last; rows with one doc_id
    share their line numbers, so that of equal rows under one doc_id each keeps its first occurrences. An empty
    table gives no rows."""
    start = tables_so_far()
    gone = _gone(*_linked(docs))
    drop_tables(start, (gone,))
    return gone


def _gone(rows: DataFrame, own: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, line of all lines but the first of each component; takes what _linked gives."""
    named = labels.select(F.col("node").alias("k"), "root")
    roots = materialize(own.join(_few(named), F.col("key") == F.col("k"), "left").select("key", "n_lines", "first_doc", F.coalesce("root", "key").alias("root")).where("n_lines > 1 or root != key or k is not null"))
    first = materialize(roots.groupBy("root").agg(F.sum("n_lines").alias("n"), F.min("first_doc").alias("first_doc")).where("n > 1").select(F.col("root").alias("r"), F.col("first_doc").alias("head_doc")))
    of_key = materialize(skew_join(roots, first, "root", "r").select(F.col("key").alias("k"), "root", "head_doc"))
    many = rows.join(F.broadcast(of_key), F.col("key") == F.col("k")) if of_key.count() <= BROADCAST_KEYS else skew_join(rows, of_key, "key", "k")
    many = materialize(many.select("doc_id", "line", "rank", "root", "head_doc"))
    near = many.where("rank = head_doc")
    head = materialize(near.groupBy("root").agg(F.min("line").alias("head_line")).withColumnRenamed("root", "r"))
    late = skew_join(near, head, "root", "r").where("line != head_line").select("doc_id", "line")
    return materialize(many.where("rank != head_doc").select("doc_id", "line").unionByName(late).distinct())


def removed(docs: DataFrame) -> DataFrame:
    """doc_id and gone, the sorted numbers of the lines that go, for documents that lose any."""
    return repeated_lines(docs).groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("gone"))


def remove_lines(docs: DataFrame) -> DataFrame:
    """docs without the repeated lines, n_chars made anew where the table has it. All rows and columns stay, whatever
    their names; a text that loses all its lines becomes empty; null texts stay null."""
    gone = materialize(removed(docs))
    # few numbers go to the texts, so that these stay where they are
    numbers = gone.agg(F.sum(F.size("gone"))).first()[0] or 0
    gone = F.broadcast(gone) if numbers <= BROADCAST_KEYS else gone
    # the table's columns travel as one, so that none of them clashes with the join's own
    out = docs.select(F.struct("*").alias("row")).join(gone, F.col("row.doc_id").eqNullSafe(F.col("doc_id")), "left")
    left = F.array_join(F.filter(F.transform(F.split("row.text", "\n"), lambda x, i: F.when(~F.array_contains("gone", i), x)), lambda x: x.isNotNull()), "\n")
    text = F.when(F.col("gone").isNotNull() & F.col("row.text").isNotNull(), left).otherwise(F.col("row.text"))
    out = out.withColumn("text", text)
    made = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("row.n_chars").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
