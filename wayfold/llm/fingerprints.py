"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low-order bits.

Each shingle is hashed once. Its top bits choose one of BINS bins, and a bin keeps its least hash. An empty
bin takes the value of the first non-empty bin in a fixed pseudo-random order of its own (optimal
densification: every empty bin draws anew, so equal sets draw alike). Of every value the low BITS bits are
kept; two unequal values agree on them by chance with probability 2^-BITS, which `likeness` corrects for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import materialize, slim
from wayfold.llm.text_columns import shingle_hashes, with_word_hashes

SHINGLE, BINS, BITS = 5, 128, 8
_TOP = 64 - (BINS.bit_length() - 1)
#: Consecutive documents are looked up within so many ids; the groups' edges are exchanged between them.
GROUP_IDS = 1024
BROADCAST_EDGES = 500_000


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`: BINS bytes, one a bin (empty binary for a text without words). text has no nulls."""
    keep = [c for c in df.columns]
    df = with_word_hashes(df.withColumn("__t", F.lower(text)), "__t", "__h").drop("__t")
    df = df.withColumn("__s", F.array_sort(F.array_distinct(shingle_hashes("__h", SHINGLE)))).drop("__h")
    top = lambda x: F.shiftright(x, _TOP)  # noqa: E731  signed, so that sorted hashes lie bin by bin
    s = F.col("__s")
    df = df.withColumn("__f", F.filter(s, lambda x, i: (i == 0) | (top(x) != top(F.get(s, i - F.lit(1)))))).drop("__s")
    df = df.withColumn("__b", F.transform("__f", lambda x: top(x).cast("int")))
    f, b = F.col("__f"), F.col("__b")
    low = lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))

    def borrowed(own: Column) -> Column:
        # the place of bin x in the order of bin `own` leads, its value follows in the low bits
        ranked = F.transform(f, lambda x: F.xxhash64(own, top(x)).bitwiseAND(F.lit(-(1 << BITS)).cast("long")).bitwiseOR(low(x)))
        return low(F.array_min(ranked))

    bins = F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)), lambda own: F.coalesce(low(F.get(f, F.array_position(b, own).cast("int") - 1)), borrowed(own)))
    full = F.when(F.size(f) == BINS, F.transform(f, low)).otherwise(bins)
    packed = F.unhex(F.array_join(F.transform(full, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return df.withColumn(out, F.when(F.size(f) == 0, F.unhex(F.lit(""))).otherwise(packed)).select(*keep, out)


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two fingerprints, 0 to 1. Two empty ones: 1,
    one empty: 0."""
    x, y = (F.split(F.regexp_replace(F.hex(c), "(..)", "$1 "), " ") for c in (a, b))
    agree = F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(-1), lambda n, v: n + v)  # the last part is empty on both
    chance = 2.0**-BITS
    raw = (agree / F.lit(float(BINS)) - chance) / (1 - chance)
    return F.when(F.col(a) == F.col(b), 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), raw))


def _edges(ids: DataFrame) -> DataFrame:
    """(first_id, to_group): the least id of each group of ids goes to the group before it, the very first to the
    last group. Groups are chained within groups of groups, and these among each other: no step sorts all."""
    firsts = ids.groupBy(F.floor(F.col("key") / GROUP_IDS).alias("g")).agg(F.min("key").alias("first_id"))
    firsts = materialize(firsts.withColumn("s", F.floor(F.col("g") / GROUP_IDS)))
    supers = firsts.groupBy("s").agg(F.max("g").alias("last_g"))
    chain = Window.partitionBy(F.lit(0)).orderBy("s")  # one short list: ids / GROUP_IDS**2, and the null ids' stand-in
    supers = supers.withColumns({"before": F.lag("last_g").over(chain)})
    supers = supers.withColumn("before", F.coalesce("before", F.max("last_g").over(Window.partitionBy(F.lit(0)))))
    inner = firsts.withColumn("prev", F.lag("g").over(Window.partitionBy("s").orderBy("g")))
    return materialize(inner.join(supers.select("s", "before"), "s").select("first_id", F.coalesce("prev", "before").alias("to_group")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited and near_next.

    The edited text is the text with its last quarter replaced by as many first characters of the next
    document, by ascending doc_id and then text; the last document is followed by the first. Null texts are
    empty; an empty text has an empty fingerprint. Rows without a doc_id come first in the order, and rows
    with one doc_id follow each other by their text. A single row is followed by itself; no rows give none."""
    base = slim(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    base = base.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 62))))
    edges = _edges(base.select("key"))
    small = edges.count() <= BROADCAST_EDGES
    base = with_fingerprint(base, "text", "fp")
    marked = base.join(F.broadcast(edges) if small else edges, F.col("key") == F.col("first_id"), "left")
    places = F.array_compact(F.array(F.struct(F.floor(F.col("key") / GROUP_IDS).alias("g"), F.lit(0).alias("ghost")), F.when(F.col("to_group").isNotNull(), F.struct(F.col("to_group").alias("g"), F.lit(1).alias("ghost")))))
    rows = marked.select("doc_id", "key", "text", "fp", F.explode(places).alias("at")).select("doc_id", "key", "text", "fp", "at.g", "at.ghost")
    order = Window.partitionBy("g").orderBy("ghost", "key", "text")
    rows = rows.withColumns({"next_text": F.lead("text").over(order), "next_fp": F.lead("fp").over(order)}).where("ghost = 0")
    n = F.char_length("text")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", F.concat(F.substring("text", F.lit(1), n - F.floor(n / 4).cast("int")), F.substring("next_text", F.lit(1), F.floor(n / 4).cast("int"))).alias("edited"))
    rows = with_fingerprint(rows, "edited", "efp")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.lower(F.hex("fp")).alias("fingerprint"), F.lower(F.hex("efp")).alias("edited_fingerprint"),
        likeness("fp", "efp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
    )
