"""Source divergence audit: how the word use of each source departs from its language and from the other sources.

Shares of terms are whole numbers (1 + a billionth part, rounded down), smoothed by one occurrence of each kept term, so
that every value is exact. Values between two sources are sums over all kept terms of the language, but only terms that
one of the two has are looked at: a term that neither has gives the same value, the pair's baseline. Terms are ranked by
radix selection: histograms over twelve bits of the value at a time find the value of each group's kth term, and terms
that share that value are parted by two of their bytes at a time, so that no group's terms are ever sorted whole.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.byte_bpe import slices
from wayfold.llm.common import materialize, slim

#: A term is kept in a language if so many of its documents have it; so many terms of a group are ranked.
LEAST_DOCS, TOP = 3, 200
#: Bits of a value, and of one step of the selection; bytes of a term in one step among equal values.
VALUE_BITS, STEP_BITS, STEP_BYTES = 60, 12, 2
#: Occurrences that a task counts at once.
CHUNK = 1_000_000
#: Parts that rows of a language are dealt into where they meet its sources.
SALTS = 64

#: Letters A to Z become small ones, other bytes from 0x80 stay, all others part terms. A code point beyond ASCII is
#: bytes from 0x80 only, so terms of bytes are terms of code points.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents that have it): one row a group and term."""

    def counted(held: dict) -> pa.RecordBatch:
        lang, source, term, n, d = [], [], [], [], []
        for (own_lang, own_source), (every, once) in held.items():
            in_docs = Counter(once)
            for t, k in Counter(every).items():
                lang.append(own_lang), source.append(own_source), term.append(t), n.append(k), d.append(in_docs[t])
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["lang", "source", "term", "n", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(lambda: ([], [])), 0
        for whole in batches:
            for batch in slices(whole):
                for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                    words = text.translate(_FOLD).split()
                    every, once = held[lang, source]
                    every += words
                    once += set(words)
                    size += len(words)
                    if size >= CHUNK:
                        yield counted(held)
                        held.clear()
                        size = 0
        yield counted(held)

    raw = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    parts = raw.mapInArrow(run, "lang string, source string, term binary, n long, d long")
    return parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + terms)); decimals hold products of more than 64 bits."""
    whole = lambda c: c.cast("decimal(38,0)")
    return F.lit(1).cast("long") + F.call_function("div", whole(count + 1) * F.lit(10**9).cast("decimal(10,0)"), whole(total + terms))


def departure(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def top_values(rows: DataFrame, k: int) -> DataFrame:
    """Of rows (g, value from 0 to under 2^60, item), a written table in which items of a group differ, the k of each
    group that come first by value descending and UTF-8 bytes of item ascending; smaller groups stay whole.

    state has a row for each group of more than k rows: the leading bits (later bytes) of its kth row and how many
    rows with exactly these are still wanted."""
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    state = materialize(sizes.where(F.col("n") > k).select("g", F.lit(0).cast("long").alias("lead"), F.lit(k).cast("long").alias("need")))

    def step(live: DataFrame, digit: Column, down: bool) -> DataFrame:
        """g, need, the digit in which the kth row lies, rows with it, and how many of these are wanted."""
        bins = live.groupBy("g", "need", digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("g").orderBy(F.col("digit").desc() if down else F.col("digit").asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bins = bins.withColumn("upto", F.sum("n").over(before))
        return bins.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need"))).withColumn("need", F.col("need") - F.col("upto") + F.col("n"))

    for shift in range(VALUE_BITS - STEP_BITS, -1, -STEP_BITS):
        live = rows.join(state, "g").where(F.shiftright("value", shift + STEP_BITS) == F.col("lead"))
        cut = step(live, F.shiftright("value", shift).bitwiseAND((1 << STEP_BITS) - 1), True)
        joined = cut.withColumnRenamed("need", "left").join(state.select("g", "lead"), "g")
        state = materialize(joined.select("g", (F.col("lead") * (1 << STEP_BITS) + F.col("digit")).alias("lead"), F.col("left").alias("need"), "n"))
    # lead is now the kth value; among rows that have it, hexadecimal digits stand in the order of bytes
    limits = state.select("g", F.col("lead").alias("least"))
    part = lambda width: F.hex(F.substring(F.col("item").cast("binary"), 1, width))
    tied = state.select("g", F.col("lead").alias("value"), F.lit("").alias("lead"), "need", "n")
    ends, width = [tied.where("n = need").select("g", F.lit(None).cast("string").alias("last"), F.lit(0).alias("width"))], 0
    open_ = materialize(tied.where("n > need"))
    while not open_.isEmpty():
        width += STEP_BYTES
        live = rows.join(open_.select("g", "value", "lead", "need"), ["g", "value"]).where(part(width - STEP_BYTES) == F.col("lead"))
        cut = materialize(step(live, part(width), False).join(open_.select("g", "value"), "g"))
        ends.append(cut.where("n = need").select("g", F.col("digit").alias("last"), F.lit(width).alias("width")))
        open_ = cut.where("n > need").select("g", "value", F.col("digit").alias("lead"), "need", "n")
    last = ends[0]
    for more in ends[1:]:
        last = last.unionByName(more)
    bounded = rows.join(limits.join(last, "g"), "g", "left")
    in_tie = (F.col("value") == F.col("least")) & (F.col("last").isNull() | (F.hex(F.expr("substring(CAST(item AS BINARY), 1, width)")) <= F.col("last")))
    return bounded.where(F.col("least").isNull() | (F.col("value") > F.col("least")) | in_tie).select("g", "value", "item")


def audit(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: every other source of the language, by departure of the
    group's shares from that source's, summed over the kept terms. Part `term`: the terms that the group uses more than
    its language does, the first `top`.

    Null text, lang and source count as ''. Every row is a document: repeated rows and rows without a doc_id count
    each, doc_id is not looked at, nor are further columns. A group without terms has pairs (its shares are the
    baseline) and no terms; a language without kept terms has pairs of value 0. An empty table gives no rows."""
    d = slim(docs, "lang", "source", "text").fillna("", ["lang", "source", "text"])
    counts = materialize(term_counts(d))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("d").alias("docs")).where(F.col("docs") >= LEAST_DOCS).drop("docs")
    own = materialize(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "in_lang"))
    langs = own.groupBy("lang", "term").agg(F.first("in_lang").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = d.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "lang_total", "terms"])
    key = F.concat(F.length("lang"), F.lit(" "), F.col("lang"), F.col("source"))
    some = F.col("terms") > 0
    base = F.when(some, share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(1)
    groups = materialize(groups.select(key.alias("g"), "lang", "source", "total", "lang_total", "terms", base.alias("base")))
    # terms are many and groups few, so a join on the group has large keys: its rows stay where they are if groups fit
    # into a broadcast by their size in bytes (Spark checks it), and are dealt anew by its skew handling if not
    at = groups.select("lang", "source", "g", "total", "lang_total", "terms", "base")
    used = own.join(at, ["lang", "source"]).select("g", "lang", "source", "term", "base", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("in_lang"), F.col("lang_total"), F.col("terms")).alias("q"))
    used = materialize(used)
    above = materialize(used.where("p > q").select("g", departure(F.col("p"), F.col("q")).alias("value"), F.col("term").alias("item")))
    ranked = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col("value").desc(), F.col("item").asc()))
    terms = top_values(above, top).withColumn("rank", ranked(["g"])).join(groups.select("g", "lang", "source"), "g").withColumn("part", F.lit("term"))
    pairs = _pairs(groups, used).withColumn("rank", ranked(["lang", "source"])).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(terms.select(*columns))


def _pairs(groups: DataFrame, used: DataFrame) -> DataFrame:
    """lang, source, item (another source), value: sums of departures over all kept terms of the language.

    The baseline counts all terms as if neither source had them. A term that a source has puts that right against
    the other's baseline, and a term that both have puts right what it was counted twice. Terms with one share are
    counted together where they meet all other sources; sources meet each other term by term only where both have it."""
    a = groups.select("lang", "source", "base", "terms")
    b = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("other"))
    start = a.join(b, "lang").where("source != item").select("lang", "source", "item", (F.col("terms") * departure(F.col("base"), F.col("other"))).alias("value"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    alike = used.groupBy("lang", "source", "base", "p").agg(F.count(F.lit(1)).alias("n"))
    met = alike.withColumn("salt", F.pmod(F.hash("source", "p"), F.lit(SALTS))).join(b.select("*", salts), ["lang", "salt"]).where("source != item")
    there = F.col("n") * (departure(F.col("p"), F.col("other")) - departure(F.col("base"), F.col("other")))
    back = F.col("n") * (departure(F.col("other"), F.col("p")) - departure(F.col("other"), F.col("base")))
    one = met.select("lang", F.inline(F.array(F.struct("source", "item", there.alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), back.alias("value")))))
    x = used.select("lang", "term", "source", "base", "p")
    y = used.select("lang", "term", F.col("source").alias("item"), F.col("base").alias("other"), F.col("p").alias("q"))
    twice = departure(F.col("p"), F.col("q")) - departure(F.col("p"), F.col("other")) - departure(F.col("base"), F.col("q")) + departure(F.col("base"), F.col("other"))
    both = x.join(y, ["lang", "term"]).where("source != item").groupBy("lang", "source", "item").agg(F.sum(twice).alias("value"))
    parts = start.unionByName(one.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))).unionByName(both)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT i) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
t AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS own, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (coalesce(t.n, 0) + v.v) AS p, 1 + 1000000000 * (kept.n + 1) // (v.n + v.v) AS q FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE own > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pair
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM term) r WHERE rank <= 200
"""
