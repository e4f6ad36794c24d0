"""Personal data: fixed patterns, and identifiers that bootstrapped contexts discover.

The fixed patterns' matches are the seeds, and so are tokens that look drawn at random (SHAPES), as keys do. Every token
of SHORTEST characters with DIGITS_LEAST digits or more is an instance; the words around it are its lexical patterns.
Spark scores the bipartite graph: a pattern by its labelled instances, known ones against dates, times, amounts and
failed card numbers (until they become known), an instance by its confident patterns, until nothing changes. Unlabelled
instances count neither way, but where they are more than half as many as the tokens that are known by their shape or by
patterns, or these are fewer than DERIVED, these don't count for the pattern: only fixed patterns' matches may vouch for
many others. Tokens that confident patterns point at and that the fixed patterns don't cover become spans of
kind `id`; a token of such a shape is none by its shape alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.byte_bpe import slices
from wayfold.llm.common import materialize, skew_join, slim

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# runs are taken whole (possessive), and a run's inside is no new start: as leftmost greedy matching has it, in linear time
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")

#: An instance: a token of these lengths with that many digits. A pattern is believed from so many distinct seeds
#: and such a share of known ones among its labelled ones on, with PRIOR more against it; an instance from such a score on.
SHORTEST, LONGEST, DIGITS_LEAST = 6, 128, 4
SUPPORT, CONFIDENT, PRIOR = 3, 0.9, 0.3
#: Tokens known by their shape or by patterns back a pattern only together with so many.
DERIVED = 5
#: Evidence against a pattern: dates, times, decimals, grouped thousands, dotted numbers, and runs of 16 digits or more (no
#: seeds, so that they failed the cards' test).
QUANTITY = re.compile(r"[0-9]{1,4}([-/.])[0-9]{1,2}\1[0-9]{1,4}(?:T[0-9:.]+Z?)?|[0-9]{1,2}(?::[0-9]{2}){1,2}|[0-9]+[.,][0-9]+|[0-9]{1,3}(?:[.,'][0-9]{3})+(?:[.,][0-9]+)?|[0-9]+(?:\.[0-9]+){2,}|[0-9](?:-?[0-9]){15,}")

#: Tokens that look drawn at random: long hexadecimal numbers, and long runs of small and large letters and digits.
SHAPES = re.compile(r"(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,}|(?=[^0-9]*[0-9])(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])[A-Za-z0-9+/_-]{24,}={0,2}")


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, end := m.end()))
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind; leftmost, non-overlapping within a kind; matches that fail their test are dropped."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    found["email"] = emails(text)
    found["ip"] = [m.span() for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return found


BLANK = frozenset(" \t\n\x0b\x0c\r")
QUOTES = "\"'`“”„«»"
CONTEXT = 48  # characters on either side in which the words around an instance are looked for


def instances(text: str, spans: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int, bool, list[str]]]:
    """(token, start, end, seed, patterns): the seeds, and the tokens with enough digits that no seed touches."""
    seeds = sorted({s for kind in KINDS for s in spans[kind]})
    out = [(text[a:b], a, b, True, _contexts(text, a, b)) for a, b in seeds]
    end, k = 0, 0
    for m in DIGITS.finditer(text):
        if m.start() < end:
            continue
        a, b = m.span()
        while a > end and text[a - 1] not in BLANK and m.start() - a <= LONGEST:
            a -= 1
        while b < len(text) and text[b] not in BLANK and b - a <= LONGEST:
            b += 1
        end = b
        while k < len(seeds) and seeds[k][1] <= a:
            k += 1
        if any(s[0] < b and s[1] > a for s in seeds[k : k + 4]):
            continue
        while a < b and not text[a].isalnum():
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if SHORTEST <= b - a <= LONGEST and sum("0" <= c <= "9" for c in text[a:b]) >= DIGITS_LEAST:
            out.append((text[a:b], a, b, False, _contexts(text, a, b)))
    return out


def _contexts(text: str, a: int, b: int) -> list[str]:
    """Lexical patterns: the word before, the two before, the word after, and the pair around. Quotes are no part of a
    word, and a pattern without any letter or digit says nothing."""
    words = lambda part: [w for w in (x.strip(QUOTES) for x in part.lower().split()) if w]
    left, right = words(text[max(0, a - CONTEXT) : a])[-2:], words(text[b : b + CONTEXT])[:1]
    out = []
    if left:
        out.append(f"{left[-1]} _")
    if len(left) > 1:
        out.append(f"{left[0]} {left[1]} _")
    if right:
        out.append(f"_ {right[0]}")
    if left and right:
        out.append(f"{left[-1]} _ {right[0]}")
    return [p for p in out if any(c.isalnum() for c in p)]


FOUND = "row_key string, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, instances array<struct<token:binary,start:int,end:int,seed:boolean,shaped:boolean,amount:boolean,patterns:array<string>>>"


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and instances of each text, in one pass. row_key tells rows with different texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    text = text or ""
                    spans = base_spans(text)
                    joined = ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])
                    found = [{"token": hashlib.blake2b(t.encode(), digest_size=12).digest(), "start": a, "end": b, "seed": s, "shaped": not s and SHAPES.fullmatch(t) is not None, "amount": not s and QUANTITY.fullmatch(t) is not None, "patterns": p} for t, a, b, s, p in instances(text, spans)]
                    key = hashlib.blake2b(f"{doc_id}:{text}".encode(), digest_size=16).hexdigest() if found else None
                    rows.append({"row_key": key, "doc_id": doc_id, **{f"n_{k}": len(spans[k]) for k in KINDS}, "base": joined, "instances": found})
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return slim(docs, "doc_id", "text").mapInArrow(run, FOUND)


_ARROW = pa.schema([("row_key", pa.string()), ("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base", pa.string()), ("instances", pa.list_(pa.struct([("token", pa.binary()), ("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("shaped", pa.bool_()), ("amount", pa.bool_()), ("patterns", pa.list_(pa.string()))])))])


def bootstrap(found: DataFrame) -> DataFrame:
    """Tokens (digest, score) that confident patterns discover. Edges of the graph are distinct (pattern,
    token) pairs; a pattern's sums and a token's product are aggregates, so frequent words cost a row a task."""
    own = found.select(F.explode("instances").alias("i")).select("i.token", "i.seed", (F.col("i.seed") | F.col("i.shaped")).alias("told"), "i.amount", F.explode("i.patterns").alias("pattern"))
    edges = materialize(own.groupBy("pattern", "token").agg(F.max("seed").alias("seed"), F.max("told").alias("told"), F.max("amount").alias("amount")))
    # patterns without enough seeds are never believed
    backed = edges.where("told").groupBy("pattern").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= SUPPORT).select(F.col("pattern").alias("p"))
    edges = materialize(skew_join(edges, materialize(backed), "pattern", "p").drop("p"))
    scores = materialize(edges.groupBy("token").agg(F.max(F.col("told").cast("double")).alias("score")).select(F.col("token").alias("t"), "score", F.lit(0.0).alias("reach")))
    before = -1
    # a reached token stays reached, as patterns only gain; so the number of them tells when nothing changes
    while (known := scores.where(F.col("reach") >= CONFIDENT).count()) != before:
        before = known
        weighed = edges.join(scores, F.col("token") == F.col("t")).withColumns({"known": F.col("score") >= CONFIDENT, "derived": (F.col("score") >= CONFIDENT) & ~F.col("seed")})
        many = lambda c: F.sum(c.cast("int"))
        patterns = weighed.groupBy(F.col("pattern").alias("p")).agg(many(F.col("known")).alias("known"), many(F.col("derived")).alias("derived"), many(~F.col("known") & ~F.col("amount")).alias("open"), many(~F.col("known") & F.col("amount")).alias("against"))
        backing = F.col("known") - F.when((F.col("derived") < DERIVED) | (2 * F.col("open") > F.col("derived")), F.col("derived")).otherwise(0)
        patterns = patterns.where(backing >= SUPPORT).select("p", (backing / (backing + F.col("against") + PRIOR)).alias("confidence")).where(F.col("confidence") >= CONFIDENT)
        believed = skew_join(edges, materialize(patterns), "pattern", "p")
        reached = believed.groupBy("token").agg(F.max("confidence").alias("now"))
        now = F.coalesce("now", F.lit(0.0))
        scores = materialize(scores.join(reached, F.col("t") == F.col("token"), "left").select("t", F.greatest("score", now).alias("score"), F.greatest("reach", now).alias("reach")))
    seeds = edges.where("seed").select(F.col("token").alias("t")).distinct()
    return materialize(scores.where(F.col("reach") >= CONFIDENT).join(seeds, "t", "left_anti"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans (all of them) and row_key, for every row.

    Null texts are empty and have no spans; equal rows get equal results; a null doc_id stays null; an empty
    table gives no rows. Offsets are code points, ends exclusive. Overlaps between kinds stand."""
    found = materialize(scan(docs))
    new = bootstrap(found)
    places = found.where("size(instances) > 0").select("row_key", F.explode("instances").alias("i")).where("not i.seed").select("row_key", "i.token", "i.start", "i.end")
    hits = skew_join(materialize(places.distinct()), new, "token", "t")
    added = hits.groupBy("row_key").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("start", "end"))), lambda s: F.concat(F.lit("id:"), s["start"], F.lit(":"), s["end"])), ",").alias("added"))
    # most rows have no instances and no key: they take no part in the join, where null keys would meet in a task
    out = found.where("row_key is not null").drop("instances").join(added, "row_key", "left")
    out = out.unionByName(found.where("row_key is null").drop("instances").withColumn("added", F.lit(None).cast("string")))
    spans = F.array_join(F.filter(F.array(F.col("base"), F.coalesce("added", F.lit(""))), lambda s: s != ""), ",")
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"), "row_key")


def mask(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets (overlapping spans by the first one's), n_chars
    made anew where the table has it. All other columns and all rows stay."""
    spans = find(docs).where("spans != ''").select("row_key", "spans").dropDuplicates(["row_key"])
    names = docs.columns
    keyed = slim(docs, *names)
    schema = T.StructType([*docs.schema.fields, T.StructField("__key", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [hashlib.blake2b(f"{d}:{t or ''}".encode(), digest_size=16).hexdigest() for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.string())], names=[*names, "__key"])

    joined = keyed.mapInArrow(run, schema).join(spans.withColumnsRenamed({"row_key": "__row", "spans": "__spans"}), F.col("__key") == F.col("__row"), "left").drop("__key", "__row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist(), strict=True):
                if own:
                    out, end = [], 0
                    for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in own.split(","))):
                        if a >= end:
                            out += [text[end:a], f"[{kind}]"]
                        end = max(end, b)
                    text = "".join([*out, text[end:]])
                texts.append(text)
            columns = {n: batch.column(n) for n in names} | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    out = joined.mapInArrow(cut, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in names else out
