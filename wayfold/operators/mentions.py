"""Mentions of named entities in texts, and relations between what texts and tables say of them.

A name is found as its words in a row, one to LONGEST of them, whatever stands between the words. Where names overlap,
the leftmost wins, and of those that begin at one word the longest; the search goes on behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.functions.text import tokens
from wayfold.operators.knowledge import near
from wayfold.tables import small_enough, stored

#: Words of a name at most; bytes of names that are sent to every executor at most.
LONGEST, DICTIONARY_BYTES = 6, 64 << 20


def dictionary(names: DataFrame, key: str, name: str, longest: int = LONGEST) -> DataFrame:
    """entity_id, phrase (the words of the name, joined by blanks) and words (their number). Names without words or
    with more than `longest` are left out; a name that several entities have stands once for each."""
    own = names.select(F.col(key).alias("entity_id"), tokens(F.col(name)).alias("w"))
    return own.where(F.size("w").between(1, longest)).select("entity_id", F.array_join("w", " ").alias("phrase"), F.size("w").alias("words")).distinct()


def sentences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, sentence (from 0), text: parts between full stops, exclamation marks, question marks and line ends."""
    return docs.select(key, F.posexplode(F.split(text, r"[.!?\n]+")).alias("sentence", "text"))


class _Finder:
    """Names by their words, and for each first word the lengths of names that begin with it, longest first."""

    def __init__(self, phrases: list[str]):
        self.names = {tuple(p.split(" ")) for p in phrases}
        lengths: dict[str, set[int]] = {}
        for n in self.names:
            lengths.setdefault(n[0], set()).add(len(n))
        self.lengths = {w: sorted(own, reverse=True) for w, own in lengths.items()}

    def find(self, words: list[str]) -> Iterator[tuple[int, int]]:
        at, names, lengths = 0, self.names, self.lengths
        while at < len(words):
            step = 1
            for n in lengths.get(words[at], ()):
                if at + n <= len(words) and tuple(words[at : at + n]) in names:
                    yield at, n
                    step = n
                    break
            at += step


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("words", T.IntegerType())])))
def _leftmost(found: pd.Series) -> pd.Series:
    """Of (start, words), one for each start, those that are left when the leftmost win."""

    def choose(spans):
        end, out = 0, []
        for s in sorted(spans, key=lambda s: s["start"]):
            if s["start"] >= end:
                out.append(s)
                end = s["start"] + s["words"]
        return out

    return found.map(choose)


def _by_broadcast(docs: DataFrame, keys: list[str], phrases: DataFrame) -> DataFrame:
    """Spans found in one pass over the texts, without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(_Finder([r.phrase for r in phrases.collect()]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = held.value
        for batch in batches:
            row, start, size, phrase = [], [], [], []
            for i, words in enumerate(batch.column("w").to_pylist()):
                for at, n in finder.find(words or []):
                    row.append(i), start.append(at), size.append(n), phrase.append(" ".join(words[at : at + n]))
            own = [batch.column(k).take(pa.array(row, pa.int32())) for k in keys]
            yield pa.RecordBatch.from_arrays([*own, pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(phrase, pa.string())], names=[*keys, "start", "words", "phrase"])

    return docs.select(*keys, "w").mapInArrow(run, f"{kinds}, start int, words int, phrase string")


def _by_join(docs: DataFrame, keys: list[str], phrases: DataFrame) -> DataFrame:
    """Spans found by joining the runs of words with the names, for dictionaries that no executor should hold whole. Of
    a text only the spans that are names come together."""
    rows = stored(docs.select(*keys, "w").withColumn("row", F.monotonically_increasing_id()))
    lengths = [r.words for r in phrases.select("words").distinct().collect()] or [1]

    def runs(n: int) -> Column:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(n).alias("words"), F.array_join(F.slice("w", i + 1, n), " ").alias("phrase")))

    each = rows.select("row", F.inline(F.concat(*map(runs, lengths)))).join(phrases.select("phrase"), "phrase", "left_semi")
    spans = each.groupBy("row", "start").agg(F.max("words").alias("words")).groupBy("row").agg(F.collect_list(F.struct("start", "words")).alias("found"))
    return rows.join(spans.select("row", F.inline(_leftmost("found"))), "row").select(*keys, "start", "words", F.array_join(F.slice("w", F.col("start") + 1, F.col("words")), " ").alias("phrase"))


def link(docs: DataFrame, keys: list[str], text: str, names: DataFrame, most_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """keys, entity_id, start (word number from 0), words: every mention of a dictionary() name in every whole text. A
    mention of a name that several entities have gives a row for each; null texts have none; repeated rows have their
    mentions again. A small dictionary goes to the texts, a larger one meets their runs of words in a join."""
    words = docs.select(*keys, F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("w"))
    phrases = names.select("phrase", "words").distinct()
    small = small_enough(phrases, most_bytes, "phrase")
    found = (_by_broadcast if small else _by_join)(words, keys, phrases)
    own = names.select("phrase", "entity_id")
    # a name in every text is a large key; beside a small dictionary no row has to move
    return found.join(F.broadcast(own) if small and small_enough(own, most_bytes, "phrase", "entity_id") else own, "phrase").select(*keys, "entity_id", "start", "words")


# --- relations

RULE = "rel string, src_type string, dst_type string, sentences int, words int"


def text_relations(mentions: DataFrame, entities: DataFrame, rules: DataFrame, n_sentences: int) -> DataFrame:
    """Edges that texts give: src_type, src_id, rel, dst_type, dst_id, n, score, doc_id, from_sentence, to_sentence.

    mentions: doc_id, sentence, entity_id, start, words, from link() over sentences(). entities: entity_id, type. rules
    (RULE): a mention of src_type and one of dst_type, in any order, at most `sentences` sentences apart, and where
    words isn't null in one sentence with at most that many words between them. An entity has no relation to itself.
    n counts the pairs of sentences, score is ln(n * n_sentences / (sentences of one * sentences of the other)); the
    evidence is the first such pair (least doc_id, then sentences). Sentences meet only within the widest window."""
    m = stored(mentions.join(entities, "entity_id").select("doc_id", "sentence", "entity_id", "type", "start", (F.col("start") + F.col("words")).alias("end")))
    alone = m.groupBy("entity_id").agg(F.countDistinct("doc_id", "sentence").alias("f"))
    widest = rules.agg(F.max("sentences")).first()[0] or 0
    a = m.join(F.broadcast(rules.withColumnRenamed("src_type", "type")), "type").select("doc_id", F.col("sentence").alias("s"), F.col("entity_id").alias("src_id"), F.col("start").alias("a0"), F.col("end").alias("a1"), F.col("type").alias("src_type"), "rel", "dst_type", "sentences", F.col("words").alias("most"))
    reach = F.sequence(F.col("sentence") - widest, F.col("sentence") + widest)
    b = m.select("doc_id", "sentence", F.col("entity_id").alias("dst_id"), F.col("start").alias("b0"), F.col("end").alias("b1"), F.col("type").alias("dst_type"), F.explode(reach).alias("s"))
    gap = F.greatest(F.col("b0") - F.col("a1"), F.col("a0") - F.col("b1"))
    close = (F.abs(F.col("s") - F.col("sentence")) <= F.col("sentences")) & (F.col("most").isNull() | ((F.col("s") == F.col("sentence")) & (gap <= F.col("most"))))
    pairs = a.join(b, ["doc_id", "s", "dst_type"]).where(close & (F.col("src_id") != F.col("dst_id")))
    edge = ["src_type", "src_id", "rel", "dst_type", "dst_id"]
    where = F.struct("doc_id", F.least("s", "sentence").alias("x"), F.greatest("s", "sentence").alias("y"))
    units = pairs.groupBy(*edge, "doc_id", "s", "sentence").agg(F.min(where).alias("at"))
    edges = units.groupBy(*edge).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    edges = edges.join(alone.select(F.col("entity_id").alias("src_id"), F.col("f").alias("fa")), "src_id").join(alone.select(F.col("entity_id").alias("dst_id"), F.col("f").alias("fb")), "dst_id")
    score = F.round(F.log(F.col("n").cast("double") * float(n_sentences) / (F.col("fa").cast("double") * F.col("fb").cast("double"))), 6)
    return edges.select(*edge, "n", score.alias("score"), F.col("at.doc_id").alias("doc_id"), F.col("at.x").alias("from_sentence"), F.col("at.y").alias("to_sentence"))


def distance_relations(a: DataFrame, b: DataFrame, rel: str, km: float) -> DataFrame:
    """Edges between located entities (id as text, type, lat, lon) of a and b at most km apart, with the columns of
    text_relations; n is 1, score falls from 1 to 0.5 at km, and there is no text to show for them."""
    left, right = (x.select(F.struct("type", "id").alias("id"), "lat", "lon") for x in (a, b))
    pairs = near(left, right, km).where("a_id != b_id")
    none = lambda t: F.lit(None).cast(t)
    return pairs.select(F.col("a_id.type").alias("src_type"), F.col("a_id.id").alias("src_id"), F.lit(rel).alias("rel"), F.col("b_id.type").alias("dst_type"), F.col("b_id.id").alias("dst_id"), F.lit(1).cast("long").alias("n"), F.round(1 / (1 + F.col("km") / km), 6).alias("score"), none("long").alias("doc_id"), none("int").alias("from_sentence"), none("int").alias("to_sentence"))
