"""Mentions and relations against plain Python, and nearness at every latitude against all pairs."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from wayfold.functions.geo import haversine
from wayfold.operators import knowledge as kn
from wayfold.operators import mentions as mn
from wayfold.plans.queries import QUERIES


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def plain(rows, names):
    """rows (id, text), names (entity, name): (id, entity, start, words) of the leftmost longest names."""
    own = {}
    for e, name in names:
        if 1 <= len(words(name)) <= mn.LONGEST:
            own.setdefault(tuple(words(name)), set()).add(e)
    out = []
    for i, text in rows:
        w, at = words(text), 0
        while at < len(w):
            n = max((k for k in range(1, mn.LONGEST + 1) if tuple(w[at : at + k]) in own and at + k <= len(w)), default=0)
            out += [(i, e, at, n) for e in own.get(tuple(w[at : at + n]), ())]
            at += n or 1
    return sorted(out, key=repr)


NAMES = [("e1", "Blue House"), ("e2", "blue house hotel"), ("e3", "House"), ("e4", "hotel, by the sea!"), ("e5", "HOUSE"), ("e6", "Hà Nội"), ("e7", "a b c d e f"), ("e8", "a b c d e f g"), ("e9", ""), ("e10", None), ("e11", "日本"), ("e12", "1st")]
ODD = [(1, "The Blue-House hotel by the sea; house."), (2, None), (3, ""), (4, "..."), (5, "house " * 9000), (6, "in HÀ NỘI 1st 日本"), (6, "in HÀ NỘI 1st 日本"), (None, "blue house house"), (7, "a b c d e f g h"), (8, "blue house hotel by the"), (9, "x" * 60_000)]


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_leftmost_longest_by_broadcast_and_by_join(spark, most_bytes):
    rng = random.Random(4)
    letters = "abcd"
    names = [*NAMES, *{(f"r{k}", " ".join(rng.choice(letters) for _ in range(rng.randrange(1, 7)))) for k in range(60)}]
    rows = [*ODD, *[(k, " ".join(rng.choice(letters + "e.") for _ in range(rng.randrange(60)))) for k in range(100, 160)]]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = mn.link(d, ["doc_id"], "text", mn.dictionary(spark.createDataFrame(names, "id string, name string"), "id", "name"), most_bytes)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain(rows, names)
    assert mn.link(d.limit(0), ["doc_id"], "text", mn.dictionary(spark.createDataFrame(names, "id string, name string"), "id", "name"), most_bytes).count() == 0


def test_no_names_no_mentions(spark):
    d = spark.createDataFrame(ODD, "doc_id long, text string")
    assert mn.link(d, ["doc_id"], "text", mn.dictionary(spark.createDataFrame([], "id string, name string"), "id", "name")).count() == 0


def test_relations_by_sentences_and_words(spark):
    text = "Blue House offers tours. Tours by night are quiet! The market is far. Quiet tours and the Blue House"
    d = spark.createDataFrame([(1, text), (2, "Tours. Blue House? market"), (3, None)], "doc_id long, text string")
    names = mn.dictionary(spark.createDataFrame([("h", "blue house"), ("t", "tours"), ("m", "market"), ("q", "quiet")], "id string, name string"), "id", "name")
    kinds = spark.createDataFrame([("h", "hotel"), ("t", "activity"), ("m", "area"), ("q", "tag")], "entity_id string, type string")
    rules = spark.createDataFrame([("OFFERS", "hotel", "activity", 1, None), ("IN", "hotel", "area", 1, None), ("HAS", "activity", "tag", 0, 2)], mn.RULE)
    parts = mn.sentences(d, "doc_id", "text")
    got = {(r.src_id, r.rel, r.dst_id): (r.n, r.score, r.doc_id, r.from_sentence, r.to_sentence) for r in mn.text_relations(mn.link(parts, ["doc_id", "sentence"], "text", names), kinds, rules, 10).collect()}
    # hotel and tours: (0,0), (0,1), (3,3) of text 1 and (1,0) of text 2; in three sentences the one, in four the other
    score = lambda n, a, b: round(math.log(n * 10 / (a * b)), 6)
    assert got == {("h", "OFFERS", "t"): (4, score(4, 3, 4), 1, 0, 0), ("h", "IN", "m"): (2, score(2, 3, 2), 1, 2, 3), ("t", "HAS", "q"): (1, score(1, 4, 2), 1, 3, 3)}


def test_all_rules_give_edges(spark):
    found = {r[0] for r in QUERIES["relation_edges"](spark, "/root/testdata/sf0.01").select("rel").distinct().collect()}
    assert found == {"OFFERS", "LOCATED_IN", "HAS_TAG", "NEAR"}


@pytest.mark.parametrize("km", [0.5, 80.0, 2500.0, 12_000.0])
def test_near_equals_all_pairs_everywhere(spark, km):
    rng = random.Random(int(km))
    spread = 60 if km > 100 else 0.02 * km
    hubs = [(0, 0), (90, 0), (-90, 0), (89.9, 179.99), (-89.5, -179.99), (62, 179.9), (72, 10), (84, -179.95), (45, 7), (30, 180), (59.999, -180)]
    pts = [(i, max(-90.0, min(90.0, a + rng.uniform(-spread, spread))), o + rng.uniform(-spread, spread) / max(0.01, math.cos(math.radians(a)))) for i, (a, o) in enumerate(rng.choice(hubs) for _ in range(220))]
    pts = [(i, a, (o + 180) % 360 - 180) for i, a, o in pts] + [(900, 90.0, 12.0), (901, -90.0, 5.0), (902, None, 1.0), (903, 1.0, None), (904, 0.0, 180.0), (905, 0.0, -180.0)]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    rows = [(r.a_id, r.b_id) for r in kn.near(df, df, km).collect()]
    x, y = df.toDF("a", "lat1", "lon1"), df.toDF("b", "lat2", "lon2")
    want = {(r.a, r.b) for r in x.crossJoin(y).where(haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")) <= km).collect()}
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 226
