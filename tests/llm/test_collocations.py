"""Collocations against a version in plain Python, and the sketch that never misses."""

import random
import re
from collections import Counter, defaultdict

import oracle
import pytest

from wayfold.llm import collocations
from wayfold.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, phrase string, f long, key string"
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def count(rows):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(SMALL)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f, n


def plain(rows, top=2000):
    out = set()
    f, total = count([(lang if lang is not None else "und", t) for lang, t in rows])
    for lang, c in f.items():
        own, kept = {p: a for p, a in c.items() if len(p) > 1 and a >= 10}, []
        for p, a in own.items():
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in own.items()):
                continue
            s, _, left, right = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), left, right))
        out |= {(lang, k, p.decode(), -a, left, right, total[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)}
    return out


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = ["the", "The", "of", "new", "york", "city", "é", "É", "日本", "a\x01b", "x\x1fy", "don't", "a-b", "zz"]
    mark = [" "] * 12 + ["  ", "\t", ". ", ", ", "\n", ";", "!", "\x0b", "?:"]
    text = lambda n: "".join(rng.choice(words) + rng.choice(mark) for _ in range(n))
    out = [(rng.choice(["en", "fr", None]), text(rng.randrange(80))) for _ in range(150)]
    return [*out, ("en", "new york city " * 4000), ("en", None), ("fr", ""), ("fr", " . ,;"), ("de", "one two"), ("und", "new york " * 30), ("", "u v w " * 15), ("x\ny", "u v w " * 15), *[("en", "same words here")] * 12, ("en", "w" * 70_000)]


def test_equals_plain_python(spark, rows):
    df = spark.createDataFrame([(None if k % 4 else 1, t, lang, "s", 0, "p", 1, "k") for k, (lang, t) in enumerate(rows)], SCHEMA).repartition(3)
    want = plain(rows)
    assert got(collocations.mine(df)) == want and {r[0] for r in want} == {"en", "fr", "und", "", "x\ny"}
    assert got(collocations.mine(df, 5)) == plain(rows, 5)
    assert collocations.mine(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("limits", [{}, {"CHUNK": 50, "KNOWN": 20}])
def test_sketch_loses_nothing_however_narrow(spark, rows, monkeypatch, limits):
    """The least width, where most cells are shared by many phrases once a block is shrunk; small chunks as well."""
    for name, value in (limits | {"BLOCK": 64}).items():
        monkeypatch.setattr(collocations, name, value)
    f, n = count([(lang if lang is not None else "und", t) for lang, t in rows])
    want = {(lang, " ".join(p), len(p), a) for lang, c in f.items() for p, a in c.items() if a >= 10} | {(lang, "", 0, k) for lang, k in n.items()}
    d = spark.createDataFrame([(lang if lang is not None else "und", (t or "").encode()) for lang, t in rows], "lang string, text binary")
    for width in (64, 1 << 20):
        assert {r for r in got(collocations.frequent(d, width)) if r[3]} == {w for w in want if w[3]}


def test_products_beyond_64_bits(spark, monkeypatch):
    counts = spark.createDataFrame([("en", "", 0, 4 * 10**12), ("en", "a", 1, 3 * 10**12 + 7), ("en", "b", 1, 2 * 10**12 + 1), ("en", "a b", 2, 10**12 + 3)], "lang string, phrase string, words int, f long")
    monkeypatch.setattr(collocations, "frequent", lambda d, width: counts)
    a, left, right = 10**12 + 3, 3 * 10**12 + 7, 2 * 10**12 + 1
    assert got(collocations.mine(spark.createDataFrame([], SCHEMA))) == {("en", 1, "a b", a, left, right, 4 * 10**12, 1_000_000 * a * a // (left * right))}


def test_query_equals_sql(spark, sf):
    for at in (sf, "/root/testdata/sf0.01"):
        assert oracle.compare(QUERIES["op12_collocations"](spark, at), oracle.connect(at), ORACLES["op12_collocations"]) == ""
