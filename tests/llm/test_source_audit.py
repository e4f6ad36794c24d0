"""The source audit against a version in plain Python, and the selection against sorting."""

import random
import re
from collections import Counter, defaultdict

import oracle
import pytest

from wayfold.llm import source_audit
from wayfold.llm.common import materialize
from wayfold.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, g long, value string, rank int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, top=200):
    """rows of (lang, source, text)."""
    docs = [(lang or "", source or "", Counter(TERM.findall((text or "").translate(SMALL)))) for lang, source, text in rows]
    out, groups = set(), defaultdict(set)
    for lang, source, _ in docs:
        groups[lang].add(source)
    for lang, sources in groups.items():
        own = [d for d in docs if d[0] == lang]
        seen, of = Counter(), defaultdict(Counter)
        for _, source, c in own:
            seen.update(c.keys())
            of[source].update(c)
        kept = sorted(t for t, k in seen.items() if k >= 3)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        every = share(sum(of.values(), Counter()))
        p = {s: share(of[s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted(((sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((f(p[s][t], every[t]), t) for t in kept if of[s][t] and p[s][t] > every[t]), key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, s, "pair", o, v, k) for k, (v, o) in enumerate(pairs, 1)} | {(lang, s, "term", t, v, k) for k, (v, t) in enumerate(terms[:top], 1)}
    return out


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed", range(3))
def test_selection_equals_sorting(spark, seed):
    rng = random.Random(seed)
    rows = {(g, rng.choice([0, 1, 7, 4095, 4096, 10**9, 10**18, rng.randrange(2**60)]), "".join(rng.choice(["a", "b", "ab", "é", "日", "aaaaaaaa", "\U0001f600"]) for _ in range(rng.randrange(9)))) for g in "xyz" for _ in range({"x": 900, "y": 60, "z": 5}[g])}
    rows = list({(g, i): (g, v, i) for g, v, i in sorted(rows)}.values())
    df = materialize(spark.createDataFrame(rows, "g string, value long, item string"))
    for k in (1, 5, 40, 300):
        want = {r for g in "xyz" for r in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2].encode()))[:k]}
        assert got(source_audit.top_values(df, k)) == want


def test_odd_rows(spark):
    rows = [("en", "a", "The cat, the CAT; the end"), ("en", "b", "the cat's-eye"), ("en", "b", "the cat"), ("en", "b", "the cat"), ("en", "c", None), ("en", None, "the É x\x00y"), (None, None, None), ("fr", "a", "é É é"), ("fr", "b", "é è"), ("fr", "b", " é "), ("de", "only", "ein"), ("", "", "the"), ("en", "a", "w" * 50_000 + " " + "cat " * 30_000), ("日", "本", "日本 日本"), ("日", "語", "日本"), ("日", "語", "日本 ab"), ("xx", "b ", "u"), ("xx ", "b", "u")]
    own = [(None if k % 3 else 7, text, lang, source, 1, "t", 3, "v", 9) for k, (lang, source, text) in enumerate(rows)]
    df = spark.createDataFrame(own, SCHEMA)
    want = plain(rows)
    assert got(source_audit.audit(df)) == want and any(r[2] == "term" for r in want)
    assert got(source_audit.audit(df, 1)) == plain(rows, 1)
    assert source_audit.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ties_and_many_rows_by_plain_python(spark):
    rng = random.Random(5)
    words = [a + b for a in "abcdefghijklmnop" for b in ("x", "yy", "é", "zzz", "q", "r")]
    rows = [(rng.choice(["en", "de"]), f"s{min(4, int(rng.expovariate(1)))}", " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for _ in range(300)]
    df = spark.createDataFrame([(t, lang, s) for lang, s, t in rows], "text string, lang string, source string")
    assert got(source_audit.audit(df, 10)) == plain(rows, 10)


def test_query_equals_sql(spark, sf):
    assert oracle.compare(QUERIES["op13_source_audit"](spark, sf), oracle.connect(sf), ORACLES["op13_source_audit"]) == ""
