"""Near-equal texts against all pairs of sets, and how much is written for them."""

import random
from pathlib import Path

import numpy as np
import pytest

from wayfold.operators import dedup


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent):
    first = {}
    for key, text in sorted(rows):
        first.setdefault(text, key)
    sets = {key: shingle_set(text) for text, key in first.items() if text}
    links = {key: sum(k != key and bool(s) and 100 * len(s & t) >= percent * len(s | t) for k, t in sets.items()) for key, s in sets.items()}
    return {(key, first[text], links.get(first[text], 0)) for key, text in rows}


def texts(seed):
    """Near copies of three texts, texts with a passage that all share, short ones, copies, an empty and two null ones."""
    rng = random.Random(seed)
    some = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    out, passage = [], some(30)
    for size in (12, 60, 200):
        base = some(size)
        for _ in range(30):
            words = list(base)
            for _ in range(rng.randrange(5)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(400)}"
            out.append(" ".join(words[: len(words) - rng.randrange(3)]))
    out += [" ".join(some(rng.randrange(60)) + passage + some(rng.randrange(20))) for _ in range(60)]
    out += [" ".join(passage[: rng.randrange(1, 9)]) for _ in range(20)] + rng.sample(out, 20) + ["", None, None]
    rng.shuffle(out)
    return list(enumerate(out, 1))


@pytest.mark.parametrize("small", [False, True])
def test_links_equal_all_pairs_whatever_the_cells(spark, monkeypatch, small):
    if small:  # every text in the sample, cells of few pairs, several rounds
        monkeypatch.setattr(dedup, "SAMPLE", 1)
        monkeypatch.setattr(dedup, "CELL_PAIRS", 5)
        monkeypatch.setattr(dedup, "CELL_SHINGLES", 300)
        monkeypatch.setattr(dedup, "PLACES", 400)
    rows = texts(7 + small)
    got = {tuple(r) for r in dedup.near_equal(spark.createDataFrame(rows, "i long, t string"), "i", "t").collect()}
    assert {r for r in got if dict(rows)[r[0]] is not None} == {r for r in brute(rows, 80) if dict(rows)[r[0]] is not None}
    assert sum(r[2] for r in got) > 500
    assert {r[2] for r in got if not dict(rows)[r[0]]} == {0}


def test_sets_that_are_like_none_are_not_written(spark, monkeypatch):
    written, own = [], dedup.stored

    def stored(df):
        out = own(df)
        written.append(sum(p.stat().st_size for p in Path(out.stored_at.removeprefix("file:")).rglob("*.parquet")))
        return out

    monkeypatch.setattr(dedup, "stored", stored)
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(2000))) for i in range(100)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(2)]
    got = {tuple(r) for r in dedup.near_equal(spark.createDataFrame(rows, "i long, t string"), "i", "t").collect()}
    assert {r for r in got if r[2]} == {(0, 0, 1), (1000, 1000, 1), (1, 1, 1), (1001, 1001, 1)}
    assert sum(written) < 8 * 2000 * len(rows) // 4


def test_products_by_parts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200))) for _ in range(40)]
    expected = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for width in (7, 4096):
        got = dedup._products(sets, width)
        alone = [i for i in range(40) for j in range(40) if i != j and expected[i][j] != got[i, j]]
        assert not alone
