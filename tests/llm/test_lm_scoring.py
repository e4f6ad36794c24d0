"""Language-model scoring: counts and the unigram score by plain Python, probabilities by a slow version of the model."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from wayfold.llm import lm_scoring, maxent

SCHEMA = "doc_id long, text string, lang string, row long, token string, leaves string, c long"


def tokens(text):
    small = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for b in "\t\n\x0b\x0c\r":
        small = small.replace(b, " ")
    return [w for w in small.split(" ") if w] + [""]


def base(rows):
    """doc_id, text -> (doc_id, held_out, n_tokens, n_known, train_tokens, base score), sorted."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    own = lambda t: (len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6))
    return sorted(((i, held(i), *own(t)) for i, t in rows), key=repr)


def plain(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("head", [lm_scoring.HEAD, 100, 0])
def test_counts_and_unigram_score(spark, sf, head):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = lm_scoring.score(docs, head)
    assert plain(got) == base([(r.doc_id, r.text) for r in docs.collect()])


def test_held_out_texts_are_likelier_than_by_unigrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in lm_scoring.score(docs).collect()}
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)
    assert sum(r.score > r.base_score for r in held) > 0.9 * len(held)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t\x0b\x0c\r "), (4, "one two ONE É é"), (4, "one two ONE É é"), (None, "a null id"), (None, None), (5, " ".join(f"w{i % 9000}" for i in range(120_000))), (6, "x" * 100_000), (7, "日本語 \U0001f600 a\x00b a\x1fb\x85c"), *[(i, "only held out unknown" if zlib.crc32(str(i).encode()) % 5 == 1 else "one known") for i in range(100, 160)]]
    df = spark.createDataFrame([(i, t, "en", 1, "t", "l", 2) for i, t in rows], SCHEMA).repartition(3)
    got = lm_scoring.score(df)
    assert plain(got) == base(rows) and all(r.score < 0 for r in got.collect())
    by_text = {}
    for r in got.collect():
        assert abs(by_text.setdefault((r.doc_id, r.base_score), r.score) - r.score) < 1e-6
    held = df.where("doc_id >= 100").where(lm_scoring.F.crc32(lm_scoring.F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
    assert {(r.n_known, r.train_tokens) for r in lm_scoring.score(held).collect()} == {(0, 0)}
    assert lm_scoring.score(spark.createDataFrame([], SCHEMA)).count() == 0


def _sums(model, texts):
    seen, expected = (tuple(np.zeros((n, maxent.CLASSES)) for n in maxent.ROWS) for _ in range(2))
    maxent.sums(model, *lm_scoring._counted(maxent.positions(texts)[1]), seen, expected)
    return seen, expected


def _trained(rng):
    """A model with weights, and texts of leaves in which leaf i is mostly followed by 3 i + 1."""
    texts = [np.array([0], np.uint16), np.array([], np.uint16)]
    for n in (1, 2, 50, 3000, 40_000):
        t = [int(rng.integers(maxent.LEAVES))]
        while len(t) < n:
            t.append((3 * t[-1] + 1) % 97 if rng.random() < 0.8 else int(rng.integers(maxent.LEAVES)))
        texts.append(np.array(t, np.uint16))
    model = maxent.untrained(np.bincount(np.concatenate(texts), minlength=maxent.LEAVES) + 0.5)
    for rate in (1.0, 0.6):
        model = maxent.step(model, *_sums(model, texts), rate, 10.0)
    return model, texts


def _rows(before, level, own):
    """Rows of a context's features, for its class or for the place in class `own`."""
    code = maxent.positions([np.array([*before, 0], np.uint16)])[1][-1:]
    return [int(r[0]) for r in maxent._rows(maxent._context(code), np.array([own]) if level else None)]


def _slow(model, before, leaf):
    """Natural log of the probability of a leaf after others, feature by feature."""
    own, place = divmod(int(leaf), maxent.CLASSES)
    total = 0.0
    for level, (prior, target) in enumerate(((model.prior[0], own), (model.prior[1][own], place))):
        x = [float(prior[k]) + sum(float(model.weights[level][r, k]) for r in _rows(before, level, own)) for k in range(maxent.CLASSES)]
        total += x[target] - math.log(sum(map(math.exp, x)))
    return total


def test_model_is_a_distribution_and_learns():
    rng = np.random.default_rng(1)
    model, texts = _trained(rng)
    for before in ([], [5], [5, 16], [5, 16, 49], list(rng.integers(0, maxent.LEAVES, 9))):
        p = maxent.log_probabilities(model, [np.array([*before, x], np.uint16) for x in range(maxent.LEAVES)])
        rest = maxent.log_probabilities(model, [np.array(before, np.uint16)])[0]
        assert abs(np.exp(p - rest).sum() - 1) < 1e-4
        assert abs(p[17] - rest - _slow(model, before, 17)) < 1e-4
    flat = maxent.untrained(np.bincount(np.concatenate(texts), minlength=maxent.LEAVES) + 0.5)
    assert maxent.log_probabilities(model, texts).sum() > 0.8 * maxent.log_probabilities(flat, texts).sum()
    assert maxent.log_probabilities(model, []).shape == (0,)


def test_sums_equal_a_loop(monkeypatch):
    rng = np.random.default_rng(2)
    model, _ = _trained(rng)
    texts = [np.array(rng.integers(0, n, n), np.uint16) for n in (0, 1, 7, 30)] * 2
    monkeypatch.setattr(maxent, "BATCH", 16)
    seen, expected = _sums(model, texts)
    want = [tuple(np.zeros((n, maxent.CLASSES)) for n in maxent.ROWS) for _ in range(2)]
    for t in texts:
        for i, leaf in enumerate(t):
            own, place = divmod(int(leaf), maxent.CLASSES)
            for level, (prior, target) in enumerate(((model.prior[0], own), (model.prior[1][own], place))):
                rows = _rows(t[:i], level, own)
                p = np.exp(prior.astype(np.float64) + sum(model.weights[level][r].astype(np.float64) for r in rows))
                for r in rows:
                    want[0][level][r, target] += 1
                    want[1][level][r] += p / p.sum()
    for level in range(2):
        assert (want[0][level] == seen[level]).all() and np.allclose(want[1][level], expected[level], atol=1e-3)


def test_context_counts(spark):
    rng = np.random.default_rng(3)
    texts = [np.array(rng.integers(0, 40, n), np.uint16) for n in (0, 1, 500, 3000, 3000)]
    df = spark.createDataFrame([(k == 1, t.tobytes()) for k, t in enumerate(texts)] * 3, "held_out boolean, leaves binary").repartition(4)
    got = {}
    for r in lm_scoring.context_counts(df).collect():
        for code, n in zip(lm_scoring._numbers(r.codes, "<u4").tolist(), lm_scoring._numbers(r.n, "<i8").tolist(), strict=True):
            assert code >> (32 - lm_scoring.BLOCK_BITS) == r.block and code not in got
            got[code] = n
    want = Counter(maxent.positions([t for k, t in enumerate(texts) if k != 1] * 3)[1].tolist())
    assert got == want
