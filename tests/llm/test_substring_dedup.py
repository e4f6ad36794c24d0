"""Substring dedup: whole lines, passages inside and across lines, clean documents, against brute force."""

import random
import re

import pytest

from wayfold.llm import substring_dedup

WORD = re.compile(r"[^\W_]+")


def _some(rng, k, n):
    return " ".join(f"{k}{rng.randrange(10**6)}" for _ in range(n))


def _cut(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}


def test_lines_and_what_lies_between_them(spark):
    rng = random.Random(2)
    a, b, short = _some(rng, "a", 22), _some(rng, "b", 25), "best wishes to all"
    rows = [(1, f"{_some(rng, 'x', 9)}\n{a}\n{short}\n{b}\nend"), (2, f"{_some(rng, 'y', 9)}\n{a.upper()}!\n{short}\n{b}\n{_some(rng, 'z', 9)}"), (3, f"{short}\n{_some(rng, 'v', 30)}"), (4, None), (5, ""), (6, " \n\n")]
    out, texts = _cut(spark, rows), dict(rows)
    for i in (1, 3, 4, 5, 6):
        assert out[i].text == texts[i] and out[i].removed_spans == []
    first, *_, last = rows[1][1].split("\n")
    assert out[2].text == f"{first}\n{last}"
    (span,) = out[2].removed_spans
    assert rows[1][1][: span.start] + rows[1][1][span.end :] == out[2].text


def test_passages_inside_and_across_lines(spark):
    rng = random.Random(11)
    bare, tiny = _some(rng, "p", 60), ". ".join(_some(rng, "q", 3) for _ in range(20))
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(60))
    period = " ".join([_some(rng, "z", 30)] * 4)
    rows = [(1, f"{_some(rng, 'a', 40)} {bare} {_some(rng, 'b', 9)}"), (2, f"{_some(rng, 'c', 33)} {bare} {_some(rng, 'd', 51)}"), (3, f"{_some(rng, 'e', 30)}\n{tiny} {_some(rng, 'f', 30)}"), (4, f"{_some(rng, 'g', 8)} {tiny} {_some(rng, 'h', 17)}")]
    rows += [(5, f"开始{cjk}结束"), (6, f"另外{cjk}完"), (7, period), (8, f"{_some(rng, 'k', 5)}\n{bare}"), (9, f"x\n{bare.replace(' ', chr(10), 20)} y")]
    out, texts = _cut(spark, rows), dict(rows)
    assert all(out[i].text == texts[i] for i in (1, 3, 5))
    for i, passage in ((2, bare), (4, tiny), (6, cjk), (8, bare)):
        at = texts[i].index(passage)
        (span,) = out[i].removed_spans
        assert span.start == at and at + len(passage) <= span.end <= at + len(passage) + 1
    assert out[7].text.split() == period.split()[:30]
    assert out[9].text.split() == ["x", "y"]


def test_a_corpus_against_brute_force(spark):
    """Planted recall: of words in stretches of 50 words or more that stand in an earlier document, and of lines of
    MIN_WORDS words or more that do. Clean documents: those without a repeat of 20 words, of their own or of others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    out = {r.doc_id: r.removed_spans for r in substring_dedup.remove_repeats(docs).collect()}
    seen: dict = {}
    repeated = kept = clean = touched = 0
    for i, text in rows:
        spans = [m.span() for m in WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        covered = set()
        own = [hash(tuple(words[k : k + 20])) for k in range(len(words) - 19)]
        alike = len(set(own)) < len(own)  # it repeats itself
        for n in (50, 20):
            for k in range(len(words) - n + 1):
                if (key := (n, hash(tuple(words[k : k + n])))) in seen:
                    alike = True
                    covered |= set(range(k, k + 50)) if n == 50 else set()
        at = 0
        for line in text.split("\n"):
            n = len(WORD.findall(line))
            key = ("line", tuple(words[at : at + n]))
            if n >= substring_dedup.MIN_WORDS:
                covered |= set(range(at, at + n)) if key in seen else set()
                seen.setdefault(key, i)
            at += n
        for n in (50, 20):
            for k in range(len(words) - n + 1):
                seen.setdefault((n, hash(tuple(words[k : k + n]))), i)
        gone = lambda a, b: any(s.start <= a and b <= s.end for s in out[i])  # noqa: E731, B023
        repeated += len(covered)
        kept += sum(not gone(*spans[k]) for k in covered)
        if not alike:
            clean += 1
            touched += bool(out[i])
    assert repeated > 5000 and kept <= 0.05 * repeated, (kept, repeated)
    assert clean > 500 and touched <= 0.05 * clean, (touched, clean)


def test_rows_of_one_doc_id_and_clashing_columns(spark):
    """Of rows with one doc_id one keeps the first occurrence, equal rows are cut alike; a null doc_id ranks last."""
    rng = random.Random(5)
    p = _some(rng, "p", 30)
    rows = [(1, f"one\n{p}", 0), (1, f"two\n{p}", 0), (None, p, 0), (2, p, 0), (2, p, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = sorted((r.doc_id or 9, r.text, r.row) for r in substring_dedup.remove_repeats(docs).collect())
    whole = [x for x in got if p in x[1]]
    assert len(whole) == 1 and whole[0][0] == 1 and sorted(x[0] for x in got) == [1, 1, 2, 2, 9] and [x[1] for x in got if x[0] > 1] == ["", "", ""]
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(docs.withColumnRenamed("row", "removed_spans"))
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0
