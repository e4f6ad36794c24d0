"""The whole pipeline: a small fixture with one case for each stage against plain Python, and odd and empty tables."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _write(spark, at, rows):
    spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows], SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    return str(at)


def _packed(rows):
    """Rows by document; asserts that pieces lie side by side in sequences of 2048 tokens at most."""
    by_doc, places = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return by_doc


def test_one_case_for_each_stage(spark, tmp_path):
    rng = random.Random(12)
    syllables = ["ba", "ko", "ri", "ten", "mu", "sal", "vo", "den", "fi", "gor"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    texts = {i: "\n".join(line(20) for _ in range(4)) for i in range(60)}
    texts[100] = "too short to stay"  # quality rules
    words = texts[7].split()
    texts[101] = " ".join(words[:33]) + "\n" + " ".join(words[33:])  # the words of 7 in other lines: near-duplicate
    shared = line(20)
    texts[20], texts[40] = f"{texts[20]}\n{shared}", f"{texts[40]}\n{shared}"  # one line in two documents
    texts[30] = f"{texts[30]} write to some.one@mail.example.com now"  # personal data
    want = {i: t for i, t in texts.items() if i not in (100, 101)}
    want[40] = want[40].removesuffix(f"\n{shared}")
    want[30] = want[30].replace("some.one@mail.example.com", "[email]")
    got = _packed(corpus_pipeline.run(spark, _write(spark, tmp_path, [(i, t, "xx", "s") for i, t in texts.items()])).collect())
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = {i: len(coder.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    assert set(got) == set(want)
    # a removed last line may leave its line end
    assert {i for i in got if sum(x[2] for x in got[i]) != n[i]} <= {40} and abs(sum(x[2] for x in got[40]) - n[40]) <= 1


@pytest.mark.parametrize("empty", [False, True])
def test_odd_and_empty_tables(spark, tmp_path, empty):
    long = " ".join(f"w{i}" for i in range(30_000))
    odd = [(1, None, None, None), (2, "", "en", "s"), (3, "  \n\t ", "en", None), (4, "one two", "en", "s"), (4, "one two", "en", "s"), (None, "a null id has a text of its own here and it is ten words long", "en", "s"), (5, long, "en", "s"), (5, long, "en", "s"), (6, "ünïcode Straße 日本語 \U0001f600 x", "de", "s")]
    got = _packed(corpus_pipeline.run(spark, _write(spark, tmp_path, [] if empty else odd)).collect())
    assert set(got) <= {None, 5} and not (empty and got)
