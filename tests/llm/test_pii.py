"""Discovery of identifiers: several unseen ones a pattern, and quantities as evidence against a pattern."""

import random

from wayfold.llm import pii


def test_unseen_identifiers_are_found_from_few_seeds(spark):
    rows = [(i, f"you may call a{i}@mail.example.com") for i in range(3)] + [(100 + i, f"you may call 0{i}43-555-38{10 + i}") for i in range(20)]
    rows += [(200 + i, f"it cost us b{i}@mail.example.com") for i in range(3)] + [(300 + i, f"it cost us 1{10 + i},250.50") for i in range(20)] + [(400, "it cost us QX-4471-22")]
    spans = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(spans[100 + i].startswith("id:13:") for i in range(20))
    assert not any("id:" in spans[i] for i in [*range(300, 320), 400])


def test_keys_after_their_name_and_codes_of_a_withheld_shape(spark):
    """Long random tokens teach what stands before a key; codes of another shape are found there, and only there."""
    rng = random.Random(7)
    fill = lambda n: " ".join(f"word{rng.choice('abcdefghijklmnopqrst')}{rng.choice('xyz')}" for _ in range(n))
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    code = lambda: f"ZX-{rng.randrange(1000, 9999)}-{rng.randrange(10, 99)}"
    rows, want = [], {}
    for i in range(60):
        kind = i % 6
        token = key() if kind in (0, 1, 5) else code()
        before = f"{fill(rng.randrange(2, 6))} " + ('Token = "' if kind < 3 else "")
        text = f"{before}{token}" + ('" ' if kind < 3 else " ") + fill(4) + f" on 2024-0{rng.randrange(1, 9)}-11 at 12:30"
        rows.append((i, text))
        want[i] = f"id:{len(before)}:{len(before) + len(token)}" if kind < 3 else ""
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_quotes_are_no_context():
    assert pii._contexts('the token = "AB1234" is', 13, 19) == ["token = _", "_ is", "= _ is"]
    assert pii._contexts('| "AB1234" |', 3, 9) == []
