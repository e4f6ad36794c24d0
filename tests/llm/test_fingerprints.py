"""Fingerprints: rows without a doc_id come first in the circle of documents."""

import hashlib

from wayfold.llm import fingerprints


def test_rows_without_an_id_are_chained(spark):
    rows = [(None, "a text that has no id of its own"), (None, "second text without an id of its own"), (3, "first real text of all of them"), (5, "last real text among these here")]
    got = {r.fingerprint: r.edited_sha256 for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = [t for _, t in rows]
    want = {hashlib.sha256((t[: len(t) - len(t) // 4] + texts[(k + 1) % 4][: len(t) // 4]).encode()).hexdigest() for k, t in enumerate(texts)}
    assert set(got.values()) == want
