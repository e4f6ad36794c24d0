"""Line dedup against brute force: links of all lines, their components, and which lines go."""

import random
from collections import Counter, defaultdict

from wayfold.llm import line_dedup
from wayfold.llm.common import tables_so_far

LINE = "see https://example.org/archive/northern-water-board/annual-report for details of it"


def _lines(rows):
    """(doc_id, line, normalised text) by the docstrings' rules."""
    return [(i, k, x) for i, t in rows for k, own in enumerate((t or "").split("\n")) if (x := own.strip(" \t\n\x0b\x0c\r").lower())]


def _links(texts):
    """All pairs of texts whose sets of 8-character runs have similarity 0.8 or more: a pair shares one of the
    rarest runs of either, as many as the similarity lets differ, and one."""
    sets = {x: {x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in texts}
    often = Counter(r for s in sets.values() for r in s)
    posted, out = defaultdict(list), set()
    for x in sorted(sets):
        own = sorted(sets[x], key=lambda r: (often[r], r))[: len(sets[x]) // 5 + 1]
        for y in {y for r in own for y in posted[r]}:
            both = len(sets[x] & sets[y])
            if 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                out.add((y, x))
        for r in own:
            posted[r].append(x)
    return out


def _top(texts, links):
    parent = {x: x for x in texts}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return {x: find(x) for x in texts}


def _gone(rows, top):
    first, out = {}, set()
    for i, k, x in sorted(_lines(rows)):
        if top[x] in first and first[top[x]] != (i, k):
            out.add((i, k))
        first.setdefault(top[x], (i, k))
    return out


def _compare(spark, rows):
    """(share of brute force's links that stand within one component, found removals, brute force's)."""
    texts = {x for *_, x in _lines(rows)}
    links = _links(texts)
    want = _top(texts, links)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = {r.own: r.key for r in line_dedup.lines_of(docs).collect()}
    assert set(key) == texts
    linked = line_dedup._linked(docs)
    label = {r.node: r.root for r in linked[2].collect()}
    own = {x: label.get(key[x], key[x]) for x in texts}
    assert all(len({want[x] for x in group}) == 1 for group in _groups(own)), "lines of two components joined"
    got = {(r.doc_id, r.line) for r in line_dedup._gone(*linked).collect()}
    assert got == _gone(rows, own)
    return sum(own[a] == own[b] for a, b in links) / max(1, len(links)), got, _gone(rows, want)


def _groups(top):
    out = defaultdict(list)
    for x, t in top.items():
        out[t].append(x)
    return out.values()


def test_a_corpus_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    share, got, want = _compare(spark, rows)
    assert share >= 0.99 and len(got & want) >= 0.995 * len(want)


def test_chains_of_edited_lines_against_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    rows = []
    for _ in range(60):
        own = [word() for _ in range(rng.randrange(8, 30))]
        for _ in range(14):  # each differs from the one before it in a word; the ends have little in common
            own = own[:]
            own[rng.randrange(len(own))] = word()
            rows.append((rng.randrange(400), " ".join(own)))
    by_doc = defaultdict(list)
    for i, x in rows:
        by_doc[i].append(x)
    share, got, want = _compare(spark, [(i, "\n".join(x)) for i, x in by_doc.items()])
    assert share >= 0.99 and len(got & want) >= 0.99 * len(want) and len(want) > 300


def test_isolated_pairs_near_the_limit_are_found(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        x = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(rng.randrange(90, 400))).strip()
        n = max(1, round(0.105 * len(x)) - 7)  # a changed stretch touches that many runs and seven more
        at = rng.randrange(8, len(x) - n - 8)
        rows += [(2 * i, x), (2 * i + 1, x[:at] + "".join(rng.choice("0123456789") for _ in range(n)) + x[at + n :])]
    share, got, want = _compare(spark, rows)
    assert len(want) > 1000 and share >= 0.985


def test_lists_of_many_components(spark):
    """Families that are less alike than the limit, of members that are more alike, share lists."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    base, lines = [word() for _ in range(24)], []
    for _ in range(60):
        own = base[:]
        for at in rng.sample(range(24), 4):
            own[at] = word()
        for _ in range(3):
            line = own[:]
            line[rng.randrange(24)] = word()
            lines.append(" ".join(line))
    share, got, want = _compare(spark, list(enumerate(lines)))
    assert share >= 0.99 and got == want


def test_lines_of_few_blanks(spark):
    rows = [(1, LINE + "abcdefghijkl"), (2, LINE + "abcdefghijklm")]
    assert {r.doc_id: r.gone for r in line_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {2: [0]}


def test_odd_rows(spark):
    """Null and repeated ids, equal rows, blank lines, short lines and clashing column names."""
    rows = [(None, "a line that stands here too", 1), (2, "a line that stands here too\n\n \n", 1), (2, "a line that stands here too\n\n \n", 1), (3, "ab\nab\nabc", None), (4, None, 1), (5, "", 1), (6, "한국어 \U0001f600\n한국어 \U0001f600 ", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone int")
    out = sorted(((r.doc_id or 9, r.text, r.gone) for r in line_dedup.remove_lines(docs).collect()), key=repr)
    assert out == sorted([(9, "", 1), (2, "a line that stands here too\n\n \n", 1), (2, "a line that stands here too\n\n \n", 1), (3, "ab\nabc", None), (4, None, 1), (5, "", 1), (6, "한국어 \U0001f600", 1)], key=repr)


def test_bitmaps_rule_out_no_pair_that_reaches_the_similarity(spark):
    rng = random.Random(5)
    base = [LINE, "é" * 30, "ab" * 40, "x", "a short one", " ".join(rng.choice(["alpha", "beta", "gamma", "Ω", "𝔘"]) for _ in range(60))]
    texts = set(base)
    for own in base:
        for _ in range(12):
            at, n = rng.randrange(len(own)), rng.randrange(1, 4)
            texts.add(own[:at] + rng.choice("qwertz") * n + own[at + n * rng.randrange(2) :])
    rows = spark.createDataFrame(list(enumerate(sorted(texts))), "k long, own string")
    maps = line_dedup.bitmaps(rows)
    assert maps.count() == len(texts)
    right = maps.select(*[maps[c].alias(f"{c}_b") for c in maps.columns])
    passed = {(r.k, r.k_b) for r in maps.crossJoin(right).where("k < k_b").where(line_dedup.may_link("_b")).select("k", "k_b").collect()}
    sets = {r.k: set(r.s) for r in rows.select("k", line_dedup.shingle_set("own").alias("s")).collect()}
    alike = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert alike and alike <= passed and len(passed) < len(sets) * (len(sets) - 1) // 4


def test_bitmaps_part_long_lines(spark):
    """Lines of over a thousand shingles that are 0.5 to 0.7 alike are ruled out, copies are not, nor is a doubled line."""
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    base = letters(1300)
    texts = [base[: 100 * i] + letters(330) + base[100 * i + 330 :] for i in range(9)] + [base, base + "x" * 40, base[:700], base[:700] * 2]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, own string")
    maps = line_dedup.bitmaps(rows)
    right = maps.select(*[maps[c].alias(f"{c}_b") for c in maps.columns])
    passed = {(r.k, r.k_b) for r in maps.crossJoin(right).where("k < k_b").where(line_dedup.may_link("_b")).select("k", "k_b").collect()}
    sets = [{x[i : i + 8] for i in range(len(x) - 7)} for x in texts]
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(texts)) for b in range(a + 1, len(texts))}
    assert {p for p, j in like.items() if j >= 0.8} <= passed and {(9, 10), (11, 12)} <= passed
    assert sum(0.5 <= j < 0.7 for j in like.values()) > 10 and all(like[p] >= 0.7 for p in passed)


def test_bitmaps_of_all_lengths(spark):
    """Bits of odd counts and set sizes, whether or not the shingles fill the rows that they are placed by."""
    texts = [("ab" * 40 + LINE)[70 : 70 + n] for n in range(1, 45)] + ["ab" * 40, "é\U0001f600" * 9]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, own string")
    sets = {r.k: r.s for r in rows.select("k", line_dedup.shingle_set("own").alias("s")).collect()}
    maps = {r.k: r for r in line_dedup.bitmaps(rows).collect()}
    assert maps.keys() == sets.keys() and len(sets[44]) == 2 and [len(sets[n - 1]) for n in (1, 8, 9, 40)] == [1, 1, 2, 32]
    for k, own in sets.items():
        want = [0] * line_dedup.WORDS
        for h in own:
            want[(h % (1 << 64)) >> 60] ^= 1 << (h & 63)
        assert maps[k].runs == len(own) and [maps[k][f"w{w}"] % (1 << 64) for w in range(line_dedup.WORDS)] == want


def test_tables_of_the_steps_go_at_once(spark):
    rng = random.Random(2)
    own = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(200)).strip() for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(own + [x + "q" for x in own] + [x[:150] for x in own])), "doc_id long, text string")
    before = tables_so_far()
    linked = line_dedup._linked(docs)
    assert tables_so_far() - before <= 3 and linked[2].count() == 60


def test_lines_on_no_pair_are_not_compared(spark):
    """Of lists of two only agreeing pairs are, of others all members."""
    lists = spark.createDataFrame([(1, 2), (2, 2), (3, 2), (4, 2), (5, 3), (6, 3), (7, 3)], "key long, n long")
    pairs = spark.createDataFrame([(3, 4)], "a long, b long")
    assert sorted(r.end for r in line_dedup._compared(lists, pairs).collect()) == [3, 4, 5, 6, 7]


def test_texts_stay_where_they_are_for_few_numbers(spark):
    docs = spark.createDataFrame([(i, f"{LINE}\nthe line of number {i} " + "xyz" * i) for i in range(5)], "doc_id long, text string")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = line_dedup.remove_lines(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sum(LINE in r.text for r in out.collect()) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


def test_signatures_take_each_run_in_few_rows(spark):
    """Lines of all lengths about the ends of rows: just their own runs, in as few rows of 32 as hold them."""
    rows = [(n, n, bytearray((i * 37 + n * 11) % 251 for i in range(n)), max(1, n - 7)) for n in (1, 7, 8, 9, 38, 39, 40, 41, 70, 71, 72, 103, 400)]
    made = line_dedup.hashed(spark.createDataFrame(rows, "key long, rank long, u binary, last int")).collect()
    own = spark.createDataFrame([(n, u[i : i + 8]) for n, _, u, last in rows for i in range(last)], "key long, run binary").selectExpr("key", "hash(run) as h").collect()
    for n, _, _, last in rows:
        mine = [r for r in made if r.key == n]
        assert len(mine) == -(-last // 32) and sorted(r.i for r in mine) == list(range(1, last + 1, 32))
        assert {r[f"h{k}"] for r in mine for k in range(line_dedup.STEP)} == {r.h for r in own if r.key == n}
