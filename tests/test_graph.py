"""Closure, components, ranks and entity resolution against plain Python."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from wayfold.operators import graph
from wayfold.operators import resolve as rs


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def reached(edges):
    out = set()
    for start in {a for a, _ in edges}:
        hops, line = {start: 0}, deque([start])
        while line:
            x = line.popleft()
            for a, b in edges:
                if a == x and b is not None and b not in hops:
                    hops[b] = hops[x] + 1
                    line.append(b)
        out |= {(start, b, h) for b, h in hops.items() if h and start is not None}
    return out


CHAIN = [(str(i), str(i + 1)) for i in range(13)]
CYCLE = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "b"), ("d", "d")]
DAG = [("x", "y"), ("x", "z"), ("y", "w"), ("z", "w"), ("x", "w"), ("w", None), (None, "x"), ("x", "y")]


@pytest.mark.parametrize("edges", [CHAIN, CYCLE, DAG, [], [("a", "a")]], ids=["chain", "cycle", "dag", "none", "self"])
def test_closure(spark, edges):
    assert got(graph.closure(spark.createDataFrame(edges, "node string, parent string"))) == reached([e for e in edges if None not in e])


def _components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(x, find(x)) for x in root}


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(6)
    name = list(range(120))
    rng.shuffle(name)
    edges = {"path": [(name[i], name[i + 1]) for i in range(119)], "star": [(name[0], x) for x in name] + [(5, None)], "random": [(rng.choice(name), rng.choice(name)) for _ in range(80)] * 2, "none": [(1, 1), (None, 2)]}[kind]
    assert got(graph.components(spark.createDataFrame(edges, "src long, dst long"))) == _components(edges)


def test_pagerank_converges(spark):
    rng = random.Random(8)
    edges = {(rng.randrange(30), min(29, int(rng.expovariate(0.2)))) for _ in range(90)} | {(3, 3), (40, 0)}
    nodes = sorted({x for e in edges for x in e})
    out = {x: [b for a, b in edges if a == x] for x in nodes}
    rank = dict.fromkeys(nodes, 1.0)
    for _ in range(300):
        lost = sum(rank[x] for x in nodes if not out[x]) / len(nodes)
        rank = {x: 0.15 + 0.85 * (lost + sum(rank[a] / len(out[a]) for a, b in edges if b == x)) for x in nodes}
    df = spark.createDataFrame([*edges, *edges, (None, 1)], "src long, dst long")
    own = dict(graph.pagerank(df).collect())
    assert set(own) == set(nodes) and max(abs(own[x] - rank[x]) for x in nodes) < 1e-6 and abs(sum(own.values()) - len(nodes)) < 1e-6
    assert graph.pagerank(df.limit(0)).count() == 0


def test_edges_from_where_nothing_leads_count_once(spark, monkeypatch):
    edges = [(i, 100 + i % 7) for i in range(60)] + [(i, 100 + i % 3) for i in range(60)] + [(100, 200), (101, 200), (200, 100), (102, 300)]
    rank = {x: 1.0 for e in edges for x in e}
    out = {x: [b for a, b in set(edges) if a == x] for x in rank}
    for _ in range(4):
        lost = sum(rank[x] for x in rank if not out[x]) / len(rank)
        rank = {x: 0.15 + 0.85 * (lost + sum(rank[a] / len(out[a]) for a, b in set(edges) if b == x)) for x in rank}
    walked, own = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: walked.append(df.count()) or own(df) if df.columns == ["src", "dst", "share"] else own(df))
    got_ranks = dict(graph.pagerank(spark.createDataFrame(edges, "src long, dst long"), tolerance=0.0, most=4).collect())
    assert got_ranks == pytest.approx(rank) and walked == [4]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *[0] * len(b)], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_like_names_equal_all_pairs(spark, most):
    rng = random.Random(most)
    names = {"".join(rng.choice("abé") for _ in range(rng.randrange(0, 7))) for _ in range(90)} | {"", "x" * 300, "x" * 299, "x" * 150 + "y" + "x" * 149}
    names = {n for n in names if most == 1 or len(n) < 20}
    df = spark.createDataFrame([(n,) for n in [*names, *names, None]], "name string")
    want = {(a, b, edits(a, b)) for a in names for b in names if a < b and edits(a, b) <= most}
    assert got(rs.like_names(df, "name", most)) == want


def test_matches_in_blocks_equal_all_pairs(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))) if i % 11 else None, rng.choice([1, 2, None])) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, name string, area int")
    want = {(i, j, edits(a, b)) for i, a, x in rows for j, b, y in rows if i < j and x == y and None not in (a, b, x) and edits(a, b) <= 1}
    assert got(rs.match_blocked(df, df, "area", "name", 1)) == want and any(w[2] == 0 for w in want)


def test_clusters_and_golden_records(spark):
    rows = [(1, "blue house", 10.0, "x"), (2, "blue house", None, "y"), (3, "blu house", 30.0, "x"), (4, "blu hose", 20.0, None), (5, "red inn", 5.0, "z"), (6, None, 1.0, "z"), (7, None, 2.0, "z"), (None, "red inn", 9.0, "q"), (8, "", None, None)]
    df = spark.createDataFrame(rows, "id long, name string, price double, tag string")
    members = rs.clusters(df, "id", "name")
    assert got(members) == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 6), (7, 7), (8, 8)}
    best = {r.cluster: (r.members, r.name, r.price, r.tag) for r in rs.golden(df, "id", "name", members, {"price": F.col("id")}, ["tag"]).collect()}
    assert best == {1: (4, "blue house", 20.0, ["x", "y"]), 5: (1, "red inn", 5.0, ["z"]), 6: (1, None, 1.0, ["z"]), 7: (1, None, 2.0, ["z"]), 8: (1, "", None, [])}
    apart = rs.clusters(df, "id", "name", where=F.length("a") == F.length("b"))
    assert got(apart) == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8)}
    assert rs.clusters(df.limit(0), "id", "name").count() == 0
