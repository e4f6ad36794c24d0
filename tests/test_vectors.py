"""Vector searches against all pairs in numpy; the written index: pruning, growth without a refit, recall."""

import numpy as np
import pytest

from wayfold.operators import vectors as vs

SCHEMA = "id long, vec array<float>, label string"


def clustered(n, dim=16, hubs=40, spread=0.15, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((hubs, dim))
    return centres[rng.integers(0, hubs, n)] + spread * rng.standard_normal((n, dim))


def table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(y) for y in v], "x") for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)], SCHEMA)


def plain(q, qi, v, vi, k):
    unit = lambda x: x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)
    sim = np.round(unit(q.astype(np.float32).astype(float)) @ unit(v.astype(np.float32).astype(float)).T, 6) + 0.0
    return {(int(a), int(b), float(s), r) for i, a in enumerate(qi) for r, (s, b) in enumerate(sorted(((-sim[i, j], b) for j, b in enumerate(vi) if b != a))[:k], 1) for s in [-s + 0.0]}


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture
def in_groups(monkeypatch):
    """No queries are small, and groups are tiny."""
    for name, value in (("QUERY_BYTES", -1), ("QUERY_BLOCK", 7), ("VECTOR_BLOCK", 50)):
        monkeypatch.setattr(vs, name, value)


def _exact(spark):
    x = np.vstack([clustered(400), np.zeros((2, 16)), clustered(3), clustered(3)])  # ties: the last three twice
    v = table(spark, x)
    odd = v.unionByName(spark.createDataFrame([(None, [1.0] * 16, "x"), (9000, None, "x")], SCHEMA)).repartition(5)
    ids = np.array([0, 5, 17, 402, 403, *range(40, 60)])
    assert got(vs.search(odd.where(vs.F.col("id").isin(ids.tolist()) | vs.F.col("id").isNull()), odd, 10)) == plain(x[ids], ids, x, range(len(x)), 10)
    assert vs.search(v.limit(0), v, 3).count() == 0 and vs.search(v, v.limit(0), 3).count() == 0
    assert got(vs.search(table(spark, x[:2]), table(spark, x[:3]), 10)) == plain(x[:2], [0, 1], x[:3], range(3), 10)


def test_exact_search(spark):
    _exact(spark)


def test_exact_search_in_groups(spark, in_groups):
    _exact(spark)


def _index(spark, path):
    x = clustered(3000)
    ids = np.arange(0, 3000, 100)
    q, first = table(spark, x[ids], ids), table(spark, x[:2000])
    vs.ivf_write(first, path, 32)
    index = vs.ivf_open(spark, path)
    centres = index.centres.copy()
    index.add(table(spark, x[2000:], range(2000, 3000)))
    again = vs.ivf_open(spark, path)
    assert (again.centres == centres).all() and again.vectors().count() == 3000 and again.vectors().select("id").distinct().count() == 3000
    want = plain(x[ids], ids, x, range(3000), 10)
    assert got(again.search(q, 10, 32)) == want
    found = {r[:2] for r in got(again.search(q, 10, 4))}
    assert len(found & {r[:2] for r in want}) >= 0.9 * len(want)
    assert again.vectors().columns == ["id", "vec", "label", "list"]


def test_index_of_lists(spark, tmp_path):
    _index(spark, f"{tmp_path}/i")


def test_index_of_lists_in_groups(spark, tmp_path, in_groups):
    _index(spark, f"{tmp_path}/i")


def test_a_search_reads_the_probed_folders_only(spark, tmp_path):
    x = clustered(800)
    index = vs.ivf_write(table(spark, x), f"{tmp_path}/i", 16)
    found = index.search(table(spark, x[:1], [5000]), 5, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    line = next(p for p in plan.split("\n") if "PartitionFilters" in p)
    assert "list" in line[line.index("PartitionFilters") :] and "IN (" in line.upper()
    own = index.assigned(table(spark, x[:1], [5000]), 2).select("list").collect()
    read = {f.split("list=")[1].split("/")[0] for f in index.vectors([r[0] for r in own]).inputFiles() if "list=" in f}
    assert len({r[0] for r in own}) == 2 and {r[0] for r in index.vectors([r[0] for r in own]).select("list").distinct().collect()} <= {r[0] for r in own} and read


def test_index_without_vectors_or_manifest(spark, tmp_path):
    with pytest.raises(ValueError):
        vs.ivf_write(table(spark, clustered(3)).limit(0), f"{tmp_path}/i", 4)
    with pytest.raises(vs_missing()):
        vs.ivf_open(spark, f"{tmp_path}/none")
    few = vs.ivf_write(table(spark, clustered(3)), f"{tmp_path}/f", 8)
    assert len(few.centres) <= 3 and few.search(table(spark, clustered(1), [77]), 9, 8).count() == 3


def vs_missing():
    from pyspark.errors import AnalysisException

    return AnalysisException


def test_hashing_finds_what_shares_a_bucket(spark):
    x = clustered(300)
    v, q = table(spark, x), table(spark, x[:20])
    planes = np.random.default_rng(11).standard_normal((16, 6 * 8))
    unit = x.astype(np.float32).astype(float)
    own = (unit / np.linalg.norm(unit, axis=1, keepdims=True) @ planes > 0).reshape(-1, 8, 6) @ (1 << np.arange(6))
    want = {(a, b) for a in range(20) for b in range(300) if a != b and (own[a] == own[b]).any()}
    pairs = got(vs.lsh_pairs(q, v, 6, 8))
    assert pairs == want and len(pairs) < 0.5 * 20 * 299
    exact = {r[:2] for r in plain(x[:20], range(20), x, range(300), 5)}
    assert len({r[:2] for r in got(vs.knn_lsh(q, v, 5, 6, 8))} & exact) >= 0.9 * len(exact)


@pytest.mark.parametrize("cells", [64, 500, 1 << 20])
def test_blocks_of_any_size_find_the_same(monkeypatch, cells):
    monkeypatch.setattr(vs, "CELLS", cells)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (300, 4)).astype(float)  # many ties, and some zeros
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1)
    best, order = vs._Best(np.arange(40), unit[:40], 7), rng.permutation(300)
    for part in np.array_split(order, 4):
        best.show(part, unit[part])
    got = {(q, n, s) for q, n, s in zip(*(c.to_pylist() for c in best.found().columns), strict=True)}
    assert got == {r[:3] for r in plain(x[:40], range(40), x, range(300), 7)}


def test_blocks_take_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(4)
    u, v = rng.standard_normal((2000, 8)), rng.standard_normal((10_000, 8))
    tracemalloc.start()
    best = vs._Best(np.arange(2000), u, 10)
    best.show(np.arange(10_000), v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert best.found().num_rows == 20_000 and peak < 100 << 20


def _hashed(spark):
    x = clustered(300)
    v, q = table(spark, x), table(spark, x[:20])
    pairs = got(vs.lsh_pairs(q, v, 6, 8))
    want = {}
    for a, b, s, _ in plain(x[:20], range(20), x, range(300), 300):
        if (a, b) in pairs:
            want.setdefault(a, []).append((-s, b))
    assert got(vs.knn_lsh(q, v, 5, 6, 8)) == {(a, b, -s, r) for a, own in want.items() for r, (s, b) in enumerate(sorted(own)[:5], 1)}


def test_hashed_search_ranks_what_shares_a_bucket(spark):
    _hashed(spark)


def test_hashed_search_in_groups(spark, in_groups):
    _hashed(spark)


def test_hashed_search_shuffles_no_pairs(spark):
    x = table(spark, clustered(50))
    plan = vs.knn_lsh(x.limit(5), x, 5, 6, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_scores_make_no_golden_pairs(spark, sf):
    from wayfold.plans import kb
    from wayfold.plans.queries import QUERIES
    from wayfold.operators import evaluate as ev

    df = QUERIES["eval_scores"](spark, sf)
    v, q = kb.vectors(spark, sf), kb.query_vectors(spark, sf)
    golden = q.select(vs.F.col("id").alias("q"), "label").join(v.select(vs.F.col("id").alias("node"), "label"), "label").where("q != node")
    assert got(df) == got(ev.evaluate(vs.search(q, v, 10), golden))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # the one join by label is with the labels' sizes
    assert "NOT (q#" not in plan and "Aggregate [label" in plan
