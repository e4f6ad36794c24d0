"""Quality rules: a compact cluster of junk does not drag the estimate along."""

import random

from wayfold.llm import quality_rules as q


def test_a_compact_fifth_of_junk_is_far(spark):
    rng = random.Random(4)
    spread = [q.SCALE * x for x in q.FEATURES.values()]
    for share, wide, away in ((0.22, 1, 15), (0.20, 2, 30)):
        n = 500
        junk = int(share * n)
        rows = [(int(i < junk), *[int(1000 + (away * s + rng.gauss(0, 0.1 * s) if i < junk else rng.gauss(0, wide * s))) for s in spread]) for i in range(n)]
        df = spark.createDataFrame(rows, "junk int, " + ", ".join(f"f{i} long" for i in range(q.P))).selectExpr("*", "0 as every")
        far = q._distance(df.join(q.mcd(df.drop("junk"), ["every"]), "every")).selectExpr("junk", f"d2 * {q.TRIMMED} > {q.CUTOFF} as out")
        assert far.where("junk = 1 and not out").count() == 0 and far.where("junk = 0 and out").count() <= 0.02 * n


def test_the_trimmed_share_and_the_estimate_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.standard_normal((200_000, q.P))
    d = (x**2).sum(axis=1)
    assert abs(x[d <= np.quantile(d, q.CORE)].var() - q.TRIMMED) < 0.01

    floors = np.diag([(q.SCALE * f) ** 2 for f in q.FEATURES.values()])
    spread = np.sqrt(np.diag(floors))
    groups = []
    for junk in (0.0, 0.1, 0.2):
        rows = np.rint(1000 + rng.standard_normal((400, q.P)) * 2 * spread)
        n = int(400 * junk)
        rows[:n] = np.rint(1000 + (20 + 0.2 * rng.standard_normal((n, q.P))) * spread)
        groups.append(rows)

    def concentrate(rows, mean, cov):
        best = None
        while True:
            d2 = np.einsum("ij,jk,ik->i", rows - mean, np.linalg.inv(cov), rows - mean)
            bucket = np.floor(np.log1p(d2) * 64)
            core = rows[bucket <= np.sort(bucket)[int(np.ceil(len(rows) * q.CORE)) - 1]]
            mean, cov = core.mean(axis=0), np.cov(core.T, bias=True) + floors
            size = np.linalg.slogdet(cov)[1] / 2
            if best is not None and size >= best[0] - 1e-6:
                return best
            best = (size, mean, cov)

    df = spark.createDataFrame([(g, *map(int, r)) for g, rows in enumerate(groups) for r in rows], "g int, " + ", ".join(f"f{i} long" for i in range(q.P)))
    got = {r.g: r for r in q.mcd(df, ["g"]).collect()}
    for g, rows in enumerate(groups):
        middle = np.median(rows, axis=0)
        wide = np.diag((1.4826 * np.median(abs(rows - middle), axis=0)) ** 2) + floors
        _, mean, cov = min((concentrate(rows, middle, wide), concentrate(rows, rows.mean(axis=0), np.cov(rows.T, bias=True) + floors)), key=lambda b: b[0])
        factor = np.linalg.cholesky(cov)
        assert np.allclose([got[g][f"m{i}"] for i in range(q.P)], mean, rtol=1e-3)
        assert np.allclose([got[g][f"l{i}{j}"] for i, j in q._PAIRS], [factor[i, j] for i, j in q._PAIRS], rtol=0.05, atol=0.05 * spread.max())
