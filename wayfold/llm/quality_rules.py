"""Quality rules: word and line statistics, and robust multivariate outliers per language and source.

The second part is a minimum-covariance-determinant (MCD) estimate: for each (lang, source) the mean and
covariance of the three quarters of its documents that lie closest together, found by concentration steps from
two starts (medians, and the mean and covariance of all) until the determinant stops falling; the start that ends
with the least determinant counts.
Every step is one aggregate over a small written table. Statistics are whole numbers (thousandths), so that
sums are exact and the verdicts don't depend on the order of rows or on a retried task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import drop_tables, materialize, slim, tables_so_far
from wayfold.llm.text_columns import BLANKS, words_of

SYMBOLS = "#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20

#: The transformed statistics and the least standard deviation of each: a group in which nearly all
#: documents agree would else reject the smallest difference.
FEATURES = {"symbol_rate": 0.034, "word_length": 0.6, "upper_share": 0.04, "mark_rate": 0.06, "dup_lines": 0.12}
SCALE = 1000
#: Share of a group's documents that the estimate rests on; least documents of a group.
CORE, MIN_GROUP = 0.75, 40
#: The squared distance beyond which a document is an outlier: the 0.999 quantile of chi-square with 5
#: degrees of freedom. Distances of short documents, whose statistics vary more, shrink by n / (n + SHORT).
CUTOFF, SHORT = 20.52, 20
#: Groups are sent to all executors up to this many; beyond, their estimates are joined by shuffling.
BROADCAST_GROUPS = 20_000


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the statistics of each whole text (null: none), in one pass."""
    df = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("words", words_of(F.col("text")))
    df = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    h = F.col("h")
    window = lambda i: F.xxhash64(*[F.get(h, i + F.lit(k)) for k in range(WINDOW)])
    df = df.withColumn("win", F.when(F.size("h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), window)).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != ""))
    without = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    return df.select(
        "doc_id", "lang", "source",
        F.size("h").cast("long").alias("n_words"),
        (F.length("text") - without(BLANKS)).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("win")) < F.size("win"), _repeat_words("win")).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        without("!?;:=_{}[]/\\^~`@").cast("long").alias("n_marks"),
    )


def _repeat_words(windows: str) -> Column:
    """Words in windows that occur twice or more. Sorting (hash, place) puts equal windows side by side; the
    repeated places, in order, each cover their words up to the next one's."""
    w = F.col(windows)
    pairs = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  value is computed once

    def places(s: Column) -> Column:
        same = lambda x, i, k: F.coalesce(F.get(s, i + F.lit(k))["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, i: ((i > 0) & same(x, i, -1)) | same(x, i, 1)), lambda x: x["p"]))

    def covered(p: Column) -> Column:
        own = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + F.lit(1)) - x, F.lit(WINDOW))))
        return F.aggregate(own, F.lit(0), lambda total, x: total + x)

    return let(pairs, lambda s: let(places(s), covered))


def features(stats: DataFrame) -> DataFrame:
    """Adds the transformed statistics f0.. as whole thousandths, and base_failed."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    made = [
        F.log1p(4 * F.col("n_symbols") / n) / 4,
        F.log1p(F.col("word_chars") / n) * 6,
        F.sqrt((F.col("n_upper") + 1) / (chars + 20)),
        F.log1p(4 * F.col("n_marks") / n) / 4,
        F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
    ]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return stats.withColumns({"base_failed": failed} | {f"f{i}": F.round(x * SCALE).cast("long") for i, x in enumerate(made)})


P = len(FEATURES)
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
_FLOORS = [(SCALE * x) ** 2 for x in FEATURES.values()]


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means m{i} and the Cholesky factor l{i}{j} of the covariance (with the least variances added)."""
    whole = lambda c: F.sum(c.cast("decimal(20,0)")).cast("double")  # noqa: E731  exact whatever the order
    df = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[whole(F.col(f"f{i}")).alias(f"s{i}") for i in range(P)], *[whole(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"q{i}{j}") for i, j in _PAIRS])
    df = df.select(*keys, "n", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(P)], *[f"q{i}{j}" for i, j in _PAIRS])
    df = df.select(*keys, "n", *[f"m{i}" for i in range(P)], *[((F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) + (_FLOORS[i] if i == j else 0.0)).alias(f"c{i}{j}") for i, j in _PAIRS])
    for j in range(P):  # a column of the factor at a time, so that expressions stay short
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.lit(1e-6), F.col(f"c{j}{j}") - sum((F.col(f"l{j}{k}") ** 2 for k in range(j)), F.lit(0.0)))))
        df = df.withColumns({f"l{i}{j}": (F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}") for i in range(j + 1, P)})
    return df.select(*keys, "n", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in _PAIRS])


def _distance(df: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance: forward substitution with the factor, then a sum of squares."""
    for i in range(P):
        df = df.withColumn(f"z{i}", (F.col(f"f{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return df.withColumn("d2", sum((F.col(f"z{i}") ** 2 for i in range(P)), F.lit(0.0)))


def _with_estimate(rows: DataFrame, estimate: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    small = estimate.count() <= BROADCAST_GROUPS
    return rows.join(F.broadcast(estimate) if small else estimate, keys, how)


def _start(rows: DataFrame, keys: list[str]) -> DataFrame:
    """An estimate from the medians and the median absolute deviations, which less than half the rows can't drag."""
    middle = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.median(f"f{i}").alias(f"m{i}") for i in range(P)]))
    near = _with_estimate(rows, middle, keys).groupBy(*keys).agg(F.first("n").alias("n"), *[F.first(f"m{i}").alias(f"m{i}") for i in range(P)], *[F.median(F.abs(F.col(f"f{i}") - F.col(f"m{i}"))).alias(f"a{i}") for i in range(P)])
    scale = lambda i: F.sqrt((1.4826 * F.col(f"a{i}")) ** 2 + F.lit(_FLOORS[i]))
    return near.select(*keys, "n", *[f"m{i}" for i in range(P)], *[(scale(i) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in _PAIRS])


def _concentrate(rows: DataFrame, keys: list[str], starts: DataFrame) -> DataFrame:
    """For each start (rows of starts have a number `start`) the estimate with the least determinant (its logarithm is
    twice `size`) that concentration steps from it reach; each keeps the CORE share with the smallest distances (to a
    bucket of distances, which a histogram finds exactly) and estimates again. A start of a group whose determinant no
    longer falls takes no further step; the others of all groups take theirs together."""
    size = sum((F.log(F.col(f"l{i}{i}")) for i in range(P)), F.lit(0.0))
    best, estimate, groups, own = None, starts, starts.count(), [*keys, "start"]
    while True:
        near = _distance(_with_estimate(rows, estimate, keys)).withColumn("bucket", F.floor(F.log1p("d2") * 64).cast("int"))
        counts = near.groupBy(*own, "bucket").agg(F.count(F.lit(1)).alias("k"))
        order = Window.partitionBy(*own).orderBy("bucket")
        counts = counts.withColumn("upto", F.sum("k").over(order)).withColumn("all", F.sum("k").over(Window.partitionBy(*own)))
        limit = counts.where(F.col("upto") >= F.ceil(F.col("all") * CORE)).groupBy(*own).agg(F.min("bucket").alias("most"))
        core = _with_estimate(near, materialize(limit, groups), own).where("bucket <= most")
        # written before it is compared: a condition on size would be computed below, with the whole factor in it
        made = materialize(_moments(core.select(*rows.columns, "start"), own).withColumn("size", size), groups)
        if best is None:
            best = estimate = made
            continue
        old = best.select(*own, F.col("size").alias("was"))
        estimate = materialize(made.join(old, own).where(F.col("size") < F.col("was") - 1e-6).drop("was"), groups)
        if estimate.isEmpty():
            return best
        best = materialize(best.join(estimate, own, "left_anti").unionByName(estimate), groups)


def mcd(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Robust location and Cholesky factor per key, of rows with f0... The last covariance is not yet scaled up for the
    cut tail (TRIMMED)."""
    starts = materialize(_start(rows, keys).withColumn("start", F.lit(0)).unionByName(_moments(rows, keys).withColumn("start", F.lit(1))))
    best = _concentrate(rows, keys, starts)
    one, two = (best.where(F.col("start") == k).drop("start") for k in (0, 1))
    better = materialize(two.join(one.select(*keys, F.col("size").alias("other")), keys).where(F.col("size") < F.col("other") - 1e-6).drop("other"))
    return materialize(one.join(better, keys, "left_anti").unionByName(better)).drop("size")


#: The variance of the nearest 75 % of a 5-dimensional normal sample, as a share of the whole's.
TRIMMED = 0.707


def judge(docs: DataFrame) -> DataFrame:
    """Statistics, base_failed and kept for every document.

    kept is false if base_failed, else it is false for outliers of the document's (lang, source). Groups with
    fewer than MIN_GROUP documents (that pass the base rules) take the estimate of their language, and where
    that has fewer too, of all. Null lang or source count as groups named by the empty string; null texts are
    empty and fail; repeated rows are judged each; an empty table gives no rows."""
    start = tables_so_far()
    stats = slim(docs, "doc_id", "text", "lang", "source").withColumns({"lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit(""))})
    rows = materialize(features(statistics(stats)))
    fit = rows.where(~F.col("base_failed")).select("lang", "source", *[f"f{i}" for i in range(P)])
    out = rows.withColumns({"every": F.lit(0), "d": F.lit(None).cast("double")})
    for keys in (["lang", "source"], ["lang"], ["every"]):
        estimate = mcd(fit.withColumn("every", F.lit(0)), keys).where(F.col("n") >= (MIN_GROUP * CORE if keys != ["every"] else 0))
        scored = _distance(_with_estimate(out, estimate, keys, "left"))
        out = materialize(scored.withColumn("d", F.coalesce("d", "d2")).select(*out.columns))
        if out.where("d is null").isEmpty():
            break
    drop_tables(start, (out,))
    shrunk = F.coalesce("d", F.lit(0.0)) * TRIMMED * F.col("n_words") / (F.col("n_words") + SHORT)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (shrunk <= CUTOFF)).alias("kept"), F.round(shrunk, 6).alias("distance2"))
