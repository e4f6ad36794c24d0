"""Relational tables in ranges, records with quarantine, sketches, table functions, and streams with state that ends."""

import glob
import os
import random
import re

from pyspark.sql import functions as F

from wayfold.functions import text as tx
from wayfold.operators import normalize as nz
from wayfold.operators import sketches as sk
from wayfold.operators import vectors as vs
from wayfold.plans.queries import ORDER
from wayfold.session import table
from wayfold.sources import readers, sinks
from wayfold.streaming import events as streams


def test_relational_tables_come_back_in_ranges(spark, sf, tmp_path):
    own = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").repartition(3)
    sinks.write_jdbc(df, url, "customer", **own)
    plain, parts = readers.read_jdbc(spark, url, "customer", **own), readers.read_jdbc(spark, url, "customer", "c_custkey", (0, 150), 5, **own)
    assert (plain.rdd.getNumPartitions(), parts.rdd.getNumPartitions()) == (1, 5)
    rows = lambda d: sorted((r[0], r[1], r[2]) for r in d.collect())
    assert rows(plain) == rows(parts) == rows(df) and len(rows(df)) == 150
    # a filter goes to the database
    few = parts.where("c_custkey < 7")
    assert few.count() == 7 and "PushedFilters" in few._jdf.queryExecution().executedPlan().toString()
    sinks.write_jdbc(df.where("c_custkey < 3"), url, "customer", **own)
    assert readers.read_jdbc(spark, url, "customer", **own).count() == 153


def test_records_are_normalised_or_quarantined(spark, sf):
    mapping = {
        "id": nz.Field("id", "bigint", required=True),
        "price": nz.Field("price", "decimal(8,2)", check=lambda c: c >= 0, told="below 0"),
        "seen": nz.Field(F.col("raw.seen"), "timestamp"),
        "name": nz.Field("nullif(trim(name), '')", "string", required=True, check=lambda c: F.length(c) < 9, told="too long"),
    }
    rows = [("1", "9.50", ("2024-01-01 10:00:00",), "a"), (" 2 ", "", (None,), " b "), ("x", "9,50", ("soon",), ""), (None, "-1", None, "a long name"), ("4", "12345678.00", ("2024-02-30",), "d"), ("5", None, (" ",), "e")]
    df = spark.createDataFrame(rows, "id string, price string, raw struct<seen string>, name string")
    good, bad = nz.normalize(df, mapping)
    assert [(r.id, None if r.price is None else str(r.price), r.seen is not None, r.name) for r in good.orderBy("id").collect()] == [(1, "9.50", True, "a"), (2, None, False, "b"), (5, None, False, "e")]
    assert good.dtypes == [("id", "bigint"), ("price", "decimal(8,2)"), ("seen", "timestamp"), ("name", "string")]
    assert {(r.id, tuple(r.reasons)) for r in bad.collect()} == {
        ("x", ("id: not bigint", "price: not decimal(8,2)", "seen: not timestamp", "name: missing")),
        (None, ("id: missing", "price: below 0", "name: too long")),
        ("4", ("price: not decimal(8,2)", "seen: not timestamp")),
    }
    assert bad.columns == [*df.columns, "reasons"]
    orders = table(spark, sf, "orders")
    parts = nz.normalize(orders, ORDER)
    assert parts[0].count() + parts[1].count() == orders.count() and parts[0].count() and parts[1].count()
    assert [x.count() for x in nz.normalize(df.limit(0), mapping)] == [0, 0]


def test_sketches_of_parts_merge_to_those_of_the_whole(spark):
    df = spark.range(60_000).select((F.col("id") % 10).alias("day"), (F.col("id") * 7919 % 20_011).alias("user"), F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("x"))
    df = df.unionByName(spark.sql("SELECT 77L AS day, CAST(NULL AS LONG) AS user, CAST(NULL AS DOUBLE) AS x"))
    parts = sk.sketch(df, {"day": F.col("day")}, "user", "x")
    for which in (F.col("day") < 10, F.col("day").isin(2, 5, 6)):
        r = sk.merged(parts.where(which), {"all": F.lit(1)}, [0.1, 0.5, 0.9]).first()
        own = df.where(which)
        users, n = own.agg(F.countDistinct("user"), F.count(F.lit(1))).first()
        assert abs(r.distinct_values - users) <= 0.05 * users and r.n == n
        for share, value in zip((0.1, 0.5, 0.9), r.quantiles, strict=True):
            below = own.where(F.col("x") <= value).count() / own.where("x is not null").count()
            assert abs(below - share) < 0.02
    empty = sk.merged(parts.where("day = 77"), {"all": F.lit(1)}).first()
    assert (empty.distinct_values, empty.quantiles, empty.n) == (0, None, 1)


def test_sentence_chunks_by_table_function(spark, sf):
    spark.udtf.register("sentence_chunks", tx.SentenceChunks)
    rng = random.Random(1)
    texts = ["", None, "no stop", "A. B! C? " * 40, "x" * 1234, "\n\n", *["".join(rng.choice(["word ", "end. ", "long " * 30, "!?", "\n"]) for _ in range(rng.randrange(60))) for _ in range(40)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {}
    for r in spark.sql("SELECT i, chunk, start, piece FROM {d}, LATERAL sentence_chunks(t, 100)", d=df).collect():
        got.setdefault(r.i, []).append((r.chunk, r.start, r.piece))
    for i, t in enumerate(texts):
        pieces = sorted(got.get(i, []))
        assert "".join(p for *_, p in pieces) == (t or "") and [c for c, *_ in pieces] == list(range(len(pieces)))
        assert all(t[s : s + len(p)] == p and 0 < len(p) <= 100 for _, s, p in pieces)
        cuts = {0} | {m.end() for m in re.finditer(r"[.!?\n]+\s*|$", t or "")}
        for (_, s, p), (_, s2, p2) in zip(pieces, pieces[1:], strict=False):
            # a piece ends with a sentence, or the sentence is too long for a piece; a further sentence had no room
            assert s2 in cuts or max(c for c in cuts if c <= s2) <= s or len(p) == 100
            if s2 in cuts:
                assert s2 - s + min(c for c in cuts if c > s2) - s2 > 100


def test_residual_attributes_and_mean_vectors(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": "x", "c": {"d": [1]}}'), (2, '{"a": 2}'), (3, "oops"), (4, None)], "i int, j string")
    assert {r.i: r.m for r in df.select("i", tx.residual(F.col("j"), ["a"]).alias("m")).collect() if r.i != 3} == {1: {"b": "x", "c": '{"d":[1]}'}, 2: {}, 4: None}
    v = spark.createDataFrame([("x", [1.0, 2.0]), ("x", [3.0, 4.0]), ("x", None), ("y", [0.5, 0.5])], "label string, vec array<float>")
    assert {r.label: (r.n, r["mean"]) for r in vs.mean_vectors(v, "label").collect()} == {"x": (2, [2.0, 3.0]), "y": (1, [0.5, 0.5])}


def _add(spark, at, rows):
    spark.createDataFrame(rows, "event_id long, user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(at)


def test_state_of_a_user_ends(spark, tmp_path):
    streams.state_store(spark)
    at = f"{tmp_path}/in"

    def go():
        stream = streams.running_totals(streams.read_events(spark, at, "10 minutes"), 3600)
        query = stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/out/progress").format("parquet").start(f"{tmp_path}/out/data")
        query.awaitTermination()
        kept = spark.read.format("statestore").option("stateVarName", "totals").load(f"{tmp_path}/out/progress")
        return sorted((r.user_id, r.n, r.total, r.ended) for r in spark.read.parquet(f"{tmp_path}/out/data").collect()), {r.key.user_id for r in kept.select("key").collect()}

    _add(spark, at, [(1, 1, "2024-01-01 00:00:00", 1.0), (2, 1, "2024-01-01 00:30:00", 2.0), (3, 2, "2024-01-01 00:10:00", 5.0)])
    rows, users = go()
    assert rows == [(1, 2, 3.0, False), (2, 1, 5.0, False)] and users == {1, 2}
    # the watermark passes both users' last events by more than an hour
    _add(spark, at, [(4, 3, "2024-01-01 04:00:00", 7.0)])
    rows, users = go()
    assert {(1, 2, 3.0, True), (2, 1, 5.0, True), (3, 1, 7.0, False)} <= set(rows) and users == {3}
    _add(spark, at, [(5, 1, "2024-01-01 04:10:00", 9.0)])
    rows, users = go()
    assert (1, 1, 9.0, False) in rows and users == {1, 3}


def test_upserts_count_once_over_a_failure(spark, tmp_path):
    at, out = f"{tmp_path}/in", f"{tmp_path}/table"
    go = lambda: streams.upsert(streams.read_events(spark, at), out, "user_id", "ts")
    now = lambda: sorted((r.user_id, r.event_id) for r in streams.current(spark, out, "user_id", "ts").collect())
    _add(spark, at, [(1, 1, "2024-01-01 00:00:00", 1.0), (2, 1, "2024-01-01 00:30:00", 2.0), (3, 2, "2024-01-01 00:10:00", 5.0)])
    go()
    assert now() == [(1, 2), (2, 3)]
    _add(spark, at, [(4, 2, "2024-01-01 00:50:00", 1.0), (5, 1, "2024-01-01 00:20:00", 1.0)])
    go()
    assert now() == [(1, 2), (2, 4)]
    count = spark.read.parquet(f"{out}/data").count()
    # the last batch was written, but its commit is lost: it runs again and writes the same folder
    last = max(int(os.path.basename(f)) for f in glob.glob(f"{out}/progress/commits/[0-9]*"))
    for f in (f"{out}/progress/commits/{last}", f"{out}/progress/commits/.{last}.crc"):
        if os.path.exists(f):
            os.remove(f)
    go()
    assert now() == [(1, 2), (2, 4)] and spark.read.parquet(f"{out}/data").count() == count


def test_sliding_windows(spark, tmp_path):
    _add(spark, f"{tmp_path}/in", [(1, 1, "2024-01-01 00:10:00", 1.0), (2, 1, "2024-01-01 00:50:00", 2.0), (3, 1, "2024-01-01 05:00:00", 1.0)])
    stream = streams.read_events(spark, f"{tmp_path}/in", "10 minutes").withColumn("event_type", F.lit("e"))
    got = sorted((r.start.strftime("%d %H:%M"), r.n, r.total) for r in streams.run(streams.windows(stream, "1 hour", "30 minutes"), f"{tmp_path}/out").collect())
    assert got == [("01 00:00", 2, 3.0), ("01 00:30", 1, 2.0), ("31 23:30", 1, 1.0)]
