import oracle
import pytest
from pyspark.sql import functions as F

from wayfold.functions import text as tx
from wayfold.operators import dedup, evaluate, graph, vectors as vs
from wayfold.operators import knowledge as kn
from wayfold.plans import kb
from wayfold.plans.queries import ORACLES, QUERIES
from wayfold.sources import readers, sinks
from wayfold.streaming import events as streams


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert oracle.compare(df, con, ORACLES[name]) == ""
    else:
        assert df.count() > 0


def test_grid_equals_brute_force_over_the_antimeridian(spark):
    from wayfold.functions.geo import haversine

    pts = spark.createDataFrame([(i, -10.0 + i * 0.21, ((179.0 + i * 0.13 + 180) % 360) - 180) for i in range(40)], "id long, lat double, lon double")
    got = {(r.a_id, r.b_id) for r in kn.near(pts, pts, 60.0).collect()}
    x, y = pts.toDF("a", "lat1", "lon1"), pts.toDF("b", "lat2", "lon2")
    want = {(r.a, r.b) for r in x.crossJoin(y).where(haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")) <= 60).collect()}
    assert got == want and {(b, a) for a, b in got} == got


def test_as_of_keeps_null_columns_and_takes_the_latest_value(spark):
    items = spark.createDataFrame([(1, None, 5), (2, "x", 5), (2, "x", 5), (None, "y", 5), (3, "z", None), (4, "w", 1)], "k int, note string, at int")
    log = spark.createDataFrame([(1, 3, 10), (1, 4, 20), (1, 4, 15), (1, 9, 30), (2, 5, 7), (None, 1, 8), (3, 1, 9), (4, 2, 1)], "k int, ts int, v int")
    got = sorted(((r.k, r.note, r["at"], r.v) for r in kn.as_of(items, log, "k", "at", "ts", "v").collect()), key=repr)
    assert got == sorted([(1, None, 5, 20), (2, "x", 5, 7), (2, "x", 5, 7), (None, "y", 5, None), (3, "z", None, None), (4, "w", 1, None)], key=repr)


@pytest.mark.parametrize("name", ["filter_price", "fuzzy_name", "link_mentions", "co_mention_edges"])
def test_selective_queries_are_not_empty(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_open_past_midnight(spark):
    df = spark.sql("SELECT array(named_struct('dow', 5, 'open_min', 1320, 'close_min', 1560)) AS hours")
    assert [df.where(kn.open_at(F.col("hours"), d, m)).count() for d, m in ((5, 1400), (6, 60), (6, 120), (5, 60))] == [1, 1, 0, 0]


def test_vietnamese_text(spark):
    df = spark.createDataFrame([("Hà Nội", "Hà Nội", "ha noi")], "a string, b string, c string")
    r = df.select(tx.nfc(F.col("a")) == tx.nfc(F.col("b")), tx.same_folded(F.col("a"), F.col("b")), tx.same_folded(F.col("a"), F.col("c"))).first()
    assert tuple(r) == (True, True, True)


def test_ivf_with_all_lists_is_exact_and_lsh_recalls(spark, sf, tmp_path):
    v, q = kb.vectors(spark, sf), kb.query_vectors(spark, sf)
    exact = {(r.q, r.node) for r in vs.knn_exact(q, v, 10).collect()}
    index = vs.ivf_write(v, f"{tmp_path}/ivf", 4)
    assert {(r.q, r.node) for r in index.search(q, 10, 4).collect()} == exact
    for df in (QUERIES["knn_lsh"](spark, sf), QUERIES["knn_ivf"](spark, sf)):
        assert len({(r.q, r.node) for r in df.collect()} & exact) >= 0.9 * len(exact)


def test_expansion_does_not_depend_on_partitions(spark):
    e = spark.createDataFrame([(a, b) for a in range(6) for b in range(6) if a != b], "src long, dst long")
    s = spark.createDataFrame([(1, 0, 1.0)], "q long, node long, score double")
    assert {tuple(r) for r in graph.expand(s, e, 2, 3).collect()} == {tuple(r) for r in graph.expand(s.repartition(3), e.repartition(7), 2, 3).collect()}


def test_sources_and_sinks(spark, tmp_path):
    spark.dataSource.register(readers.JsonLinesSource)
    df = spark.read.format("wayfold_jsonl").option("lines", '{"id": "a", "name": "x"}\n{"id": "b"}').load()
    assert {tuple(r) for r in df.collect()} == {("a", "x", None), ("b", None, None)}
    sinks.write_processed(df.withColumn("type", F.lit("hotel")), f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").where("type = 'hotel'").count() == 2
    page = readers.parse_html(spark.createDataFrame([("http://a.example/x", "<title>T</title><script>no()</script><p>yes</p>")], "url string, html string")).first()
    assert (page.title, page.host, page.body_text) == ("T", "a.example", "T yes")


def test_near_equal_texts(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join([*words[:-1], "x"])), (4, "other words than those"), (5, None), (6, ""), (7, None)]
    got = {tuple(r) for r in dedup.near_equal(spark.createDataFrame(rows, "i long, t string"), "i", "t").collect()}
    # a null and an empty text have no shingles, so that they link with nothing
    assert {r for r in got if r[0] < 5} == {(1, 1, 1), (2, 1, 1), (3, 3, 1), (4, 4, 0)}
    assert {(r[0], r[2]) for r in got if r[0] > 4} == {(5, 0), (6, 0), (7, 0)}


def test_evaluation_against_a_golden_set(spark):
    run = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 1), (1, "a", 5)], "q long, node string, rank int")
    golden = spark.createDataFrame([(1, "b"), (1, "d"), (2, "y"), (3, "z"), (1, "b")], "q long, node string")
    got = {r.q: (r.precision, r.recall, r.rr, r.ndcg) for r in evaluate.evaluate(run, golden, 3).collect()}
    assert got == {1: (0.333333, 0.5, 0.5, 0.386853), 2: (0.0, 0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0, 0.0)}
    kb_rows = spark.createDataFrame([("h1", "Blue House", 4.5), ("h2", None, 3.0)], "id string, name string, rating double")
    facts = spark.createDataFrame([("h1", "name", "Blue House"), ("h2", "name", "Red House"), ("h2", "rating", "3.0"), ("h9", "rating", "1.0")], "id string, attribute string, value string")
    assert {(r.attribute, r.facts, r.accuracy) for r in evaluate.fact_accuracy(kb_rows, facts).collect()} == {("name", 2, 0.5), ("rating", 2, 0.5)}


def test_exports_and_raw_records_come_back(spark, tmp_path):
    nodes, edges = spark.sql("SELECT 'a' AS id"), spark.sql("SELECT 'a' AS src_id, 'b' AS dst_id")
    sinks.export_graph(nodes, edges, f"{tmp_path}/g", "csv")
    assert [spark.read.option("header", "true").csv(f"{tmp_path}/g/{n}").collect() for n in ("nodes", "edges")] == [nodes.collect(), edges.collect()]
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1)], "id long, vec array<double>, centroid int")
    sinks.export_index(vectors, vectors.select("centroid", "vec"), f"{tmp_path}/i")
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/i/vectors").where("centroid = 1").collect()] == [2]
    assert spark.read.json(f"{tmp_path}/i/manifest").first().nlist == 2
    (tmp_path / "raw.json").write_text('{"id": 1}\n{"id": oops\n')
    raw = readers.read_raw(spark, f"{tmp_path}/raw.json", "json", "id long, _corrupt_record string")
    assert sorted((r.id is None, r._corrupt_record) for r in raw.collect()) == [(False, None), (True, '{"id": oops')]


def test_streams_go_on_where_they_ended_and_drop_what_is_late(spark, tmp_path):
    def add(rows):
        spark.createDataFrame(rows, "event_id long, user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def go():
        stream = streams.read_events(spark, f"{tmp_path}/in", "10 minutes").withColumn("event_type", F.lit("e"))
        return sorted((r.start.hour, r.n) for r in streams.run(streams.windows(stream, "1 hour"), f"{tmp_path}/out").collect())

    add([(1, 1, "2024-01-01 00:10:00", 1.0), (2, 1, "2024-01-01 00:50:00", 1.0), (3, 1, "2024-01-01 02:00:00", 1.0)])
    assert go() == [(0, 2)]
    # one event for a closed window, which is dropped, and one that closes the window of two o'clock
    add([(4, 1, "2024-01-01 00:20:00", 1.0), (5, 1, "2024-01-01 04:00:00", 1.0)])
    assert go() == [(0, 2), (2, 1)]
    once = streams.run(streams.first_of(streams.read_events(spark, f"{tmp_path}/in", "1 day"), "user_id"), f"{tmp_path}/once")
    assert once.count() == 1


def test_shingles_of_one_class_are_not_moved(spark, monkeypatch):
    plans, own = [], dedup.stored
    monkeypatch.setattr(dedup, "stored", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or own(df))
    words = [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-1], "x"])), (3, " ".join(words[30:])), (4, "alone")], "id long, text string")
    assert {tuple(r) for r in dedup.near_equal(df, "id", "text").collect()} == {(1, 1, 1), (2, 2, 1), (3, 3, 0), (4, 4, 0)}
    assert "Window" in plans[1] and "LeftOuter" not in plans[1]
