"""Nearness by places: many entities at one place."""

import oracle
import pytest
from pyspark.sql import functions as F

from wayfold.functions.geo import haversine
from wayfold.operators import graph
from wayfold.operators import knowledge as kn
from wayfold.plans.queries import ORACLES, QUERIES
from wayfold.session import TABLES


def test_many_at_one_place_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(kn, "GROUP", 3)
    monkeypatch.setattr(kn, "TASK_PAIRS", 2)
    rows = [(i, 10.0 + i % 4 * 0.1, 20.0) for i in range(40)] + [(None, 10.0, 20.0), (99, None, 20.0), (98, 10.0, None)]
    a = spark.createDataFrame(rows, "id long, lat double, lon double")
    b = spark.createDataFrame([(i + 1000, 10.05, 20.0 + i % 2 * 0.3) for i in range(25)], "id long, lat double, lon double")
    got = sorted((tuple(r) for r in kn.near(a, b, 12.0).collect()), key=repr)
    x, y = a.toDF("a", "lat1", "lon1"), b.toDF("b", "lat2", "lon2")
    every = x.crossJoin(y).select("a", "b", haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("km")).where("km <= 12")
    assert got == sorted((tuple(r) for r in every.collect()), key=repr) and len(got) == 21 * 13
    # tasks grow with the pairs
    assert kn.near(a, b, 12.0).rdd.getNumPartitions() == -(-len(got) // 2)
    places = kn.near_places(a, b, 12.0)
    assert places.count() == 2 and places.agg(F.sum(F.col("n1") * F.col("n2"))).first()[0] == len(got)


@pytest.fixture(scope="module")
def copies(spark, sf, tmp_path_factory):
    """Every hotel three times: itself again, and another one at the same place (places repeat after 10,500 keys)."""
    at = tmp_path_factory.mktemp("copies")
    for name in TABLES:
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        if name == "supplier":
            df = df.unionByName(df).unionByName(df.withColumn("s_suppkey", F.col("s_suppkey") + 10500))
        df.write.parquet(f"{at}/{name}.parquet")
    return str(at)


def _connect(at):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", ["graph_build", "graph_export"])
def test_edges_of_repeated_rows_equal_sql(spark, copies, name):
    assert oracle.compare(QUERIES[name](spark, copies), _connect(copies), ORACLES[name]) == ""


def test_components_go_by_places(spark, copies, sf, monkeypatch):
    seen, own = [], graph.components
    monkeypatch.setattr(graph, "components", lambda e: seen.append(e.count()) or own(e))
    first = {r.node: r.root for r in QUERIES["graph_components"](spark, sf).collect()}
    again = {(r.node, r.root) for r in QUERIES["graph_components"](spark, copies).collect()}
    assert again == {(n + i, root) for n, root in first.items() for i in (0, 10500)} and seen[0] == seen[1]
