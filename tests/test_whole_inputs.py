"""Queries look at all rows of their inputs."""

from pyspark.sql import functions as F

from orograph import catalog
from orograph.plans import graph_queries, spatial_queries
from orograph.sources.fixtures import load


def test_matched_tracks_goes_on_after_forty_points(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    want = {r["user_id"]: r["n"] for r in n.where("n > 1").collect()}
    got = catalog.QUERIES["matched_tracks"](spark, sf_dir).groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    assert {r["track_id"]: r["n"] for r in got.collect()} == want
    assert max(want.values()) > 40


def test_graph_queries_take_all_pairs_zones_and_nodes(spark, sf_dir, monkeypatch):
    seen = {}

    def routes(edges, queries, profile, **more):
        seen["route_paths"] = (queries.count(), more)
        return queries

    def alternatives(edges, queries, profile):
        seen["alternative_routes"] = queries.count()
        return queries

    def evacuation(edges, nodes, origins, musters, hazards):
        seen["network_evacuation"] = origins.count()
        return origins

    def frontier(vectors, queries, epsilon):
        seen["tradeoff_routes"] = queries.count()
        return queries.withColumn("path", F.array("src"))

    monkeypatch.setattr(graph_queries.graph, "routes", routes)
    monkeypatch.setattr(graph_queries.graph, "alternatives", alternatives)
    monkeypatch.setattr(graph_queries.graph, "network_evacuation", evacuation)
    monkeypatch.setattr(graph_queries.pareto, "frontier", frontier)
    monkeypatch.setattr(graph_queries.pareto, "archetypes", lambda found: found)
    for name in ("route_paths", "alternative_routes", "network_evacuation", "tradeoff_routes"):
        catalog.QUERIES[name](spark, sf_dir)
    n = load(spark, sf_dir, "nodes")
    two = n.select((F.col("gx") - 2).alias("gx"), (F.col("gy") - 2).alias("gy"))
    pairs = graph_queries._pairs(spark, sf_dir).count()
    assert seen["route_paths"] == (pairs, {})
    assert seen["alternative_routes"] == pairs
    assert seen["network_evacuation"] == graph_queries._zone_nodes(spark, sf_dir).count()
    assert seen["tradeoff_routes"] == n.join(two, ["gx", "gy"]).count()


def test_straight_evacuations_take_all_musters_and_hazards(spark, sf_dir, monkeypatch):
    """Only facilities of capacity 90 and more and hazards of 68 m and more were looked at."""
    seen, evacuate = [], spatial_queries.planning.evacuate
    monkeypatch.setattr(spatial_queries.planning, "evacuate", lambda o, m, h: seen.append((o.count(), m.count(), h.count())) or evacuate(o, m, h))
    rows = [spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("supplier", "part")]
    for name in ("evacuate_straight", "evacuation_summary"):
        assert catalog.QUERIES[name](spark, sf_dir).count() > 0
    assert seen == [(load(spark, sf_dir, "zones").count(), *rows)] * 2
    assert not any(" WHERE " in line and ("capacity" in line or "radius_m>" in line) for name in ("evacuate_straight", "evacuation_summary") for line in catalog.ORACLE[name].splitlines())
