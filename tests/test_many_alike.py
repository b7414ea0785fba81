"""Operators over rows that pile up at few places: their work follows the different places, and no number of rows is refused."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph.operators import graph, matching, planning, spatial


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_weights_of_decisions_need_no_join(spark):
    one = F.sequence(F.lit(1), F.lit(3))
    m = spark.range(2).select(F.col("id").alias("decision"), F.explode(one).alias("i")).select("*", F.explode(one).alias("j"))
    got = planning.ahp(m.withColumn("a", F.when(F.col("i") == F.col("j"), 1.0).when(F.col("i") < F.col("j"), 2.0).otherwise(0.5)))
    assert joins(got) == 0
    a = np.array([[1, 2, 2], [0.5, 1, 2], [0.5, 0.5, 1]])
    w = (a / a.sum(0)).mean(1)
    for r in got.collect():
        assert (r["weight"], r["lambda_max"]) == pytest.approx((w[r["i"] - 1], (a @ w / w).mean()))
        assert r["is_consistent"] and r["consistency_ratio"] == pytest.approx(((a @ w / w).mean() - 3) / 2 / 0.58)


def test_landing_sites_and_obstacles_at_one_place_each(spark):
    """800 million pairs of rows, one of places."""
    sites = spark.range(20_000).select(F.col("id").alias("site_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(10.0).alias("z"))
    o = spark.range(40_000).select(F.col("id").alias("obstacle_id"), F.lit(0.0).alias("ox"), F.lit(100.0).alias("oy"), (30.0 + F.col("id") % 2).alias("oz"))
    # One obstacle stands at two places, and one has no number.
    o = o.union(spark.createDataFrame([(0, 100.0, 0.0, 90.0), (None, 0.0, 100.0, 60.0)], "obstacle_id long, ox double, oy double, oz double"))
    got = planning.landing_zones(sites, o)
    assert got.count() == 20_000
    assert got.drop("site_id").distinct().collect() == [(90.0 - 10.0 - 70.0 / 8, 40_000, 6, False)]


def test_flights_over_one_line_and_buildings_of_one_box(spark):
    """600 million pairs of samples and buildings, six of lines and boxes."""
    f = spark.range(20_000).select(F.col("id").alias("flight_id"), *[F.lit(v).alias(c) for c, v in zip(("x0", "y0", "z0", "x1", "y1", "z1"), (0.0, 0.0, 5.0, 60.0, 0.0, 5.0), strict=True)])
    b = spark.range(10_000).select(F.lit(-50.0).alias("bx0"), F.lit(-50.0).alias("by0"), F.lit(90.0).alias("bx1"), F.lit(90.0).alias("by1"), (F.col("id") % 41).cast("double").alias("height"))
    got = planning.drone_corridor(f, b)
    assert got.count() == 20_000
    assert got.select("distance_m", "clearance_m").distinct().collect() == [(60.0 + 60.0 + 60.0, 20.0)]


def test_obstacles_near_two_points_of_a_route_count_once(spark):
    points = [(1, k, x, 0.0, 0.0) for k, x in enumerate((0.0, 100.0, 200.0))] + [(2, k, x, 0.0, 0.0) for k, x in enumerate((0.0, 10.0, 10.0, 300.0))] + [(3, 0, 0.0, 500.0, 0.0), (3, 1, 50.0, 500.0, 0.0)]
    kinds = [(k, 5.0, 5.0, 4.0 if k % 2 else 5.0, 30.0 + k % 20, k % 3 == 0) for k in range(2000)] + [(1, 100.0, 0.0, 4.0, 31.0, False)]
    got = planning.truck_clearance(
        spark.createDataFrame(points, "route_id long, seq long, x double, y double, z double"),
        spark.createDataFrame(kinds, "obstacle_id long, ox double, oy double, max_height double, max_tons double, no_hazmat boolean"), hazmat=True,
    )
    want = (1000, 1000, 667)
    got = {r["route_id"]: (r["height_violations"], r["weight_violations"], r["hazmat_violations"], r["is_feasible"]) for r in got.collect()}
    # The obstacle at two places is near two points of the first route.
    assert got == {1: (*want, False), 2: (*want, False), 3: (0, 0, 0, True)}


def test_inverse_distances_from_any_number_of_stations(spark):
    """A million stations and more are taken, at the few places where they stand."""
    known = spark.range(1_000_001).select((F.col("id") % 2).cast("double").alias("px"), F.lit(0.0).alias("py"), (F.col("id") % 2 * 10).cast("double").alias("pz"))
    targets = spark.createDataFrame([(k, 0.5, 0.0) for k in range(300)] + [(1000, 1.0, 0.0)], "id long, x double, y double")
    got = {r["id"]: r["value"] for r in spatial.inverse_distance(targets, known).collect()}
    assert len(got) == 301 and got[1000] == 10.0
    assert got[7] == pytest.approx(10.0 * 500_000 / 1_000_001)


def test_evacuations_past_any_number_of_musters_and_hazards(spark):
    o = spark.createDataFrame([(1, 0.0, 0.0, 10.0)], "origin_id long, x double, y double, z double")
    m = spark.range(2100).select((F.col("id") + 1).alias("muster_id"), F.when(F.col("id") % 2 == 0, 300.0).otherwise(-400.0).alias("x"), F.lit(0.0).alias("y"), F.lit(10.0).alias("z"))
    h = spark.range(2000).select(F.lit(150.0).alias("hx"), F.lit(0.0).alias("hy"), (F.col("id") % 60).cast("double").alias("radius"))
    (r,) = planning.evacuate(o, m, h).collect()
    # Samples of the way to the first muster are at 0, 100, 200 and 300 m, 50 m from the middle of a hazard of 59 m.
    assert (r["muster_id"], r["distance_m"], r["clearance_m"]) == (2, 400.0, 150.0 - 59.0)


def test_tours_of_many_stops_at_few_places(spark):
    """As worked out stop by stop, with stops that share places; and 60,000 stops at 50 places are ordered as soon."""
    stops = [(s, 27.1 + s * 7 % 11 * 0.001, 38.4 + s * 13 % 11 * 0.0013) for s in range(60)]
    df = spark.createDataFrame([(1, *s) for s in stops], "tour_id long, seq long, lon double, lat double")
    lon, lat = (np.radians([s[c] for s in stops]) for c in (1, 2))
    a = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    d = 2 * 6371008.8 * np.arcsin(np.sqrt(a))
    order, rest, n = [0], set(range(1, 60)), 60
    while rest:
        order.append(min(rest, key=lambda k: (d[order[-1], k], k)))
        rest.remove(order[-1])
    end = lambda i, k: d[i, order[k + 1]] if k + 1 < n else 0
    while gain := next(((i, k) for i in range(1, n - 1) for k in range(i + 1, n) if d[order[i - 1], order[i]] + end(order[k], k) - d[order[i - 1], order[k]] - end(order[i], k) > 0.01), None):
        order[gain[0] : gain[1] + 1] = order[gain[0] : gain[1] + 1][::-1]
    got = planning.tour_order(df).collect()
    assert [r["seq"] for r in sorted(got, key=lambda r: r["position"])] == order
    many = spark.range(60_000).select(F.lit(1).cast("long").alias("tour_id"), F.col("id").alias("seq"), (27.1 + F.col("id") % 50 * 0.001).alias("lon"), F.lit(38.4).alias("lat"))
    got = planning.tour_order(many)
    assert got.agg(F.count_distinct("position"), F.max("position")).first() == (60_000, 59_999)


def test_places_of_many_points_are_looked_up_once(spark):
    """400 million pairs of points and segments, of which one place meets 20,000."""
    at = spark.range(20_000).select("id", F.lit(27.1).alias("lon"), F.lit(38.4).alias("lat"))
    s = spark.range(20_000).select(F.lit(1).alias("route_id"), F.col("id").alias("seq"), F.lit(27.1).alias("lon1"), (38.4001 + F.col("id") * 1e-9).alias("lat1"), F.lit(1.0).alias("z1"), F.lit(27.1001).alias("lon2"), (38.4001 + F.col("id") * 1e-9).alias("lat2"), F.lit(1.0).alias("z2"))
    got = spatial.corridor_distance(at, s, 50.0)
    assert got.count() == 20_000 and got.select("dist_m").distinct().first()["dist_m"] == pytest.approx(11.054, abs=1e-3)


def test_stops_of_many_routes_at_two_places_are_looked_up_twice(spark, monkeypatch):
    looked, within = [], spatial.within
    monkeypatch.setattr(spatial, "within", lambda places, *a: looked.append(places.count()) or within(places, *a))
    nodes = spark.range(200).select("id", (27.0 + F.col("id") % 20 * 0.0001).alias("lon"), (38.0 + F.floor(F.col("id") / 20) * 0.0001).alias("lat"), F.lit(0.0).alias("z"))
    member = nodes.select(F.col("id").alias("node"), (F.col("id") % 2).alias("component"))
    stops = spark.range(20_000).select((F.col("id") / 2).cast("long").alias("route_id"), (F.col("id") % 2).alias("seq"), (27.0 + F.col("id") % 2 * 0.0002).alias("lon"), F.lit(38.0).alias("lat"))
    got = graph.shared_stops(stops, nodes, member, 300.0)
    assert got.count() == 20_000
    # The component of even nodes has one at each place.
    assert sorted(map(tuple, got.select("seq", "node", "component").distinct().collect())) == [(0, 0, 0), (1, 2, 0)]
    assert looked == [2]


def test_points_of_many_tracks_at_few_places_meet_segments_once(spark, monkeypatch):
    looked, near = [], spatial.near_segments
    spy = lambda points, *a: looked.append(points.count()) or near(points, *a)
    monkeypatch.setattr(spatial, "near_segments", spy)
    monkeypatch.setattr(matching, "near_segments", spy)
    points = spark.range(60).select((F.col("id") / 3).cast("long").alias("track_id"), (F.col("id") % 3).alias("seq"), (27.0 + F.col("id") % 3 * 0.0002).alias("lon"), F.lit(38.0).alias("lat"))
    lines = [(1, 2, 27.0, 38.0001, 27.0003, 38.0001), (2, 1, 27.0003, 38.0001, 27.0, 38.0001), (2, 3, 27.0003, 38.0001, 27.0005, 38.0001)]
    edges = spark.createDataFrame(lines, "u long, v long, lon1 double, lat1 double, lon2 double, lat2 double")
    nodes = spark.createDataFrame([(1, 27.0, 38.0001), (2, 27.0003, 38.0001), (3, 27.0005, 38.0001)], "id long, lon double, lat double")
    got = spatial.segments_in_reach(points, edges, 35.0, "track_id", "seq")
    assert got.count() == 60
    assert {(r["seq"], r["n"]) for r in got.select("seq", "n").distinct().collect()} == {(0, 3), (1, 3), (2, 3)}
    assert got.agg(F.max("dist_m")).first()[0] < 15.0
    matched = matching.match_tracks(points, edges, nodes, gap_s=None)
    assert matched.count() == 60
    assert matched.select("seq", "u", "v").distinct().count() == 3
    assert looked == [3, 3]
