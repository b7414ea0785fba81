"""Tours, trips over hubs, evacuations and areas in reach against the same worked out in plain Python on the smallest grid."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph.operators import graph, planning
from orograph.plans import spatial_queries
from orograph.sources import exports
from orograph.sources.fixtures import load

R = 6371008.8


def metres(a, b):
    (lon1, lat1), (lon2, lat2) = a, b
    h = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(h))


@pytest.fixture(scope="module")
def edges(spark, sf_dir):
    return graph.edges_of(load(spark, sf_dir, "segments")).cache()


@pytest.fixture(scope="module")
def nodes(spark, sf_dir):
    return load(spark, sf_dir, "nodes").cache()


@pytest.fixture(scope="module")
def place(nodes):
    return {r["id"]: (r["lon"], r["lat"]) for r in nodes.collect()}


def test_tours_start_first_visit_all_and_no_reversal_shortens_them(spark):
    stops = [(t, s, 27.1 + (s * s * 7 + t * 5) % 23 * 0.001, 38.4 + (s * 11 + t * 3) % 19 * 0.001) for t, n in ((1, 12), (2, 3), (3, 1), (4, 7)) for s in range(n)]
    got = planning.tour_order(spark.createDataFrame(stops, "tour_id long, seq long, lon double, lat double")).collect()
    at = {(t, s): (lon, lat) for t, s, lon, lat in stops}
    for t, n in ((1, 12), (2, 3), (3, 1), (4, 7)):
        order = [r["seq"] for r in sorted((r for r in got if r["tour_id"] == t), key=lambda r: r["position"])]
        assert sorted(order) == list(range(n)) and order[0] == 0
        if n <= 3:
            assert order == list(range(n))
            continue
        length = lambda o: sum(metres(at[t, a], at[t, b]) for a, b in zip(o, o[1:], strict=False))  # noqa: B023, E731
        near, rest = [0], set(range(1, n))
        while rest:
            near.append(min(rest, key=lambda s: (metres(at[t, near[-1]], at[t, s]), s)))  # noqa: B023
            rest.remove(near[-1])
        assert length(order) <= length(near) + 0.01
        assert all(length(order[:i] + order[i : k + 1][::-1] + order[k + 1 :]) >= length(order) - 0.011 for i in range(1, n - 1) for k in range(i + 1, n))


def test_tours_are_shortened_until_no_reversal_gains(spark, sf_dir):
    """After 200 reversals the others were left out; and ten tours whatever the table's size left one facility each of the smallest."""
    rng = random.Random(7)
    at = [(27.1 + rng.random() * 0.03, 38.4 + rng.random() * 0.03) for _ in range(1200)]
    got = planning.tour_order(spark.createDataFrame([(1, s, *p) for s, p in enumerate(at)], "tour_id long, seq long, lon double, lat double")).collect()
    order = [r["seq"] for r in sorted(got, key=lambda r: r["position"])]
    assert sorted(order) == list(range(1200)) and order[0] == 0
    x, y = (np.radians([at[s][c] for s in order]) for c in (0, 1))
    a = np.sin((y[:, None] - y) / 2) ** 2 + np.cos(y[:, None]) * np.cos(y) * np.sin((x[:, None] - x) / 2) ** 2
    d = np.pad(2 * R * np.arcsin(np.sqrt(a)), (0, 1))  # nothing comes after the last
    i, k = np.triu_indices(1200, 1)
    on = lambda at, k: np.where(k < 1199, d[at, k + 1], 0)
    gains = d[i - 1, i] + on(k, k) - d[i - 1, k] - on(i, k)
    assert gains[i > 0].max() <= 0.0101
    tours = spatial_queries.tour_order(spark, sf_dir).groupBy("tour_id").agg(F.count_distinct("position").alias("n"), F.max("position").alias("last")).collect()
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    assert sum(t["n"] for t in tours) == n and all(t["n"] == t["last"] + 1 for t in tours) and len(tours) <= n / 500 + 1


def test_trips_take_the_hubs_nearest_to_their_ends(spark, edges, nodes, place):
    trips, hubs = [(1, 5, 140), (2, 140, 20), (3, 77, 78)], [3, 66, 131]
    legs = {}
    for k, src, dst in trips:
        a = min(hubs, key=lambda h: (metres(place[src], place[h]), h))
        b = min((h for h in hubs if h != a), key=lambda h: (metres(place[dst], place[h]), h))
        legs[k] = (("adult", src, a, 2.0), ("car", a, b, 3.0), ("adult", b, dst, 0.0))
    ways = {}
    for mode in ("adult", "car"):
        ends = [(s, d) for ll in legs.values() for m, s, d, _ in ll if m == mode]
        o = spark.createDataFrame(sorted({(s, s) for s, _ in ends}), "origin_id long, node long")
        d = spark.createDataFrame(sorted({(d, d) for _, d in ends}), "destination_id long, node long")
        for r in graph.matrix(edges, o, d, mode).collect():
            ways[mode, r["origin_id"], r["destination_id"]] = (r["seconds"], r["length_m"])
    want = {}
    for k, ll in legs.items():
        if all((m, s, d) in ways for m, s, d, _ in ll):
            want[k] = (sum(ways[m, s, d][0] / 60 + wait for m, s, d, wait in ll), sum(ways[m, s, d][1] for m, s, d, _ in ll), 2)
    got = graph.multimodal(edges, spark.createDataFrame(trips, "trip_id long, src long, dst long"), spark.createDataFrame([(h,) for h in hubs], "hub long"), nodes).collect()
    assert want and {r["trip_id"] for r in got} == set(want)
    for r in got:
        assert (r["minutes"], r["length_m"], r["transfers"]) == pytest.approx(want[r["trip_id"]])


def test_evacuations_take_the_muster_with_least_time_and_risk(spark, edges, nodes, place):
    origins, musters = [(1, 20), (2, 77)], [(1, 5), (2, 140)]
    hazards = [(place[41][0], place[41][1], 120.0, 3.0), (place[100][0], place[100][1], 90.0, 500.0)]
    seconds = {}
    for r in graph.weighted(edges).select("u", "v", "cost", "seconds").collect():
        seconds[r["u"], r["v"]] = min((r["cost"], r["seconds"]), seconds.get((r["u"], r["v"]), (math.inf, 0)))
    q = spark.createDataFrame([(10 * o + m, a, b) for o, a in origins for m, b in musters], "query_id long, src long, dst long")
    paths = {}
    for r in sorted(graph.routes(edges, q).collect(), key=lambda r: r["pos"]):
        paths.setdefault(r["query_id"], []).append(r["node"])
    want = {}
    for k, path in paths.items():
        samples = [place[path[0]]]
        for a, b in zip(path, path[1:], strict=False):
            n = max(1, math.ceil(metres(place[a], place[b]) / 10))
            samples += [(place[a][0] + i / n * (place[b][0] - place[a][0]), place[a][1] + i / n * (place[b][1] - place[a][1])) for i in range(1, n + 1)]
        clear = [(metres(s, h[:2]) - h[2], h[3]) for s in samples for h in hazards]
        risk = sum(-c * w for c, w in clear if c < 0)
        minutes = sum(seconds[e][1] for e in zip(path, path[1:], strict=False)) / 60
        least = min(c for c, _ in clear)
        want[k // 10] = min(want.get(k // 10, (math.inf,)), (minutes + risk / 60, k % 10, minutes, risk, least))
    got = graph.network_evacuation(
        edges, nodes, spark.createDataFrame(origins, "origin_id long, node long"), spark.createDataFrame(musters, "muster_id long, node long"),
        spark.createDataFrame(hazards, "hlon double, hlat double, radius_m double, severity double"),
    ).collect()
    assert want and {r["origin_id"] for r in got} == set(want)
    for r in got:
        w = want[r["origin_id"]]
        assert r["muster_id"] == w[1] and (r["minutes"], r["risk"]) == pytest.approx(w[2:4], rel=1e-6)
        assert r["clearance_m"] == pytest.approx(w[4], abs=1e-3)


def test_areas_in_reach_are_those_of_the_hull_of_all_nodes(spark, edges, nodes, place):
    origins = spark.createDataFrame([(20, 20), (77, 77)], "src long, node long")
    costs = graph.least_costs(graph.weighted(edges), origins, "seconds", 600.0).collect()
    got = graph.isochrones(edges, origins, nodes, [5.0, 10.0]).collect()
    assert len(got) == 4
    for r in got:
        reached = sorted({place[c["node"]] for c in costs if c["src"] == r["src"] and c["cost"] <= r["cutoff_min"] * 60})
        cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
        hull = []
        for points in (reached, reached[::-1]):
            side = []
            for p in points:
                while len(side) > 1 and cross(side[-2], side[-1], p) <= 0:
                    side.pop()
                side.append(p)
            hull += side[:-1]
        mean = sum(p[1] for p in hull) / len(hull)
        k = math.pi / 180 * 6371000.0
        area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(hull, hull[1:] + hull[:1], strict=True))) * k * k * math.cos(math.radians(mean)) / 2
        assert r["node_count"] == len(reached) and r["area_ha"] == pytest.approx(area / 1e4 if len(hull) > 2 else 0.0, rel=1e-6)


def test_ends_without_a_shared_component_go_to_the_nearest_node(spark):
    nodes = spark.createDataFrame([(1, 27.10, 38.40), (2, 27.11, 38.40), (3, 27.1002, 38.40)], "id long, lon double, lat double")
    member = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "node long, component long")
    trips = spark.createDataFrame([(1, 27.1002, 38.4, 27.11, 38.4), (2, 27.1002, 38.4, 28.0, 38.4), (3, 29.0, 38.4, 28.0, 38.4)], "query_id long, olon double, olat double, dlon double, dlat double")
    got = {r["query_id"]: r for r in graph.shared_ends(trips, nodes, member, 300.0).collect()}
    assert [(got[k]["src"], got[k]["dst"]) for k in (1, 2, 3)] == [(1, 2), (3, None), (None, None)]
    assert got[1]["dist_m"] == pytest.approx(metres((27.1002, 38.4), (27.10, 38.4))) and got[2]["dist_m"] is None
    assert graph.shared_ends(trips.where(F.lit(False)), nodes, member).count() == 0


def test_all_stops_of_a_route_join_one_component_where_they_can(spark):
    nodes = spark.createDataFrame([(1, 27.10, 38.40), (2, 27.11, 38.40), (4, 27.12, 38.40), (3, 27.1002, 38.40), (5, 27.1102, 38.40)], "id long, lon double, lat double")
    member = spark.createDataFrame([(1, 1), (2, 1), (4, 1), (3, 3), (5, 3)], "node long, component long")
    three = [(27.1002, 38.4), (27.1102, 38.4), (27.12, 38.4)]
    rows = [(1, i, *p) for i, p in enumerate(three)] + [(2, i, *p) for i, p in enumerate(three[:2])]
    rows += [(3, 0, 27.1002, 38.4), (3, 1, 28.0, 38.4), (4, 0, 27.12, 38.4), (4, 1, None, 38.4), (2, 0, *three[0]), (None, 0, 27.12, 38.4)]
    stops = spark.createDataFrame([(*x, "n") for x in rows], "route_id long, seq int, lon double, lat double, node string")
    got = sorted(((x["route_id"] or 0, x["seq"], x["node"], x["component"]) for x in graph.shared_stops(stops, nodes, member, 300.0).collect()), key=repr)
    # The third stop is near to the first island only, so the others go there too; two stops stay where they are nearest, and none is shared by the third and fourth routes.
    assert got == sorted([(1, 0, 1, 1), (1, 1, 2, 1), (1, 2, 4, 1), (2, 0, 3, 3), (2, 1, 5, 3), (3, 0, 3, 3), (3, 1, None, None), (4, 0, 4, 1), (4, 1, None, None), (0, 0, 4, 1)], key=repr)
    assert graph.shared_stops(stops.limit(0), nodes, member).count() == 0


def test_bands_become_polygons_the_widest_first_and_lines_have_none(spark):
    square = [(27.1, 38.4), (27.11, 38.4), (27.11, 38.41), (27.1, 38.41)]
    rows = [(1, 5.0, 2, 0.0, square[:2]), (1, 10.0, 9, 96.714, square)]
    bands = spark.createDataFrame(rows, "src long, cutoff_min double, node_count long, area_ha double, ring array<struct<lon:double,lat:double>>")
    (row,) = exports.band_collections(bands).collect()
    got = json.loads(row["value"])
    assert got["properties"] == {"profile_key": "adult", "total_reachable_nodes": 9}
    wide, narrow = got["features"]
    assert wide["geometry"] == {"type": "Polygon", "coordinates": [[list(p) for p in [*square, square[0]]]]}
    assert wide["properties"] == {"time_cutoff_min": 10.0, "reachable_node_count": 9, "approx_area_ha": 96.71, "area_sqkm": 0.9671, "boundary_points_count": 4}
    assert narrow["geometry"] is None and narrow["properties"]["boundary_points_count"] == 2


def test_summary_of_an_evacuation_counts_people_and_takes_the_least_of_ties(spark):
    plan = spark.createDataFrame([(1, 7, 10.0), (2, 5, 20.0), (3, 5, 60.0)], "origin_id long, muster_id long, minutes double")
    origins = spark.createDataFrame([(1, 100.0), (2, None), (3, 50.0)], "origin_id long, population double")
    assert tuple(planning.evacuation_summary(plan, origins).first()) == (200.0, 30.0, 60.0, 5)
    none = planning.evacuation_summary(plan.limit(0), origins.limit(0)).first()
    assert tuple(none) == (0.0, 0.0, 0.0, None)


def test_legs_of_one_profile_are_one_search(spark, edges, sf_dir, monkeypatch):
    """Access and egress on foot were searched one after the other."""
    asked, measured = [], graph.measured
    monkeypatch.setattr(graph, "measured", lambda e, pairs, mode: asked.append(mode) or measured(e, pairs, mode))
    trips = spark.createDataFrame([(1, 0, 140), (2, 140, 3)], "trip_id long, src long, dst long")
    hubs = spark.createDataFrame([(30,), (100,)], "hub long")
    got = graph.multimodal(edges, trips, hubs, load(spark, sf_dir, "nodes")).collect()
    assert sorted(asked) == ["adult", "car"]
    assert sorted(r["trip_id"] for r in got) == [1, 2] and {r["transfers"] for r in got} == {2}


def test_segments_are_made_once_and_costs_are_not_worked_out_in_a_filter(spark, sf_dir):
    """A filter on costs was moved to where segments are made, for either way, and told lengths anew for each mention."""
    plan = graph.weighted(graph.edges_of(load(spark, sf_dir, "segments")))._jdf.queryExecution().executedPlan().toString()
    filters = [x for x in plan.splitlines() if "Filter" in x]
    assert not any("ATAN2" in x.upper() for x in filters) and "Generate inline" in plan
