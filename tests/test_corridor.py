"""Trees and buildings along routes against the sequences and sums they stand for, in plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph.operators import corridor


def metres(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371008.8 * math.atan2(math.sqrt(min(1, h)), math.sqrt(max(0, 1 - h)))


def greedy(rows):
    """(order, lon, lat, spacing) one after the other."""
    out = []
    for o, lon, lat, s in sorted(rows):
        if all(metres((lon, lat), p[1:3]) >= s for p in out):
            out.append((o, lon, lat))
    return [o for o, _, _ in out]


@pytest.mark.parametrize("where", [(27.1, 38.4), (179.9999, 0.0), (10.0, -83.9995), (0.0, 89.9995)])
def test_a_thousand_candidates_stand_as_in_sequence(spark, where):
    rng = np.random.default_rng(8)
    wide = 0.002 / max(0.02, math.cos(math.radians(where[1])))
    rows = []
    for i, o in enumerate(rng.permutation(1000)):
        lon, lat = where[0] + rng.normal(0, wide / 2), min(90.0, where[1] + rng.normal(0, 0.001))
        if i % 5 == 0 and rows:
            lon, lat = rows[int(rng.integers(len(rows)))][1:3]
        rows.append((int(o), float((lon + 180) % 360 - 180), float(lat), float(rng.choice([5, 8, 9, 20]))))
    df = spark.createDataFrame(rows, "o long, lon double, lat double, spacing_m double")
    got = sorted(r["o"] for r in corridor.spaced(df, "o").collect())
    assert got == sorted(greedy(rows)) and 20 < len(got) < 900


def test_many_candidates_at_one_place_and_odd_rows(spark):
    same = spark.range(20_000).select(F.col("id").alias("o"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"), F.lit(5.0).alias("spacing_m"), F.lit("x").alias("_cx"), F.lit(1).alias("placed"))
    assert [r["o"] for r in corridor.spaced(same.drop("_cx"), "o").collect()] == [0]
    odd = spark.createDataFrame([(1, None, 1.0, 5.0), (2, 1.0, float("nan"), 5.0), (3, 1.0, 1.0, None), (4, 1.0, 1.0, 0.0), (5, 1.0, 1.0, 5.0), (5, 1.0, 1.0, 5.0)], "o long, lon double, lat double, spacing_m double")
    assert [r["o"] for r in corridor.spaced(odd, "o").collect()] == [5]
    assert corridor.spaced(odd.limit(0), "o").collect() == []


STREETS = [(1, 0, 27.1, 38.4, 10.0, 27.101, 38.4, 20.0), (1, 1, 27.101, 38.4, 20.0, 27.1013, 38.4008, 5.0), (2, 0, 27.1002, 38.3999, 0.0, 27.1009, 38.4002, None), (3, 0, 27.1, 38.4, 1.0, 27.1, 38.4, 3.0)]
SEGMENTS = "route_id long, seq long, lon1 double, lat1 double, z1 double, lon2 double, lat2 double, z2 double"


def nearest(p):
    """(distance, height) of the nearest street in the plane of each segment's middle latitude."""
    best = None
    for route, seq, x1, y1, z1, x2, y2, z2 in STREETS:
        k = math.cos(math.radians((y1 + y2) / 2)) * 111320.0
        dx, dy = (x2 - x1) * k, (y2 - y1) * 110540.0
        n = dx * dx + dy * dy
        f = min(1.0, max(0.0, ((p[0] - x1) * k * dx + (p[1] - y1) * 110540.0 * dy) / n)) if n > 1e-9 else 0.0
        z1, z2 = z1 or 0.0, z2 or 0.0
        d = metres(p, (x1 + f * (x2 - x1), y1 + f * (y2 - y1)))
        best = min(best or (1e9,), (d, route, seq, z1 + f * (z2 - z1)))
    return best[0], best[3]


def test_trees_stand_as_in_sequence(spark):
    streets = spark.createDataFrame(STREETS, SEGMENTS)
    houses = [(27.1004, 38.40015, 14.0), (27.1012, 38.4003, 9.0)]
    buildings = spark.createDataFrame(houses, "lon double, lat double, reach_m double")
    rng = np.random.default_rng(2)
    mapped = [(i, 27.1 + float(rng.uniform(-3e-4, 1.5e-3)), 38.4 + float(rng.uniform(-5e-4, 1e-3)), 10.0, 2.0, "pine") for i in range(200)]
    parks = [(1, i, 27.1003 + 2e-4 * math.cos(i), 38.3998 + 2e-4 * math.sin(i)) for i in range(30)] + [(2, i, 27.2 + i * 1e-5, 38.4) for i in range(4)] + [(3, 0, 27.1005, 38.4002), (3, 1, 27.1005, 38.4003)]
    rows = [tuple(r) for r in corridor.planted_rows(streets).select("route_id", "seq", "step", "side", "lon", "lat").collect()]
    assert len(rows) == 6 * sum(max(1, round(metres(s[2:4], s[5:7]) / 18)) for s in STREETS if metres(s[2:4], s[5:7]) >= 2)
    bare = [(r[0], r[1], r[2], r[3], 0.1 if i % 4 == 0 else float("nan") if i % 4 == 1 else 0.9) for i, r in enumerate(rows) if i % 4 < 3]
    green = spark.createDataFrame(bare, "route_id long, seq long, step int, side int, green double")
    no_trees = {b[:4] for b in bare if b[4] == 0.1}
    asked = [((1, t, 0, 0, 0), x, y, 5.0, 1.0, 35.0) for t, x, y, *_ in mapped]
    asked += [((2, p, s, 0, 0), x, y, 8.0, 4.0, 30.0) for p, s, x, y in parks if p == 1]
    asked += [((3, *r[:4]), r[4], r[5], 9.0, 4.5, 32.0) for r in rows if r[:4] not in no_trees]
    clear = [(o, x, y, s) for o, x, y, s, low, high in asked if low <= nearest((x, y))[0] <= high and all(metres((x, y), h[:2]) >= h[2] for h in houses)]
    t = corridor.trees_beside(streets, buildings, spark.createDataFrame(mapped, "tree_id long, lon double, lat double, height_m double, canopy_m double, kind string"), spark.createDataFrame(parks, "park_id long, seq long, lon double, lat double"), green).collect()
    want = greedy(clear)
    assert sorted(tuple(r[c] for c in ("stage", "a", "b", "c", "d")) for r in t) == sorted(want)
    assert {o[0] for o in want} == {1, 2, 3}
    for r in t:
        d, z = nearest((r["lon"], r["lat"]))
        assert abs(r["dist_m"] - d) < 1e-6 and abs(r["base_m"] - z) < 1e-6
        assert r["height_m"] > 0 and r["trunk_m"] < r["height_m"] and r["trunk_radius_m"] >= 0.18


def test_buildings_with_odd_corners(spark):
    ring = [(9, i, 27.1005 + 1e-4 * math.cos(i), 38.4001 + 1e-4 * math.sin(i), -1.0, 0) for i in range(1000)]
    far = [(8, i, 27.5 + i * 1e-5, 38.4, 5.0, 2) for i in range(4)]
    few = [(7, 0, 27.1, 38.4, 5.0, 2), (7, 1, 27.1, 38.4, 5.0, 2), (7, 2, None, 38.4, 5.0, 2), (7, 3, float("nan"), 38.4, 5.0, 2)]
    df = spark.createDataFrame(ring + far + few, "building_id long, seq long, lon double, lat double, height_m double, levels int")
    got = corridor.buildings_beside(df, spark.createDataFrame(STREETS, SEGMENTS)).collect()
    assert [(r["building_id"], r["height_m"], r["levels"]) for r in got] == [(9, 12.0, 4)]
    c = (sum(p[2] for p in ring) / 1000, sum(p[3] for p in ring) / 1000)
    assert abs(got[0]["reach_m"] - 3 - max(metres(c, p[2:4]) for p in ring)) < 1e-6 and abs(got[0]["dist_m"] - nearest(c)[0]) < 1e-6
    assert corridor.buildings_beside(df.limit(0), spark.createDataFrame(STREETS, SEGMENTS)).collect() == []


@pytest.mark.parametrize("buffer_m", [0.0, 20.0, 90.0])
def test_grid_cells_are_those_near_a_route(spark, buffer_m):
    """Against all cells and all segments, over grids that cut routes off on each side."""
    rng = np.random.default_rng(6)
    at = lambda: (float(27.1 + rng.uniform(-0.002, 0.012)), float(38.4 + rng.uniform(-0.002, 0.008)))
    rows = [(i, 0, *at(), 0.0, *at(), 0.0) for i in range(12)]
    rows += [(20, 0, 27.1, 38.403, 0.0, 27.109, 38.403, 0.0), (21, 0, 27.103, 38.4, 0.0, 27.103, 38.406, 0.0), (22, 0, 27.105, 38.4041, 0.0, 27.105, 38.4041, 0.0), (23, 0, None, 38.4, 0.0, 27.1, 38.4, 0.0)]
    x0, top, res, width, height = 27.1, 38.406, 0.00013, 70, 47

    def near(lon, lat, s):
        k = math.cos(math.radians(lat))
        ax, ay, bx, by = (s[2] - lon) * k, s[3] - lat, (s[5] - lon) * k, s[6] - lat
        dx, dy = bx - ax, by - ay
        n = dx * dx + dy * dy
        t = max(0.0, min(1.0, -(ax * dx + ay * dy) / n)) if n else 0.0
        return metres((lon, lat), (s[2] + t * (s[5] - s[2]), s[3] + t * (s[6] - s[3])))

    want = set()
    for r in range(height):
        for c in range(width):
            lon, lat = x0 + (c + 0.5) * res, top - (r + 0.5) * res
            if any(s[2] is not None and near(lon, lat, s) <= buffer_m + 10 for s in rows):
                want.add((c, r))
    segments = spark.createDataFrame(rows + rows[:3], SEGMENTS)
    got = [(r["col"], r["row_"]) for r in corridor.grid_cells(segments, x0, top, res, width, height, buffer_m).collect()]
    assert len(got) == len(set(got)) and set(got) == want and 50 < len(want) < width * height
    cells = spark.createDataFrame([(3, 4, 1.0), (69, 46, None), (200, 3, 2.0)], "col long, row_ long, value double")
    masked = {(r["col"], r["row_"]): r["value"] for r in corridor.masked_grid(cells, segments, x0, top, res, width, height, buffer_m).collect()}
    assert masked == {(3, 4): 1.0 if (3, 4) in want else None, (69, 46): None, (200, 3): None}
