"""Joins within a radius against all pairs, over the 180th meridian and at the poles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph.operators import spatial


def metres(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371008.8 * math.atan2(math.sqrt(min(1, h)), math.sqrt(max(0, 1 - h)))


def places():
    rng = np.random.default_rng(4)
    near = lambda lon, lat, d: [(float((lon + x + 180) % 360 - 180), float(max(-90, min(90, lat + y)))) for x, y in rng.uniform(-d, d, (25, 2))]
    out = [(179.999, 0.0), (-179.999, 0.0), (10.0, 88.0), (10.4, 88.0), (180.0, 5.0), (-180.0, 5.0), (0.0, 90.0), (120.0, 90.0), (77.0, -90.0)]
    out += near(180, 0, 0.05) + near(180, 60, 0.1) + near(20, 83.99, 0.2) + near(-179.99, -84.0, 0.3) + near(0, 0, 0.04)
    return out + [(float(x), float(y)) for x, y in zip(rng.uniform(-180, 180, 40), rng.choice([-1, 1], 40) * rng.uniform(89.9, 90, 40), strict=True)]


@pytest.mark.parametrize("radius", [300.0, 2500.0, 400_000.0])
def test_all_pairs_within(spark, radius):
    rows = [(i, *p) for i, p in enumerate(places())]
    a = spark.createDataFrame(rows, "id long, lon double, lat double")
    b = a.select(F.col("id").alias("t"), F.col("lon").alias("tlon"), F.col("lat").alias("tlat"))
    pairs = [tuple(r) for r in spatial.within(a, b, radius).select("id", "t").collect()]
    want = {(i, j) for i, *p in rows for j, *q in rows if metres(p, q) <= radius * (1 - 1e-9)}
    assert len(pairs) == len(set(pairs)) and want <= set(pairs)
    assert all(metres(rows[i][1:], rows[j][1:]) <= radius * (1 + 1e-9) for i, j in pairs)
    assert (0, 1) in want or radius < 222
    assert (2, 3) in want or radius < 1552


def test_nearest_and_segments_over_the_meridian(spark):
    p = spark.createDataFrame([(1, 179.999, 0.0), (2, -179.9995, 0.0002), (3, 10.0, 88.0)], "id long, lon double, lat double")
    t = spark.createDataFrame([(7, -179.999, 0.0), (8, 10.4, 88.0), (9, 179.9, 0.0)], "node long, tlon double, tlat double")
    assert {(r[0], r[1]) for r in spatial.nearest(p, t, 2500.0, "id", "node").collect()} == {(1, 7), (2, 7), (3, 8)}
    s = spark.createDataFrame([(0, 0, 179.998, 0.0, 0.0, -179.998, 0.0, 10.0)], "route_id long, seq long, lon1 double, lat1 double, z1 double, lon2 double, lat2 double, z2 double")
    got = {r["id"]: r for r in spatial.near_segments(p, s, 100.0).collect()}
    assert set(got) == {1, 2} and got[1]["dist_m"] < 1e-6 and abs(got[2]["fraction"] - 0.625) < 1e-9 and 20 < got[2]["dist_m"] < 23
    z = {r["id"]: r for r in spatial.corridor_distance(p, s, 100.0).collect()}
    assert set(z) == {1, 2} and abs(z[2]["route_z"] - 6.25) < 1e-6 and abs(z[1]["route_z"] - 2.5) < 1e-6
