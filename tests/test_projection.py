"""Projections against published places, round trips over the earth, and tables of lines in planes."""

import math

import numpy as np
from pyspark.sql import functions as F

from orograph.functions import projection
from orograph.sources import networks


def test_published_places(spark):
    rows = [(32631, 0.0, 0.0, 166021.4431, 0.0), (32631, 3.0, 45.0, 500000.0, 4982950.4002), (32731, 3.0, -45.0, 500000.0, 5017049.5998), (3857, 180.0, 0.0, 20037508.3428, 0.0), (3857, -90.0, 85.0511287798066, -10018754.1714, 20037508.3428), (4326, 7.0, 8.0, 7.0, 8.0)]
    df = spark.createDataFrame(rows, "code int, lon double, lat double, wx double, wy double")
    for r in projection.to_plane(df, F.col("code")).collect():
        assert abs(r["x"] - r["wx"]) < 1e-3 and abs(r["y"] - r["wy"]) < 1e-3


def test_there_and_back(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-180, 180, 2000), rng.uniform(-84, 84, 2000), strict=True))] + [(-1, 179.999, 10.0), (-2, -180.0, 10.0), (-3, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, lon double, lat double").withColumn("code", projection.zone_of(F.col("lon"), F.col("lat")))
    for code in (F.col("code"), F.lit(3857), F.lit(4326)):
        there = projection.to_plane(df.withColumn("c", code), F.col("c")).withColumnsRenamed({"lon": "lon0", "lat": "lat0"})
        for r in projection.to_degrees(there, F.col("c")).collect():
            assert abs(r["lat"] - r["lat0"]) < 1e-8 and abs((r["lon"] - r["lon0"] + 180) % 360 - 180) < 1e-8


def test_what_no_plane_holds(spark):
    rows = [(1, 4000), (2, 32661), (3, None), (4, 3857), (5, 32635)]
    df = spark.createDataFrame([(i, c, x, y) for i, c in rows for x, y in ((27.0, 90.0), (float("nan"), 1.0), (None, 1.0))], "id int, code int, lon double, lat double")
    got = projection.to_plane(df, F.col("code")).collect()
    assert {(r["id"], r["x"] is None, r["y"] is None) for r in got if r["id"] < 5} == {(i, True, True) for i in (1, 2, 3, 4)}
    assert [r["x"] is None for r in got if r["id"] == 5].count(True) >= 2


def test_tables_of_lines(spark):
    rows = [
        (1, "LINESTRING (27 38, 27.001 38)", "motorway", "no"), (2, "MultiLineString Z ((27 38 5, 27.001 38 6),(27 39 x, 27.001 39))", None, " -1 "), (3, "POINT (27 38)", "path", "yes"), (4, None, "path", "yes"),
        (5, "LINESTRING EMPTY", "path", "yes"), (6, "LINESTRING (27 38, a b, 27.1 38.1)", "steps", "TRUE"), (7, "LINESTRING (27 38)", "x", "1"), (8, "LINESTRING (27 38, 27 38)", "x", "1"),
    ]
    df = spark.createDataFrame(rows, "id int, geometry string, Highway string, ONEWAY string")
    got = sorted((r["seq"]["doc"], r["seq"]["line"], r["lon1"], r["z1"], r["lon2"], r["z2"], r["highway"], r["surface"], r["is_oneway"]) for r in networks.table_segments(df, "id").collect())
    assert got == [
        (1, 0, 27.0, 0.0, 27.001, 0.0, "motorway", "asphalt", False), (2, 0, 27.001, 6.0, 27.0, 5.0, "residential", "asphalt", True), (2, 1, 27.001, 0.0, 27.0, 0.0, "residential", "asphalt", True),
        (6, 0, 27.0, 0.0, 27.1, 0.0, "steps", "asphalt", True), (8, 0, 27.0, 0.0, 27.0, 0.0, "x", "asphalt", True),
    ]
    metres = spark.createDataFrame([(1, "LINESTRING (500000 4205000, 500100 4205000)", 32635), (2, "LINESTRING (3005000 4600000, 3005100 4600000)", 3857), (3, "LINESTRING (1 1, 2 2)", 9999)], "id int, g string, code int")
    by = {r["seq"]["doc"]: r for r in networks.table_segments(metres, "id", "g", F.col("code")).collect()}
    assert set(by) == {1, 2} and abs(by[1]["lon1"] - 27) < 1e-9 and 37.98 < by[1]["lat1"] < 38.0 and abs(by[2]["lon1"] - math.degrees(3005000 / 6378137)) < 1e-9
