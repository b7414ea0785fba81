"""Work and memory that grow no faster than the tables: what is broadcast, sorted, shuffled, and how many rounds a search takes."""

import duckdb
from pyspark.sql import Window
from pyspark.sql import functions as F

from orograph.functions import geo
from orograph.functions.durable import durable
from orograph.operators import corridor, pareto
from orograph.operators import polylines as P
from orograph.plans.polyline_queries import _DIR, _TURN
from orograph.sources.fixtures import load


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_rows_of_a_small_file_are_not_broadcast(spark, sf_dir):
    many = durable(spark.range(1_000_000).select((F.col("id") % 5).alias("k"), F.lit(1.0).alias("a"), F.lit(2.0).alias("b")))
    few = durable(spark.range(5).withColumnRenamed("id", "k"))
    other = spark.range(3_000_000).withColumnRenamed("id", "k")
    assert "Broadcast" not in plan(many.join(other, "k"))
    assert "Broadcast" in plan(few.join(other, "k"))
    # Rows of nodes and parts come out of few bytes of files.
    assert "Broadcast" not in plan(load(spark, sf_dir, "segments"))
    for name in ("nodes", "circles"):
        assert "Broadcast" not in plan(load(spark, sf_dir, name).groupBy("id").count().join(other, F.col("k") == F.col("id")))


def test_statistics_sort_points_of_routes_and_no_pieces_of_them(spark):
    """The pieces between points are many times as many; they were sorted for a window, and spilled."""
    points = [(1, 0, 27.1, 38.4, 0.0), (1, 1, 27.101, 38.4, 9.0), (1, 2, 27.101, 38.4, 9.0), (1, 3, None, 38.4, 1.0), (1, 4, 27.102, 38.401, None), (2, 0, 27.1, 38.4, 3.0)]
    df = spark.createDataFrame(points, "route_id long, seq long, lon double, lat double, z double")
    dense = P.densify(df, 12.0)
    w = Window.partitionBy("route_id").orderBy("seg", "step")
    want = dense.select("*", *[F.lead(c).over(w).alias(f"{c}2") for c in ("lon", "lat", "z")]).orderBy("route_id", "seg", "step").collect()
    got = P.dense_steps(df, 12.0).orderBy("route_id", "seg", "step").collect()
    assert got == want and len(got) == 12
    assert "step" not in "".join(x for x in plan(P.statistics(df)).splitlines() if "Sort [" in x)


def test_half_right_angles_are_slight_turns_on_either_side(spark):
    """What an arc tangent adds in the last digit made some of them full turns."""
    a = spark.createDataFrame([(-45.00000000000003,), (-45.0,), (45.00000000000003,), (-45.001,), (15.00000000000003,)], "a double")
    assert [r[0] for r in a.select(geo.turn_direction(F.col("a"))).collect()] == ["slight_left", "slight_left", "slight_right", "left", "slight_left"]


def test_spaced_candidates_are_sent_to_few_cells(spark, monkeypatch):
    """Each was sent to every small cell in its reach, here some 40."""
    asked = []

    def counted(df, *args):
        out = corridor_cells(df, *args)
        asked.append((df.count(), out.count()))
        return out

    corridor_cells = corridor.cells_of_box
    monkeypatch.setattr(corridor, "cells_of_box", counted)
    n = spark.range(900).select("id", (27.1 + (F.col("id") % 30) * 0.001).alias("lon"), (38.4 + F.floor(F.col("id") / 30) * 0.001).alias("lat"), (100.0 + (F.col("id") % 3) * 40).alias("spacing_m"))
    assert corridor.spaced(n, "id").count() > 100
    rows, sent = map(sum, zip(*asked, strict=True))
    assert rows > 900 and sent < 3 * rows


def test_grid_cells_are_looked_at_by_compiled_columns(spark):
    """The ends of intervals were found by functions of arrays, which Spark interprets for each segment and grid row."""
    s = spark.createDataFrame([(27.1, 38.4, 27.101, 38.4)], "lon1 double, lat1 double, lon2 double, lat2 double")
    cells = corridor.grid_cells(s, 27.0991, 38.41, 0.0003, 20, 40, 15.0)
    assert "lambda" not in plan(cells) and cells.count() > 0


def test_turns_of_half_right_angles_are_named_as_in_sql(spark):
    """Rounding their angles, and the last digit of Java's arc tangents, made left turns of SQL slight ones and the other way round."""
    steps = [(130.0, 144.0, -30.0, 90.0), (110.0, 72.0, -10.0, 60.0), (95.0, 92.0, -20.0, 60.0), (130.0, 168.0, -80.0, 40.0), (138.0, 95.0, -90.0, 20.0), (75.0, 110.0, -90.0, -10.0), (80.0, 119.0, 80.0, 0.0)]
    rows = [(k, *p) for k, (ax, bx, ay, by) in enumerate(steps) for p in ((1, 0.0, 0.0, 0.0), (2, ax, ay, 0.0), (3, ax + bx, ay + by, 0.0))]
    points = spark.createDataFrame(rows, "route_id long, seq long, x double, y double, z double")
    con = duckdb.connect()
    con.execute("CREATE TABLE polylines (route_id BIGINT, seq BIGINT, x DOUBLE, y DOUBLE)")
    con.executemany("INSERT INTO polylines VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    want = con.execute(f"{_TURN} SELECT route_id, angle, {_DIR} FROM a ORDER BY route_id").fetchall()
    got = P.turns(points, "x", "y").orderBy("route_id").select("route_id", "angle", "direction").collect()
    assert [tuple(r) for r in got] == want and {r[2] for r in want} == {"left", "slight_left", "slight_right"}


def test_points_beside_routes_stay_in_their_cells(spark):
    """All that points and segments met was sorted, and points were dealt out by their key to be joined with what was found, and again for buildings."""
    points = spark.range(400).select("id", (27.1 + (F.col("id") % 20) * 1e-4).alias("lon"), (38.4 + F.floor(F.col("id") / 20) * 1e-4).alias("lat"))
    line = lambda k, lat, z: (k, 1, 27.1, lat, z, 27.102, lat, z)
    s = spark.createDataFrame([line(1, 38.4002, 5.0), line(2, 38.4006, 6.0), line(0, 38.4006, 7.0)], "route_id long, seq long, lon1 double, lat1 double, z1 double, lon2 double, lat2 double, z2 double")
    b = spark.createDataFrame([(27.1, 38.4, 30.0), (27.1, 38.4, 5.0)], "lon double, lat double, reach_m double")
    near = corridor.route_distances(points, s, 40.0, "id", "lon", "lat")
    clear = corridor.clear_of(near, b)
    assert "hashpartitioning(id" not in plan(clear) and "SortAggregate(key=[id" not in plan(clear)
    by_key = points.select("id").join(corridor.route_distances(points, s, 40.0, "id"), "id")
    assert sorted(map(tuple, near.drop("lon", "lat").collect())) == sorted(map(tuple, by_key.collect()))
    assert {r["route_z"] for r in near.collect()} == {5.0, 7.0} and near.where("dist_m > 40").count() == 0
    inside = geo.haversine(F.col("lon"), F.col("lat"), F.lit(27.1), F.lit(38.4)) < 30.0
    assert clear.count() == near.where(~inside).count() < near.count()


def test_labels_are_dealt_out_once_a_round(spark):
    """They were dealt out by group and sums, then by group."""
    labels = spark.range(40).select((F.col("id") % 3).alias("query_id"), (F.col("id") % 5).alias("node"), *[(F.col("id") % k).cast("double").alias(s) for k, s in zip((2, 3, 4, 7), pareto.SUMS, strict=True)], F.lit(True).alias("fresh"), F.array("id").alias("path"))
    kept = pareto._undominated(labels, 0.0, "query_id", "node")
    assert plan(kept).count("Exchange hashpartitioning") == 1 and 0 < kept.count() < 40
