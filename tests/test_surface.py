"""Layers, slopes, smooth profiles and the store of heights on odd inputs."""

import math

import pytest
from pyspark.sql import functions as F

from orograph.operators import polylines, surface
from orograph.sources import elevation_store as store

CELLS = "col long, row_ long, value double"


def layers(spark):
    fine = spark.createDataFrame([(0, 0, 1.0), (1, 0, None), (0, 1, float("nan")), (1, 1, 4.0), (1, 1, 3.0)], CELLS)
    coarse = spark.createDataFrame([(0, 0, 50.0)], CELLS)
    return [surface.Layer(fine, 10.0, 20.0, 0.1, 0.1), surface.Layer(coarse, 10.0, 20.0, 0.2, 0.15)]


def test_layers_are_fallen_through(spark):
    p = [(1, 10.05, 19.95), (2, 10.15, 19.95), (3, 10.05, 19.88), (4, 10.15, 19.85), (5, 10.05, 19.84), (6, 9.99, 19.95), (7, None, 19.95), (8, float("nan"), 19.95), (9, float("inf"), 19.95), (10, 10.0, 20.0)]
    df = spark.createDataFrame(p, "id int, lon double, lat double")
    got = {r["id"]: (r["value"], r["layer"]) for r in surface.first_of(df, layers(spark), "id").collect()}
    assert got == {1: (1.0, 0), 2: (50.0, 1), 3: (50.0, 1), 4: (4.0, 0), 5: (None, None), 6: (None, None), 7: (None, None), 8: (None, None), 9: (None, None), 10: (1.0, 0)}
    assert {r["value"] for r in surface.first_of(df, [], "id").collect()} == {None} and surface.first_of(df, [], "id").count() == 10
    assert surface.first_of(df.limit(0), layers(spark), "id").collect() == []


def test_warmth_and_green(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (0.3,), (35.0,), (80.0,)], "v double").select(surface.warmth(F.col("v")).alias("w"), surface.greenery(F.col("v")).alias("g"))
    assert [tuple(r) for r in df.collect()] == [(None, None), (0.0, 0.0), (0.0, 0.3), (0.5, 1.0), (1.0, 1.0)]


def test_slopes_of_odd_segments(spark):
    s = [(1, 10.05, 19.95, None, 10.15, 19.95, 10.0), (2, 10.05, 19.95, 1.0, 10.05, 19.95, 2.0), (3, 9.0, 19.95, None, 10.05, 19.95, 1.0), (4, float("nan"), 19.95, 1.0, 10.05, 19.95, 1.0), (5, 10.0, 19.0, 0.0, 10.0, 19.001, float("nan")), (6, 10.0, 19.0, 0.0, 10.0, 19.001, 10.0)]
    got = {r["id"]: tuple(r)[1:] for r in surface.slopes(spark.createDataFrame(s, "id int, lon1 double, lat1 double, z1 double, lon2 double, lat2 double, z2 double"), layers(spark), "id").collect()}
    m = 2 * 6371008.8 * math.asin(math.cos(math.radians(19.95)) * math.sin(math.radians(0.05)))
    assert abs(got[1][0] - 9.0 / m * 100) < 1e-9 and abs(got[1][1] - 90) < 1e-9 and 0 < got[1][2] < 1
    assert got[2] == (0.0, 0.0, 0.5) and got[3] == (0.0, 0.0, 1.0) and got[4] == (0.0, 0.0, 0.5) and got[5] == (0.0, 0.0, 1.0)
    assert abs(got[6][0] - 1000 / (6371008.8 * math.radians(0.001))) < 1e-6 and got[6][1] == 0.0


def test_a_plane_has_one_slope_and_outside_is_flat(spark):
    cells = spark.range(400).select((F.col("id") % 20).alias("col"), F.floor(F.col("id") / 20).alias("row_"), (F.col("id") % 20 * 3.0).alias("value"))
    layer = surface.Layer(cells, 10.0, 1.0, 0.001, 0.001)
    p = spark.createDataFrame([(1, 10.0105, 0.99), (2, 11.0, 0.99), (3, None, 0.99)], "id int, lon double, lat double")
    got = {r["id"]: r for r in surface.gradients(p, layer, 20, 20).collect()}
    assert abs(got[1]["elevation_m"] - 30) < 1e-9 and abs(got[1]["dz_dx"] - 3 / (111.32 * math.cos(math.radians(0.99)))) < 1e-9 and abs(got[1]["dz_dy"]) < 1e-12
    assert got[2]["elevation_m"] == got[3]["slope_pct"] == 0.0
    route = spark.createDataFrame([(1, 0, 10.005, 0.99, None), (1, 1, 10.006, 0.99, None), (2, 0, 10.005, 0.99, 1.0)], "route_id int, seq int, lon double, lat double, z double")
    rows = surface.smooth_profile(route, layer, 20, 20).orderBy("seg", "step").collect()
    assert {r["route_id"] for r in rows} == {1} and len(rows) == math.ceil(111.19 / 5) + 1 and rows[0]["elevation_m"] < rows[-1]["elevation_m"]


def test_a_store_grows_and_asks_once(spark, tmp_path):
    at, log = f"file://{tmp_path}/store", tmp_path / "asked"
    log.mkdir()

    def fetch(places):
        import uuid

        (log / uuid.uuid4().hex).write_text(repr(places))
        if any(x > 5 for x, _ in places):
            raise OSError("no such place")
        return [x * 10 + y for x, y in places]

    asked = lambda: sum(len(eval(f.read_text())) for f in log.iterdir())
    p = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.000001, 2.0), (3, 3.0, 4.0), (4, None, 1.0), (5, float("nan"), 1.0)], "id int, lon double, lat double")
    assert store.seed(spark.createDataFrame([(3.0, 4.0, 7.0), (9.0, 9.0, float("inf"))], "lon double, lat double, value double"), at) == 1
    assert store.prefetch(p, at, fetch) == (1, 0) and asked() == 1
    assert {r["id"]: r["value"] for r in store.heights(p, at, "id").collect()} == {1: 12.0, 2: 12.0, 3: 7.0, 4: None, 5: None}
    assert store.prefetch(p, at, fetch) == (0, 0) and asked() == 1 and len(store.parts(spark, at)) == 2
    # A chunk that fails stays wanted as a whole, the others count.
    far = spark.createDataFrame([(i, float(i), 0.0) for i in range(1, 9)], "id int, lon double, lat double").coalesce(1)
    got, left = store.prefetch(far, at, fetch, chunk=1)
    assert (got, left) == (5, 3)
    assert store.prefetch(far, at, lambda places: [1.0], chunk=3) == (0, 3) and store.prefetch(far, at, lambda places: [None] * len(places)) == (0, 3)
    assert store.prefetch(far, at, lambda places: [0.0] * len(places)) == (3, 0)
    # What a killed writer leaves is not read, and of two writers that meet the later one counts.
    spark.createDataFrame([(1, 1, 99.0)], "x long, y long, value double").write.parquet(f"{at}/_part-00000000000000000001-dead")
    one = spark.createDataFrame([(100000, 200000, 55.0)], "x long, y long, value double")
    assert store.publish(one, at) == 1
    rows = store.known(spark, at).collect()
    assert {(r["x"], r["y"]): r["value"] for r in rows}[(100000, 200000)] == 55.0 and (1, 1) not in {(r["x"], r["y"]) for r in rows} and len(rows) == 10


def test_a_failing_job_publishes_nothing(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    bad = spark.range(1).select(F.raise_error(F.lit("lost")).cast("long").alias("x"), F.lit(1).cast("long").alias("y"), F.lit(1.0).alias("value"))
    with pytest.raises(Exception, match="lost"):
        store.publish(bad, at)
    assert store.parts(spark, at) == [] and store.known(spark, at).count() == 0


def test_points_are_not_multiplied_by_the_cells_around_them(spark):
    """Each point was shuffled with 16 cells, and again to put these together."""
    cells = spark.createDataFrame([(c, r, float(c * r)) for c in range(9) for r in range(9)], "col long, row_ long, value double")
    layer = surface.Layer(cells, 0.0, 9.0, 1.0, 1.0)
    points = spark.createDataFrame([(1, 0, 2.5, 4.5, 0.0), (1, 1, 2.6, 4.5, 0.0), (2, 0, 3.5, 3.5, 0.0), (3, 0, 99.0, 4.5, 0.0), (3, 1, 99.0001, 4.5, 0.0)], "route_id long, seq long, lon double, lat double, z double")
    found = surface.smooth_profile(points, layer, 9, 9, 100_000.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") <= 2
    rows = {(r["route_id"], r["seg"], r["step"]): r["elevation_m"] for r in found.collect()}
    assert sorted(rows) == [(1, 0, 0), (1, 1, 0), (3, 0, 0), (3, 1, 0)]
    assert rows[1, 0, 0] == pytest.approx(2.0 * 4.0) and rows[3, 0, 0] == 0.0


def test_routes_on_one_line_share_its_smooth_profile(spark, monkeypatch):
    """The surface was worked out for each step of each route."""
    asked, gradients = [], surface.gradients
    monkeypatch.setattr(surface, "gradients", lambda p, *a: asked.append(p.count()) or gradients(p, *a))
    cells = spark.range(100).select((F.col("id") % 10).alias("col"), F.floor(F.col("id") / 10).alias("row_"), (F.col("id") % 7).cast("double").alias("value"))
    layer = surface.Layer(cells, 27.0, 38.01, 0.001, 0.001)
    at = [(27.001, 38.001), (27.0032, 38.0014), (27.0032, 38.0014), (None, 38.002), (27.005, 38.004), (27.02, 38.004)]
    rows = [(k, i, *p, 0.0) for k in range(300) for i, p in enumerate(at)] + [(900, 0, 27.001, 38.001, 0.0), (901, 0, 27.001, 38.001, 0.0), (901, 1, 27.004, 38.001, 0.0)]
    points = spark.createDataFrame(rows, "route_id long, seq long, lon double, lat double, z double")
    got = surface.smooth_profile(points, layer, 10, 10, 25.0)
    several = points.where("route_id <> 900")
    plain = gradients(polylines.densify(several, 25.0, None), layer, 10, 10, "route_id", "seg", "step", "lon", "lat").select(got.columns)
    want = sorted(map(tuple, plain.collect()))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 300 * 50
    assert asked[0] < 200
