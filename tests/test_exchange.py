"""Readers on odd documents, map matching against all sequences, streams in several batches, checks of values."""

import itertools
import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orograph.functions import validation
from orograph.operators import graph, matching
from orograph.sources import exports, networks
from orograph.streaming import tracks


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "name int, value string")


def test_geojson_shapes(spark):
    line = '{"type":"LineString","coordinates":[[27.1,38.4,5],[27.1,38.41],[27.1,38.41],["x",1],[27.11,38.41,8]]}'
    many = '{"type":"MultiLineString","coordinates":[[[0,0],[0,1]],[[1,1],[1,2],[1,3]]]}'
    feature = lambda g, p="{}": f'{{"type":"Feature","geometry":{g},"properties":{p}}}'
    got = networks.geojson_segments(
        texts(
            spark,
            f'{{"type":"FeatureCollection","features":[{feature(line)},{feature(many, chr(123) + chr(34) + "oneway" + chr(34) + ":true,\"lanes\":3}")}]}}',
            line,
            f"[{feature(many)}]",
            feature(f'{{"type":"GeometryCollection","geometries":[{line},{many}]}}', '{"highway":"primary","junction":"roundabout"}'),
            "no json",
            None,
            "",
            '{"type":"FeatureCollection","features":[]}',
        )
    )
    rows = got.collect()
    n = {d: sum(r["seq"]["doc"] == d for r in rows) for d in range(8)}
    assert n == {0: 5, 1: 2, 2: 3, 3: 5, 4: 0, 5: 0, 6: 0, 7: 0}
    first = min((r for r in rows if r["seq"]["doc"] == 0), key=lambda r: r["seq"])
    assert (first["z1"], first["z2"], first["highway"], first["surface"], first["lanes"], first["is_oneway"]) == (5, 0, "residential", "asphalt", 1, False)
    assert all(r["is_oneway"] and r["lanes"] == 3 for r in rows if r["seq"]["doc"] == 0 and r["seq"]["feature"] == 1)
    assert all(r["is_oneway"] and r["highway"] == "primary" for r in rows if r["seq"]["doc"] == 3)
    nodes, edges = graph.build(got.where("seq.doc = 1").withColumn("seq", F.col("seq.pos")))
    assert nodes.count() == 3 and edges.count() == 4


def test_osm_reverse_and_unknown_nodes(spark):
    doc = """{"elements":[{"type":"node","id":1,"lon":1.0,"lat":2.0},{"type":"node","id":2,"lon":1.0,"lat":2.1},
      {"type":"way","id":9,"nodes":[1,7,2],"tags":{"highway":"service","oneway":"-1"}},{"type":"way","id":8,"nodes":[1,2],"tags":{"building":"yes"}}]}"""
    (r,) = networks.osm_segments(texts(spark, doc, None, "{}")).collect()
    assert (r["lat1"], r["lat2"], r["is_oneway"], r["highway"]) == (2.1, 2.0, True, "service")


def test_gpx_attributes_in_any_order(spark):
    t = """<trkpt lon='27.1' lat="38.4"/><trkpt lat="38.5" x="1" lon="27.2"><ele> 12.5 </ele></trkpt><trkpt lat="bad" lon="1"><ele>1</ele></trkpt>
      <trkpt lat="1" lon="2"><ele>high</ele></trkpt><trkpt lat="91" lon="2"/>"""
    got = networks.gpx_points(texts(spark, t, None, "")).orderBy("seq").collect()
    assert [(r["lon"], r["lat"], r["z"]) for r in got] == [(27.1, 38.4, 0.0), (27.2, 38.5, 12.5), (2.0, 1.0, 0.0)]


def test_written_documents_are_read_by_path(spark, tmp_path):
    p = spark.createDataFrame([(1, 0, 27.0, 38.0, 1.0), (1, 1, 27.0, 38.001, None), (2, 0, None, 38.0, 1.0)], "id int, seq int, lon double, lat double, z double")
    lines = exports.gpx_lines(p, "id").select("value").coalesce(1)
    lines.write.option("lineSep", "\n").text(str(tmp_path / "gpx"))
    got = networks.documents(spark, str(tmp_path / "gpx")).select(F.lit(0).alias("name"), "value")
    assert [r["z"] for r in networks.gpx_points(got).orderBy("seq").collect()] == [1.0, 0.0]


def test_timetable_past_midnight(spark):
    df = spark.createDataFrame([("t", "s", "1", "25:00:30", None), ("t", "s", "2", None, "08:20:00"), ("t", "s", "x", "", "")], "trip_id string, stop_id string, stop_sequence string, arrival_time string, departure_time string")
    got = networks.timetable(df.withColumn("stop_sequence", F.col("stop_sequence").try_cast("int"))).collect()
    assert [(r["arrival_s"], r["departure_s"]) for r in got] == [(90030, 90030), (30000, 30000), (None, None)]


@pytest.mark.parametrize("seed", range(5))
def test_most_likely_sequence_like_trying_all(seed):
    rng = np.random.default_rng(seed)
    rows = [(t, k, 27 + t * 1e-4, 38.0, 27 + t * 1e-4 + d * 1e-5, 38 + e * 1e-5, abs(d) + abs(e)) for t in range(5) for k, (d, e) in enumerate(rng.normal(0, 8, (int(rng.integers(1, 4)), 2)))]
    df = pd.DataFrame(rows, columns=["seq", "_k", "lon", "lat", "snap_lon", "snap_lat", "dist_m"])
    by = [df[df["seq"] == t].to_dict("records") for t in range(5)]

    def metres(a, b, x, y):
        p, q = math.radians(a[y]), math.radians(b[y])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[x] - a[x]) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(h))

    def score(path):
        s = sum(-0.5 * (c["dist_m"] / 4.07) ** 2 for c in path)
        return s - sum(abs(metres(a, b, "lon", "lat") - metres(a, b, "snap_lon", "snap_lat")) / 3 for a, b in itertools.pairwise(path))

    want = max(itertools.product(*by), key=score)
    got = df.iloc[matching.most_likely(df, 4.07, 3.0)]
    assert got["_k"].tolist() == [c["_k"] for c in want]


def test_matching_of_odd_tracks(spark):
    edges = spark.createDataFrame([(1, 2, 27.0, 38.0, 27.01, 38.0), (2, 1, 27.01, 38.0, 27.0, 38.0)], "u long, v long, lon1 double, lat1 double, lon2 double, lat2 double")
    nodes = spark.createDataFrame([(1, 27.0, 38.0), (2, 27.01, 38.0)], "id long, lon double, lat double")
    kind = "track_id string, seq long, lon double, lat double, ts timestamp"
    at = lambda i: datetime(2024, 1, 1) + timedelta(minutes=i)
    rows = [("a", 0, 27.001, 38.0001, at(0)), ("a", 1, 27.002, 38.0001, at(1)), ("a", 2, 27.003, 38.0, at(100)), ("a", 3, 27.004, 38.0, at(101)), ("b", 0, 27.0, 38.0, at(0)), ("c", 0, None, 38.0, None), ("d", 0, 27.005, 38.002, at(0)), ("d", 1, 27.006, 38.0, at(1))]
    got = matching.match_tracks(spark.createDataFrame(rows, kind), edges, nodes).orderBy("track_id", "seq").collect()
    assert [(r["track_id"], r["part"], r["seq"]) for r in got] == [("a", 0, 0), ("a", 0, 1), ("a", 1, 2), ("a", 1, 3), ("d", 0, 0), ("d", 0, 1)]
    assert got[4]["u"] == got[4]["v"] and {got[0]["u"], got[0]["v"]} == {1, 2}
    assert matching.match_tracks(spark.createDataFrame([], kind), edges, nodes).count() == 0


def test_streams_over_several_files(spark, tmp_path):
    for i in range(3):
        spark.range(100).select((F.col("id") % 7).alias("user_id"), (F.col("id") + i).cast("double").alias("value")).coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    schema = "user_id long, value double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = tracks.drained(tracks.running(stream), "update")
    assert got.count() == 21
    last = got.groupBy("user_id").agg(F.max("n").alias("n"), F.max("total").alias("total"))
    want = spark.read.schema(schema).parquet(str(tmp_path / "in/*")).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    assert last.exceptAll(want).count() == 0


def test_checks_of_values(spark):
    df = spark.createDataFrame([("1.5", [1, 2]), ("x", None), (None, []), ("Infinity", [3])], "a string, l array<int>")
    rows = df.select(validation.finite_number(F.col("a"), 7.0).alias("a"), validation.value_at(F.col("l"), F.lit(0)).alias("l")).collect()
    assert [(r["a"], r["l"]) for r in rows] == [(1.5, 1), (7.0, None), (7.0, None), (7.0, 3)]
    b = spark.range(1).select(validation.normal_box(F.lit(1.0), F.lit(float("nan")), F.lit(2.0), F.lit(3.0)).alias("b")).first()["b"]
    assert b["problem"] == "invalid coordinates" and b["lon1"] is None


@pytest.mark.parametrize(("block", "fan"), [(2, 2), (5, 3), (1000, 4)])
def test_matching_by_blocks_is_that_of_whole_tracks(spark, block, fan):
    """Tracks of many blocks and levels against the sequence found over all their points at once."""
    rng = np.random.default_rng(3)
    nodes = spark.createDataFrame([(i * 20 + j, 27.0 + i * 0.001, 38.0 + j * 0.001) for i in range(20) for j in range(20)], "id long, lon double, lat double")
    at = {r["id"]: (r["lon"], r["lat"]) for r in nodes.collect()}
    pairs = [(a, b) for a in at for b in (a + 1, a + 20, a - 1, a - 20) if b in at and abs(at[a][0] - at[b][0]) + abs(at[a][1] - at[b][1]) < 0.0015]
    edges = spark.createDataFrame([(a, b, *at[a], *at[b]) for a, b in pairs], "u long, v long, lon1 double, lat1 double, lon2 double, lat2 double")
    rows = []
    for track, n in (("a", 90), ("b", 7), ("c", 1), ("d", 2), (None, 30)):
        x, y = 27.005, 38.005
        for k in range(n):
            x, y = x + rng.normal(0, 2e-4), y + rng.normal(0, 2e-4)
            rows.append((track, k * (1 if track != "b" else 3), float(x), float(y)))
    points = spark.createDataFrame(rows, "track_id string, seq long, lon double, lat double").where("track_id is not null")
    whole = matching.match_tracks(points, edges, nodes, block=10**6)
    parts = matching.match_tracks(points, edges, nodes, block=block, fan=fan)
    key = lambda df: sorted(map(tuple, df.collect()))
    got = key(parts)
    assert got == key(whole) and len(got) > 95 and not any(r[0] == "c" for r in got)


def test_tracks_of_one_block_are_walked_side_by_side_without_a_tree(spark, monkeypatch):
    """Each was three groups of its own and went up and down a tree."""
    rng = np.random.default_rng(5)
    rows = [(t, q, k, 27 + q * 1e-4, 38.0, 27 + q * 1e-4 + d * 1e-5, 38 + e * 1e-5, abs(d) + abs(e)) for t in range(30) for q in range(int(rng.integers(2, 12))) for k, (d, e) in enumerate(rng.normal(0, 8, (int(rng.integers(1, 5)), 2)))]
    df = pd.DataFrame(rows, columns=["track_id", "seq", "_k", "lon", "lat", "snap_lon", "snap_lat", "dist_m"])
    want = [i for _, one in df.groupby("track_id") for i in one.index[matching.most_likely(one.reset_index(drop=True), 4.07, 3.0)]]
    assert matching.most_likely_of_many(df, df["track_id"].to_numpy(), 4.07, 3.0).tolist() == want
    monkeypatch.setattr(matching, "_scan", None)
    edges = spark.createDataFrame([(1, 2, 27.0, 38.0, 27.01, 38.0), (2, 1, 27.01, 38.0, 27.0, 38.0)], "u long, v long, lon1 double, lat1 double, lon2 double, lat2 double")
    nodes = spark.createDataFrame([(1, 27.0, 38.0), (2, 27.01, 38.0)], "id long, lon double, lat double")
    points = spark.range(600).select((F.col("id") % 100).alias("track_id"), F.floor(F.col("id") / 100).alias("seq"), (27.001 + F.col("id") * 1e-5).alias("lon"), F.lit(38.0001).alias("lat"))
    assert matching.match_tracks(points, edges, nodes).count() == 600
