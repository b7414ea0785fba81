"""Registered queries on readers, writers, checks, map matching and streams, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import validation
from ..functions.numbers import rounded
from ..operators import graph, matching
from ..operators.polylines import rounded_columns
from ..sources import exports, networks
from ..sources.fixtures import load, oracle
from ..streaming import tracks
from .polyline_queries import hav, r

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *needs: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = oracle(sql, *needs) if needs else sql
        return f

    return add


_LINE = "printf('[%.6f,%.6f,%.2f]', lon, lat, z)"


@query(f"""SELECT route_id, '{{"type":"Feature","geometry":{{"type":"LineString","coordinates":[' || string_agg({_LINE}, ',' ORDER BY seq) || ']}},"properties":{{"n":' || count(*) || '}}}}' AS value FROM routes GROUP BY route_id""", "routes")
def export_geojson(spark, sf_dir):
    p = load(spark, sf_dir, "routes")
    return exports.geojson_lines(p, "route_id", properties=p.groupBy("route_id").agg(F.count(F.lit(1)).alias("n")))


@query("""SELECT route_id, '<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="orograph" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>' || route_id || '</name><trkseg>'
 || string_agg(printf('<trkpt lat="%.6f" lon="%.6f"><ele>%.2f</ele></trkpt>', lat, lon, z), '' ORDER BY seq) || '</trkseg></trk></gpx>' AS value FROM routes GROUP BY route_id""", "routes")
def export_gpx(spark, sf_dir):
    return exports.gpx_lines(load(spark, sf_dir, "routes"), "route_id")


@query("""SELECT route_id, 'LINESTRING Z (' || string_agg(printf('%.6f %.6f %.2f', lon, lat, z), ', ' ORDER BY seq) || ')' AS value FROM routes GROUP BY route_id""", "routes")
def export_wkt(spark, sf_dir):
    return exports.wkt_lines(load(spark, sf_dir, "routes"), "route_id")


@query("""SELECT route_id, CAST(row_number() OVER (PARTITION BY route_id ORDER BY seq)-1 AS INTEGER) AS seq, CAST(printf('%.6f', lon) AS DOUBLE) AS lon, CAST(printf('%.6f', lat) AS DOUBLE) AS lat, CAST(printf('%.2f', z) AS DOUBLE) AS z FROM routes""", "routes")
def import_gpx(spark, sf_dir):
    """Tracks written as GPX and read back."""
    return networks.gpx_points(exports.gpx_lines(load(spark, sf_dir, "routes"), "route_id"), "route_id")


@query(f"""WITH p AS (SELECT u, v, CASE WHEN is_oneway AND (u+v)%2=0 THEN '-1' WHEN is_oneway THEN 'yes' ELSE 'no' END AS o, * EXCLUDE (u, v) FROM segments)
SELECT u, v, CASE WHEN o='-1' THEN lon2 ELSE lon1 END AS lon1, CASE WHEN o='-1' THEN lat1 ELSE lat2 END AS lat2, {r("CASE WHEN o='-1' THEN z2 ELSE z1 END", "z1", 2)}, highway, surface, lanes, is_oneway FROM
 (SELECT u, v, o, CAST(printf('%.6f', lon1) AS DOUBLE) AS lon1, CAST(printf('%.6f', lon2) AS DOUBLE) AS lon2, CAST(printf('%.6f', lat1) AS DOUBLE) AS lat1, CAST(printf('%.6f', lat2) AS DOUBLE) AS lat2, z1, z2, highway, surface, lanes, is_oneway FROM p) q""", "segments")
def import_geojson(spark, sf_dir):
    """Segments written as GeoJSON lines and read back as a network; some one-way ones run against their direction."""
    s = load(spark, sf_dir, "segments").withColumn("k", F.struct("u", "v"))
    ends = s.select("k", F.lit(0).alias("seq"), F.col("lon1").alias("lon"), F.col("lat1").alias("lat"), F.col("z1").alias("z")).unionByName(s.select("k", F.lit(1).alias("seq"), F.col("lon2").alias("lon"), F.col("lat2").alias("lat"), F.col("z2").alias("z")))
    o = F.when(F.col("is_oneway") & ((F.col("u") + F.col("v")) % 2 == 0), "-1").when(F.col("is_oneway"), "yes").otherwise("no")
    texts = exports.geojson_lines(ends, "k", properties=s.select("k", "highway", "surface", "lanes", o.alias("oneway")))
    got = networks.geojson_segments(texts, "k")
    return got.select("seq.doc.u", "seq.doc.v", "lon1", "lat2", rounded(F.col("z1"), 2).alias("z1"), "highway", "surface", "lanes", "is_oneway")


@query("SELECT u, v, lon1, lat1, lon2, lat2, highway, surface, lanes, is_oneway FROM segments", "segments")
def import_osm(spark, sf_dir):
    """The grid as OpenStreetMap-style documents, one for each way with its nodes, read back as segments."""
    s = load(spark, sf_dir, "segments")
    node = lambda i, lon, lat: F.to_json(F.struct(F.lit("node").alias("type"), F.col(i).alias("id"), F.col(lon).alias("lon"), F.col(lat).alias("lat")))
    tags = F.struct("highway", "surface", F.col("lanes").cast("string").alias("lanes"), F.when(F.col("is_oneway"), "yes").otherwise("no").alias("oneway"))
    way = F.to_json(F.struct(F.lit("way").alias("type"), (F.col("u") * 1000000 + F.col("v")).alias("id"), F.array("u", "v").alias("nodes"), tags.alias("tags")))
    texts = s.select(F.struct("u", "v").alias("k"), F.concat(F.lit('{"elements":['), node("u", "lon1", "lat1"), F.lit(","), node("v", "lon2", "lat2"), F.lit(","), way, F.lit("]}")).alias("value"))
    got = networks.osm_segments(texts, "k")
    return got.select("seq.doc.u", "seq.doc.v", "lon1", "lat1", "lon2", "lat2", "highway", "surface", "lanes", "is_oneway")


@query("""SELECT trip_id, stop_id, stop_sequence, arrival_s, departure_s FROM stop_times""", "stop_times")
def import_timetable(spark, sf_dir):
    """Stop times written as HH:MM:SS and read back."""
    t = load(spark, sf_dir, "stop_times")
    clock = lambda c: F.format_string("%02d:%02d:%02d", F.floor(F.col(c) / 3600).cast("int"), F.floor(F.col(c) % 3600 / 60).cast("int"), (F.col(c) % 60).cast("int"))
    return networks.timetable(t.select("trip_id", "stop_id", "stop_sequence", clock("arrival_s").alias("arrival_time"), clock("departure_s").alias("departure_time")))


@query("""SELECT id, (CASE WHEN y>=0 THEN 'N' ELSE 'S' END) || printf('%02d', abs(y)) || '_00_' || (CASE WHEN x>=0 THEN 'E' ELSE 'W' END) || printf('%03d', abs(x)) || '_00' AS tile
FROM (SELECT id, unnest(range(CAST(floor(x1) AS BIGINT), CAST(floor(x1+1.5e0) AS BIGINT)+1)) AS x, y FROM (SELECT id, x1, unnest(range(CAST(floor(y1) AS BIGINT), CAST(floor(y1+0.7e0) AS BIGINT)+1)) AS y
 FROM (SELECT p_partkey AS id, -3.3e0+(p_partkey%50)*0.21e0 AS x1, -2.2e0+(p_partkey%40)*0.17e0 AS y1 FROM part) a) b) c""")
def elevation_tiles(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    x, y = -3.3 + (F.col("p_partkey") % 50) * 0.21, -2.2 + (F.col("p_partkey") % 40) * 0.17
    return networks.tiles(p.select(F.col("p_partkey").alias("id"), (x + 1.5).alias("lon1"), y.alias("lat1"), x.alias("lon2"), (y + 0.7).alias("lat2"))).select("id", "tile")


@query("""WITH b AS (SELECT p_partkey AS id, p_partkey%7*40e0-100 AS a, p_partkey%5*30e0-60 AS b, p_partkey%11*40e0-200 AS c, p_partkey%5*30e0-60+0.001e0 AS d FROM part)
SELECT id, CASE WHEN p IS NULL THEN least(a,c) END AS lon1, CASE WHEN p IS NULL THEN (b+d)/2-0.0025e0 END AS lat1, p AS problem FROM
(SELECT *, CASE WHEN abs(a)>180 OR abs(c)>180 THEN 'longitude out of range' WHEN abs(b)>90 OR abs(d)>90 THEN 'latitude out of range' END AS p FROM b WHERE abs(a-c)>=0.005e0) q""")
def normal_boxes(spark, sf_dir):
    k = F.col("p_partkey")
    a, b, c = k % 7 * 40.0 - 100, k % 5 * 30.0 - 60, k % 11 * 40.0 - 200
    box = validation.normal_box(a, b, c, b + 0.001)
    return load(spark, sf_dir, "part").where(F.abs(a - c) >= 0.005).select(k.alias("id"), box.alias("b")).select("id", "b.lon1", "b.lat1", "b.problem")


@query("""SELECT route_id, n, CASE WHEN n>500 THEN 'over 500 waypoints' WHEN w IS NOT NULL THEN 'waypoint ' || w || ': out of range' END AS problem FROM
(SELECT route_id, count(*) AS n, min(CASE WHEN x/10>180 OR y/10>90 THEN seq END) AS w FROM polylines GROUP BY route_id) q""", "polylines")
def waypoint_checks(spark, sf_dir):
    p = load(spark, sf_dir, "polylines").select("route_id", "seq", (F.col("x") / 10).alias("lon"), (F.col("y") / 10).alias("lat"))
    return validation.waypoint_problems(p, "route_id")


@query()
def matched_tracks(spark, sf_dir):
    """Every point of every track on its most likely edge. SQL has no most likely sequence; the tests try all of them on small tracks."""
    edges = graph.edges_of(load(spark, sf_dir, "segments")).select("u", "v")
    n = load(spark, sf_dir, "nodes")
    a = n.select(F.col("id").alias("u"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    b = n.select(F.col("id").alias("v"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return rounded_columns(matching.match_tracks(load(spark, sf_dir, "gps"), edges.join(a, "u").join(b, "v"), n, gap_s=None), 6)


_WINDOWS = "SELECT time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) AS begin, count(*) AS n, floor(sum(value)*1e2+0.5e0)/1e2 AS total, max(value) AS most FROM events GROUP BY ALL"


@query(_WINDOWS)
def stream_windows(spark, sf_dir):
    """Hourly windows of the event stream."""
    got = tracks.drained(tracks.windowed(_events(spark, sf_dir)), "complete")
    return got.select(F.col("begin").cast("timestamp_ntz").alias("begin"), "n", rounded(F.col("total"), 2).alias("total"), "most")


@query("SELECT user_id, count(*) AS n, floor(sum(value)*1e2+0.5e0)/1e2 AS total FROM events GROUP BY user_id")
def stream_running(spark, sf_dir):
    """The last state of each user's running figures."""
    got = tracks.drained(tracks.running(_events(spark, sf_dir)), "update")
    return got.groupBy("user_id").agg(F.max(F.struct("n", "total")).alias("s")).select("user_id", "s.n", rounded(F.col("s.total"), 2).alias("total"))


def _events(spark, sf_dir):
    schema = load(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
