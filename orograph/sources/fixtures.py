"""Mobility inputs derived from the driver's tables: grids, polylines, tracks, zones, timetables, hazards and a raster.

Each is one SQL text that Spark and other engines read alike, so that an oracle can build the same input on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NODES = """
SELECT id, gx, gy, 27.10e0 + gx*0.001e0 AS lon, 38.40e0 + gy*0.001e0 AS lat, 10e0 + ((gx*7 + gy*11) % 23)*0.5e0 AS z
FROM (SELECT id, id % w AS gx, CAST(floor(id / CAST(w AS DOUBLE)) AS BIGINT) AS gy
      FROM (SELECT CAST(c_custkey AS BIGINT) AS id,
                   (SELECT CAST(ceil(sqrt(CAST(count(*) AS DOUBLE))) AS BIGINT) FROM customer) AS w FROM customer) q0) q1
"""
SEGMENTS = """
SELECT a.id AS u, b.id AS v, a.lon AS lon1, a.lat AS lat1, a.z AS z1, b.lon AS lon2, b.lat AS lat2, b.z AS z2,
       CASE (a.id*7 + b.id) % 10 WHEN 0 THEN 'motorway' WHEN 1 THEN 'primary' WHEN 2 THEN 'secondary'
            WHEN 3 THEN 'tertiary' WHEN 4 THEN 'steps' WHEN 5 THEN 'footway' ELSE 'residential' END AS highway,
       CASE WHEN (a.id + b.id) % 4 = 0 THEN 'gravel' ELSE 'asphalt' END AS surface,
       (a.id*3 + b.id) % 17 = 0 AS is_oneway, CAST(1 + (a.id + b.id) % 4 AS BIGINT) AS lanes
FROM nodes a JOIN nodes b ON b.gx = a.gx + {dx} AND b.gy = a.gy + {dy}
"""
SEGMENTS = SEGMENTS.format(dx=1, dy=0) + "UNION ALL" + SEGMENTS.format(dx=0, dy=1)
_NUMBERED = """(SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS seq
      FROM lineitem) q"""
POLYLINES = f"""
SELECT l_orderkey AS route_id, seq, seq*120e0 + l_quantity AS x, l_discount*1000e0 AS y,
       100e0 + l_tax*200e0 + l_quantity*0.3e0 AS z, 20e0 + l_quantity AS speed_kmh
FROM {_NUMBERED}
"""
GPS = """
SELECT user_id AS track_id, seq, ts, 27.10e0 + seq*0.0003e0 + ((event_id*31) % 21 - 10)*0.00001e0 AS lon,
       38.40e0 + (user_id % 10)*0.001e0 + ((event_id*17) % 21 - 10)*0.00001e0 AS lat, abs(value)/20e0 AS speed_ms
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq FROM events) q
"""
ZONES = """
SELECT CAST(c_nationkey AS BIGINT) AS zone_id, 27.10e0 + (c_nationkey % 5)*0.006e0 AS lon,
       38.40e0 + floor(c_nationkey/5e0)*0.006e0 AS lat, CAST(count(*) AS DOUBLE)*10e0 AS population
FROM customer GROUP BY c_nationkey
"""
FACILITIES = """
SELECT CAST(s_suppkey AS BIGINT) AS facility_id, 27.10e0 + ((s_suppkey*7) % 31)*0.001e0 AS lon, 38.40e0 + ((s_suppkey*13) % 29)*0.001e0 AS lat,
       CAST(1 + (s_suppkey*37) % 100 AS DOUBLE) AS capacity
FROM supplier
"""
STOP_TIMES = f"""
SELECT l_orderkey AS trip_id, l_suppkey AS stop_id, seq AS stop_sequence,
       21600 + (l_orderkey % 720)*60 + seq*300 AS arrival_s, 21600 + (l_orderkey % 720)*60 + seq*300 + 30 AS departure_s
FROM {_NUMBERED}
"""
CIRCLES = """
SELECT CAST(p_partkey AS BIGINT) AS id, 27.10e0 + ((p_partkey*11) % 37)*0.001e0 AS lon, 38.40e0 + ((p_partkey*5) % 41)*0.001e0 AS lat,
       20e0 + p_size AS radius_m, 3e0 + (p_partkey % 40) AS height_m, 3.5e0 + (p_partkey % 20)*0.1e0 AS clearance_m
FROM part
"""
RASTER = """
SELECT col, row_, CASE WHEN col = 0 AND row_ = 0 THEN NULL ELSE 100e0 + 10e0*col + 0.5e0*row_ END AS value
FROM (SELECT CAST(n_nationkey AS BIGINT) AS col FROM nation) c CROSS JOIN (SELECT CAST(n_nationkey AS BIGINT) AS row_ FROM nation) r
"""
#: A polyline in degrees: the planar one on a local plane at 27.1 E 38.4 N.
ROUTES = """
SELECT route_id, seq, 27.10e0 + x/87000e0 AS lon, 38.40e0 + y/110540e0 AS lat, z FROM polylines
"""

_SOURCES = {
    "nodes": (NODES, ["customer"]),
    "segments": (SEGMENTS, ["nodes"]),
    "polylines": (POLYLINES, ["lineitem"]),
    "routes": (ROUTES, ["polylines"]),
    "gps": (GPS, ["events"]),
    "zones": (ZONES, ["customer"]),
    "facilities": (FACILITIES, ["supplier"]),
    "stop_times": (STOP_TIMES, ["lineitem"]),
    "circles": (CIRCLES, ["part"]),
    "raster_cells": (RASTER, ["nation"]),
}
#: Inputs with many rows out of few bytes of files: a planner that goes by files would send them through the driver to be broadcast.
_NARROW = {"nodes", "circles"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input, or one of the driver's tables."""
    if name not in _SOURCES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql, needs = _SOURCES[name]
    tables = {n: load(spark, sf_dir, n) for n in needs}
    for n in needs:
        sql = _named(sql, n)
    made = spark.sql(sql, **tables)
    return made.hint("merge") if name in _NARROW else made


def _named(sql: str, name: str) -> str:
    """References to the table as parameters that spark.sql() fills with a DataFrame."""
    return sql.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")


def oracle(body: str, *names: str) -> str:
    """``body`` with the derived inputs it reads as common table expressions before it."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in _SOURCES[name][1]:
            if n in _SOURCES:
                need(n)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    ctes = [f"{n} AS MATERIALIZED ({_SOURCES[n][0]})" for n in order]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join([*ctes, body[len("WITH RECURSIVE") :].strip()])
    if body.upper().startswith("WITH"):
        return "WITH " + ", ".join([*ctes, body[4:].strip()])
    return f"WITH {', '.join(ctes)} {body}"
