"""Registered queries on road networks, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import profiles
from ..functions.numbers import INF, rounded
from ..operators import graph, pareto
from ..operators.polylines import rounded_columns
from ..sources import exports
from ..sources.fixtures import load, oracle
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


def _edges(spark, sf_dir):
    return graph.edges_of(load(spark, sf_dir, "segments"))


def _zone_nodes(spark, sf_dir, name="node"):
    """25 nodes spread over the grid, one for each zone."""
    n = load(spark, sf_dir, "nodes")
    z = load(spark, sf_dir, "zones").select("zone_id")
    total = n.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    at = z.join(total).select("zone_id", (F.col("first") + F.floor(F.col("zone_id") * F.col("n") / 25.0).cast("long")).alias("id"))
    return at.join(n.select("id"), "id").select("zone_id", F.col("id").alias(name))


_ZN = "zn AS (SELECT zone_id, id AS node FROM (SELECT zone_id, (SELECT min(id) FROM nodes)+CAST(floor(zone_id*(SELECT count(*) FROM nodes)/25e0) AS BIGINT) AS id FROM zones) q JOIN nodes USING (id))"


def _edge_sql(profile: str) -> str:
    p = profiles.resolve(profile)
    rank = "CASE WHEN highway IN ('motorway','trunk') THEN 1 WHEN highway='primary' THEN 2 WHEN highway IN ('secondary','tertiary') THEN 3 WHEN highway='residential' THEN 4 ELSE 5 END"
    w = 1 / 3.8
    if p["category"] == "pedestrian":
        steep = f"1+pow(abs(slope_pct)/{p['max_slope_pct']}e0,3)*20*{w!r}"
        speed = f"least(8e0,greatest(0.5e0,6e0*exp(-3.5e0*abs(least(0.6e0,greatest(-0.6e0,slope_pct/100))+0.05e0))*greatest(0.2e0,{p['base_kmh']}e0/5)))"
    else:
        steep = "1e300"
        speed = f"greatest(10e0,CASE {rank} WHEN 1 THEN 80e0 WHEN 2 THEN 60e0 WHEN 3 THEN 45e0 WHEN 4 THEN 30e0 ELSE 20e0 END*{p['base_kmh']}e0/50*greatest(0.5e0,1-0.85e0*least(35e0,abs(slope_pct))/100))"
    stairs = f"{max(1.0, p['stair_penalty'])}e0" if p["stairs"] else "1e300"
    smooth = f"CASE WHEN CASE WHEN surface='asphalt' THEN 0.9e0 ELSE 0.4e0 END<{p['smooth']}e0 THEN 1+({p['smooth']}e0-CASE WHEN surface='asphalt' THEN 0.9e0 ELSE 0.4e0 END)*4 ELSE 1e0 END"
    hier = f"CASE {rank} " + " ".join(f"WHEN {i} THEN {p[f'h{i}']}e0" for i in range(1, 6)) + " END"
    return f"""s0 AS (SELECT *, greatest(0.1e0,{hav("lon1", "lat1", "lon2", "lat2")}) AS length_m FROM segments), s1 AS (SELECT *, (z2-z1)/length_m*100 AS slope_pct FROM s0),
d0 AS (SELECT u, v, length_m, slope_pct, highway, surface FROM s1 UNION ALL SELECT v, u, length_m, -slope_pct, highway, surface FROM s1 WHERE NOT is_oneway),
e AS MATERIALIZED (SELECT * FROM (SELECT *, {rank} AS rnk, greatest(0.01e0,length_m*CASE WHEN abs(slope_pct)>{p['max_slope_pct']}e0 THEN {steep} ELSE 1+abs(slope_pct)/10*{w!r}*1.5e0 END*CASE WHEN highway='steps' THEN {stairs} ELSE 1e0 END*({smooth})*({hier})) AS cost,
 length_m/greatest(0.2e0,({speed})/3.6e0) AS seconds FROM d0) q WHERE cost<1e200)"""


@query(f"WITH {_edge_sql('adult')} SELECT u, v, {r('length_m', 'length_m')}, {r('slope_pct', 'slope_pct')}, {r('cost', 'cost')}, {r('seconds', 'seconds')} FROM e", "segments")
def edge_costs_adult(spark, sf_dir):
    return rounded_columns(graph.weighted(_edges(spark, sf_dir), "adult").select("u", "v", "length_m", "slope_pct", "cost", "seconds"), 4)


@query(f"WITH {_edge_sql('car')} SELECT u, v, {r('length_m', 'length_m')}, {r('slope_pct', 'slope_pct')}, {r('cost', 'cost')}, {r('seconds', 'seconds')} FROM e", "segments")
def edge_costs_car(spark, sf_dir):
    return rounded_columns(graph.weighted(_edges(spark, sf_dir), "car").select("u", "v", "length_m", "slope_pct", "cost", "seconds"), 4)


@query(f"WITH {_edge_sql('wheelchair')} SELECT u, v, {r('length_m', 'length_m')}, {r('slope_pct', 'slope_pct')}, {r('cost', 'cost')}, {r('seconds', 'seconds')} FROM e", "segments")
def edge_costs_wheelchair(spark, sf_dir):
    return rounded_columns(graph.weighted(_edges(spark, sf_dir), "wheelchair").select("u", "v", "length_m", "slope_pct", "cost", "seconds"), 4)


@query(f"""WITH {_edge_sql('adult')} SELECT u, v, {r(f"greatest(0.01e0,cost*CASE WHEN u%3>0 OR v%2>0 THEN greatest(0.6e0,1e0+CASE WHEN u%3>0 THEN (u%10)/10e0*{0.5 / 3.8 * 1.8!r}e0 ELSE 0e0 END-CASE WHEN v%2>0 THEN (v%10)/10e0*{0.5 / 3.8 * 0.4!r}e0 ELSE 0e0 END) ELSE 1e0 END)", "cost")} FROM e""", "segments")
def edge_costs_with_rasters(spark, sf_dir):
    p = profiles.resolve("adult")
    e = _edges(spark, sf_dir).withColumn("lst", F.when(F.col("u") % 3 > 0, F.col("u") % 10 / 10.0)).withColumn("green", F.when(F.col("v") % 2 > 0, F.col("v") % 10 / 10.0))
    rank = profiles.hierarchy(F.col("highway"))
    cost = profiles.impedance(p, F.col("length_m"), F.col("slope_pct"), F.col("highway") == "steps", F.col("surface"), rank, F.col("lst"), F.col("green"))
    return rounded_columns(e.select("u", "v", cost.alias("cost")).where(F.col("cost") < INF), 4)


@query("""SELECT count(DISTINCT u) AS from_nodes, count(*) AS edges, sum(CASE WHEN highway='steps' THEN 1 ELSE 0 END)::BIGINT AS steps FROM (SELECT u, v, highway FROM segments UNION ALL SELECT v, u, highway FROM segments WHERE NOT is_oneway) q""", "segments")
def graph_build(spark, sf_dir):
    s = load(spark, sf_dir, "segments").drop("u", "v").withColumn("seq", F.floor(F.col("lat1") * 1e5).cast("long") * 100_000_000 + F.floor(F.col("lon1") * 1e5).cast("long") * 10 + F.when(F.col("lat1") == F.col("lat2"), 1).otherwise(2))
    _, edges = graph.build(s)
    return edges.agg(F.count_distinct("u").alias("from_nodes"), F.count(F.lit(1)).alias("edges"), F.count_if(F.col("highway") == "steps").alias("steps"))


_ISLANDS = """WITH RECURSIVE b AS MATERIALIZED (SELECT u, v FROM segments WHERE highway IN ('residential','tertiary') UNION ALL SELECT v, u FROM segments WHERE highway IN ('residential','tertiary')),
c(node, comp) USING KEY (node) AS (SELECT DISTINCT u, u FROM b UNION SELECT b.v, min(c.comp) FROM c JOIN b ON b.u=c.node JOIN recurring.c AS o ON o.node=b.v WHERE c.comp<o.comp GROUP BY b.v)"""


@query(_ISLANDS.replace(" WHERE highway IN ('residential','tertiary')", "") + " SELECT node, comp AS component FROM c", "segments")
def network_components(spark, sf_dir):
    return graph.components(load(spark, sf_dir, "segments").select("u", "v"))


_ENDS = """SELECT id AS query_id, lon+0.00013e0 AS olon, lat+0.00021e0 AS olat, 27.10017e0+((id*7)%31)*0.001e0 AS dlon, 38.40011e0+((id*13)%29)*0.001e0 AS dlat FROM circles"""


def _near_sql(lon: str, lat: str, name: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT query_id, comp, min(d) AS d, arg_min(node,(d,node)) AS node FROM (SELECT query_id, comp, node, {hav(lon, lat, 'lon', 'lat')} AS d FROM t JOIN m ON abs(lon-{lon})<0.01e0 AND abs(lat-{lat})<0.008e0) q WHERE d<=600 GROUP BY query_id, comp)"


@query(f"""{_ISLANDS}, t AS ({_ENDS}), m AS MATERIALIZED (SELECT c.node, c.comp, n.lon, n.lat FROM c JOIN nodes n ON n.id=c.node), z AS (SELECT comp, count(*) AS size FROM c GROUP BY comp),
{_near_sql("olon", "olat", "na")}, {_near_sql("dlon", "dlat", "nb")},
k AS (SELECT query_id, na.node AS src, nb.node AS dst, na.d+nb.d AS d, row_number() OVER (PARTITION BY query_id ORDER BY na.d+nb.d, -size, na.node, nb.node) AS rn FROM na JOIN nb USING (query_id, comp) JOIN z USING (comp)),
x AS (SELECT query_id, arg_min(node,(d,node)) AS node FROM na GROUP BY query_id), y AS (SELECT query_id, arg_min(node,(d,node)) AS node FROM nb GROUP BY query_id)
SELECT t.query_id, coalesce(k.src,x.node) AS src, coalesce(k.dst,y.node) AS dst, {r("k.d", "dist_m", 3)} FROM t LEFT JOIN k ON k.query_id=t.query_id AND rn=1 LEFT JOIN x ON x.query_id=t.query_id LEFT JOIN y ON y.query_id=t.query_id""", "segments", "circles")
def shared_ends(spark, sf_dir):
    """Ends of trips on one island of the streets that are neither main roads nor paths; over all streets there is a single island and nothing to choose."""
    islands = graph.components(load(spark, sf_dir, "segments").where("highway in ('residential', 'tertiary')").select("u", "v"))
    trips = spark.sql(_ENDS.replace("FROM circles", "FROM {circles}"), circles=load(spark, sf_dir, "circles"))
    return rounded_columns(graph.shared_ends(trips, load(spark, sf_dir, "nodes"), islands, 600.0), 3)


_STOPS = """SELECT id AS route_id, k AS seq, 27.1e0+((id*7+k*11)%31)*0.001e0+0.00013e0 AS lon, 38.4e0+((id*13+k*5)%29)*0.001e0+0.00021e0 AS lat FROM (SELECT id, 0 AS k FROM circles UNION ALL SELECT id, 1 FROM circles
UNION ALL SELECT id, 2 FROM circles UNION ALL SELECT id, 3 FROM circles)"""


@query(f"""WITH RECURSIVE {_edge_sql("wheelchair")}, b AS MATERIALIZED (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
c(node, comp) USING KEY (node) AS (SELECT DISTINCT u, u FROM b UNION SELECT b.v, min(c.comp) FROM c JOIN b ON b.u=c.node JOIN recurring.c AS o ON o.node=b.v WHERE c.comp<o.comp GROUP BY b.v),
t AS MATERIALIZED ({_STOPS}), m AS MATERIALIZED (SELECT c.node, c.comp, n.lon AS nlon, n.lat AS nlat FROM c JOIN nodes n ON n.id=c.node), z AS (SELECT comp, count(*) AS size FROM c GROUP BY comp),
near AS MATERIALIZED (SELECT route_id, seq, comp, min(d) AS d, arg_min(node,(d,node)) AS node FROM (SELECT route_id, seq, comp, node, {hav("lon", "lat", "nlon", "nlat")} AS d FROM t JOIN m ON abs(nlon-lon)<0.01e0 AND abs(nlat-lat)<0.008e0) q WHERE d<=600 GROUP BY ALL),
w AS (SELECT route_id, comp, sum(d) AS way, count(*) AS met FROM near GROUP BY ALL),
k AS (SELECT route_id, arg_min(comp,(way,-size,comp)) AS chosen FROM w JOIN z USING (comp) WHERE met=4 GROUP BY route_id),
g AS (SELECT route_id, seq, arg_min(node,(d,node)) AS node, arg_min(comp,(d,node)) AS component, min(d) AS d FROM near LEFT JOIN k USING (route_id) WHERE chosen IS NULL OR chosen=comp GROUP BY ALL)
SELECT t.route_id, t.seq, g.node, g.component, {r("g.d", "dist_m", 3)} FROM t LEFT JOIN g ON g.route_id=t.route_id AND g.seq=t.seq""", "nodes", "segments", "circles")
def shared_stops(spark, sf_dir):
    """Four stops a route, on one island of what a wheelchair can pass."""
    islands = graph.components(graph.weighted(_edges(spark, sf_dir), "wheelchair").select("u", "v"))
    stops = spark.sql(_STOPS.replace("FROM circles", "FROM {circles}"), circles=load(spark, sf_dir, "circles"))
    return rounded_columns(graph.shared_stops(stops, load(spark, sf_dir, "nodes"), islands, 600.0), 3)


def _sssp(profile: str, weight: str, limit: float) -> str:
    return f"""WITH RECURSIVE {_ZN}, {_edge_sql(profile)},
d(src, node, c) USING KEY (src, node) AS (SELECT node, node, 0e0 FROM zn UNION SELECT d.src, e.v, min(d.c+e.{weight}) FROM d JOIN e ON e.u=d.node LEFT JOIN recurring.d AS o ON o.src=d.src AND o.node=e.v
 WHERE d.c+e.{weight}<={limit!r} AND (o.c IS NULL OR d.c+e.{weight}<o.c) GROUP BY d.src, e.v)"""


@query(_sssp("adult", "cost", 2000.0) + f"SELECT src, node, {r('c', 'cost', 3)} FROM d", "nodes", "segments", "zones")
def least_costs(spark, sf_dir):
    e = graph.weighted(_edges(spark, sf_dir), "adult")
    s = _zone_nodes(spark, sf_dir).select(F.col("node").alias("src"), "node").distinct()
    return graph.least_costs(e, s, "cost", 2000.0).select("src", "node", rounded(F.col("cost"), 3).alias("cost"))


@query(_sssp("adult", "seconds", 900.0) + " SELECT src, m AS cutoff_min, count(*) AS node_count FROM d, (SELECT unnest([5e0,10e0,15e0]) AS m) q WHERE c<=m*60 GROUP BY src, m", "nodes", "segments", "zones")
def isochrones(spark, sf_dir):
    o = _zone_nodes(spark, sf_dir).select(F.col("node").alias("src"), "node").distinct()
    return graph.isochrones(_edges(spark, sf_dir), o, load(spark, sf_dir, "nodes"), [15, 5, 5, -2, 0, "10", float("nan")]).select("src", "cutoff_min", "node_count")


@query(None)
def isochrone_areas(spark, sf_dir):
    o = _zone_nodes(spark, sf_dir).select(F.col("node").alias("src"), "node").distinct()
    return rounded_columns(graph.isochrones(_edges(spark, sf_dir), o, load(spark, sf_dir, "nodes"), [5.0, 10.0]), 3)


@query(None)
def export_isochrones(spark, sf_dir):
    """The areas in reach of each zone's node as GeoJSON."""
    o = _zone_nodes(spark, sf_dir).select(F.col("node").alias("src"), "node").distinct()
    return exports.band_collections(graph.isochrone_bands(_edges(spark, sf_dir), o, load(spark, sf_dir, "nodes"), [5.0, 10.0]))


_NEAR = "q AS (SELECT zone_id AS query_id, zn.node AS src, z2.node AS dst FROM zn JOIN zn z2(zone_id2, node) ON z2.zone_id2=(zn.zone_id+1)%25 WHERE zn.node<>z2.node)"


def _pairs(spark, sf_dir):
    a = _zone_nodes(spark, sf_dir, "src")
    b = _zone_nodes(spark, sf_dir, "dst").select(((F.col("zone_id") + 24) % 25).alias("zone_id"), "dst")
    return a.join(b, "zone_id").where("src <> dst").select(F.col("zone_id").alias("query_id"), "src", "dst")


@query(_sssp("car", "cost", 1e300) + f", {_NEAR} SELECT query_id, {r('c', 'cost', 3)} FROM q JOIN d ON d.src=q.src AND d.node=q.dst", "nodes", "segments", "zones")
def route_costs(spark, sf_dir):
    p = graph.routes(_edges(spark, sf_dir), _pairs(spark, sf_dir), "car")
    return p.groupBy("query_id").agg(rounded(F.max("cost"), 3).alias("cost"))


@query(None)
def route_paths(spark, sf_dir):
    return rounded_columns(graph.routes(_edges(spark, sf_dir), _pairs(spark, sf_dir), "adult"), 3)


@query(None)
def alternative_routes(spark, sf_dir):
    return rounded_columns(graph.alternatives(_edges(spark, sf_dir), _pairs(spark, sf_dir), "adult"), 3)


@query(_sssp("adult", "cost", 1e300) + f" SELECT a.zone_id AS origin_id, b.zone_id AS destination_id, {r('c', 'cost', 2)} FROM zn a JOIN d ON d.src=a.node JOIN zn b ON b.node=d.node", "nodes", "segments", "zones")
def od_matrix(spark, sf_dir):
    o = _zone_nodes(spark, sf_dir)
    m = graph.matrix(_edges(spark, sf_dir), o.withColumnRenamed("zone_id", "origin_id"), o.withColumnRenamed("zone_id", "destination_id"))
    return m.select("origin_id", "destination_id", rounded(F.col("cost"), 2).alias("cost"))


@query(None)
def multi_stop_routes(spark, sf_dir):
    s = _zone_nodes(spark, sf_dir).select((F.col("zone_id") % 5).alias("route_id"), F.col("zone_id").alias("seq"), "node")
    return rounded_columns(graph.multi_stop(_edges(spark, sf_dir), s, "adult"), 3)


@query(None)
def multimodal_trips(spark, sf_dir):
    t = _pairs(spark, sf_dir).withColumnRenamed("query_id", "trip_id")
    hubs = _zone_nodes(spark, sf_dir, "hub").where("zone_id % 4 = 0").select("hub")
    return rounded_columns(graph.multimodal(_edges(spark, sf_dir), t, hubs, load(spark, sf_dir, "nodes")), 3)


@query(None)
def network_evacuation(spark, sf_dir):
    o = _zone_nodes(spark, sf_dir).withColumnRenamed("zone_id", "origin_id")
    m = _zone_nodes(spark, sf_dir).where("zone_id in (6, 12, 18)").withColumnRenamed("zone_id", "muster_id")
    h = load(spark, sf_dir, "circles").where("radius_m >= 68").select(F.col("lon").alias("hlon"), F.col("lat").alias("hlat"), "radius_m", F.lit(100.0).alias("severity"))
    return rounded_columns(graph.network_evacuation(_edges(spark, sf_dir), load(spark, sf_dir, "nodes"), o, m, h), 3)


@query()
def tradeoff_routes(spark, sf_dir):
    """Fastest, flattest and other trade-off routes between nodes two columns and two rows apart. SQL would have to list all simple paths."""
    n = load(spark, sf_dir, "nodes")
    a, b = n, n.select(F.col("id").alias("dst"), F.col("gx").alias("x"), F.col("gy").alias("y"))
    q = a.join(b, (b["x"] == a["gx"] + 2) & (b["y"] == a["gy"] + 2)).select(F.col("id").alias("query_id"), F.col("id").alias("src"), "dst")
    found = pareto.archetypes(pareto.frontier(pareto.vectors(_edges(spark, sf_dir), n), q, epsilon=0.0))
    return rounded_columns(found.withColumn("path", F.concat_ws(" ", F.col("path").cast("array<string>"))), 4)
