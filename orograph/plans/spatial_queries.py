"""Registered queries on places, rasters, equity, transit and plans, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kinematics as K
from ..functions.numbers import rounded
from ..operators import access, planning, spatial, transit
from ..operators.polylines import rounded_columns
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


def _targets(df, *columns):
    return df.select(*columns, F.col("lon").alias("tlon"), F.col("lat").alias("tlat"))


@query(f"""WITH p AS (SELECT c.id, n.id AS node_id, {hav("c.lon", "c.lat", "n.lon", "n.lat")} AS d FROM circles c JOIN nodes n ON abs(c.lon-n.lon)<0.04e0 AND abs(c.lat-n.lat)<0.03e0),
q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, node_id) AS k FROM p WHERE d<=2500)
SELECT id, node_id, {r("d", "dist_m")} FROM q WHERE k=1""", "circles", "nodes")
def snap_to_network(spark, sf_dir):
    nodes = _targets(load(spark, sf_dir, "nodes"), F.col("id").alias("node_id"))
    return rounded_columns(spatial.nearest(load(spark, sf_dir, "circles").select("id", "lon", "lat"), nodes, 2500.0, "id", "node_id"), 4)


_FRAC = "least(1e0,greatest(0e0,((g.lon-s.lon1)*(s.lon2-s.lon1)+(g.lat-s.lat1)*(s.lat2-s.lat1))/((s.lon2-s.lon1)*(s.lon2-s.lon1)+(s.lat2-s.lat1)*(s.lat2-s.lat1))))"


@query(f"""WITH p AS (SELECT track_id, seq, u, v, lon, lat, lon1+f*(lon2-lon1) AS sx, lat1+f*(lat2-lat1) AS sy FROM (SELECT g.track_id, g.seq, g.lon, g.lat, s.*, {_FRAC} AS f FROM gps g JOIN segments s
 ON g.lon BETWEEN least(s.lon1,s.lon2)-0.0006e0 AND greatest(s.lon1,s.lon2)+0.0006e0 AND g.lat BETWEEN least(s.lat1,s.lat2)-0.0004e0 AND greatest(s.lat1,s.lat2)+0.0004e0) q)
SELECT track_id, seq, count(*) AS n, {r("min(d)", "nearest_m", 3)} FROM (SELECT *, {hav("lon", "lat", "sx", "sy")} AS d FROM p) t WHERE d<=35 GROUP BY track_id, seq""", "gps", "segments")
def gps_edge_candidates(spark, sf_dir):
    c = spatial.segments_in_reach(load(spark, sf_dir, "gps"), load(spark, sf_dir, "segments").select("lon1", "lat1", "lon2", "lat2"), 35.0, "track_id", "seq")
    return c.select("track_id", "seq", "n", rounded(F.col("dist_m"), 3).alias("nearest_m"))


@query(f"""WITH w AS (SELECT z.zone_id, f.facility_id, z.population, f.capacity, CASE WHEN d>3000 THEN 0e0 ELSE greatest(0e0,(exp(-0.5e0*pow(d/3000,2))-exp(-0.5e0))/(1-exp(-0.5e0))) END AS w
  FROM (SELECT zone_id, facility_id, population, capacity, {hav("z0.lon", "z0.lat", "f0.lon", "f0.lat")} AS d FROM zones z0, facilities f0) q JOIN zones z USING (zone_id) JOIN facilities f USING (facility_id) WHERE d<=3000),
rr AS (SELECT facility_id, CASE WHEN sum(population*w)>0 THEN max(capacity)/sum(population*w) ELSE 0e0 END AS ra FROM w GROUP BY facility_id),
sc AS (SELECT z.zone_id, z.population, coalesce(sum(ra*w),0e0) AS s FROM zones z LEFT JOIN w USING (zone_id) LEFT JOIN rr USING (facility_id) GROUP BY z.zone_id, z.population)
SELECT zone_id, {r("s", "score", 6)} FROM sc""", "zones", "facilities")
def catchment_access(spark, sf_dir):
    s = access.catchment_scores(load(spark, sf_dir, "zones"), load(spark, sf_dir, "facilities"))
    return s.select("zone_id", rounded(F.col("score"), 6).alias("score"))


_RANKED = f"""WITH w AS (SELECT zone_id, facility_id, population, capacity, greatest(0e0,(exp(-0.5e0*pow(d/3000,2))-exp(-0.5e0))/(1-exp(-0.5e0))) AS w
  FROM (SELECT zone_id, facility_id, population, capacity, {hav("z0.lon", "z0.lat", "f0.lon", "f0.lat")} AS d FROM zones z0, facilities f0) q WHERE d<=3000),
rr AS (SELECT facility_id, CASE WHEN sum(population*w)>0 THEN max(capacity)/sum(population*w) ELSE 0e0 END AS ra FROM w GROUP BY facility_id),
sc AS (SELECT z.zone_id, z.population AS p, coalesce(sum(ra*w),0e0) AS s FROM zones z LEFT JOIN w USING (zone_id) LEFT JOIN rr USING (facility_id) GROUP BY z.zone_id, z.population),
k AS (SELECT *, row_number() OVER (ORDER BY s, zone_id) AS rk, count(*) OVER () AS n, sum(p) OVER () AS tp, sum(p*s) OVER () AS ts,
  sum(p) OVER (ORDER BY s, zone_id ROWS UNBOUNDED PRECEDING)/sum(p) OVER () AS ps, sum(p*s) OVER (ORDER BY s, zone_id ROWS UNBOUNDED PRECEDING)/sum(p*s) OVER () AS as_ FROM sc),
m AS (SELECT s AS med FROM k WHERE rk=n//2+1)"""


@query(_RANKED + f""" SELECT zone_id, CAST(rk AS BIGINT) AS rank, {r("ps", "pop_share")}, {r("as_", "acc_share")}, {r("rk*100e0/n", "percentile")},
 CASE WHEN s<=0.0001e0 THEN 'Transit Desert' WHEN s<med*0.5e0 THEN 'Underserved' WHEN s<med*1.5e0 THEN 'Adequate' ELSE 'Mobility Oasis' END AS tier FROM k, m""", "zones", "facilities")
def equity_ranks(spark, sf_dir):
    k = access.ranked(access.catchment_scores(load(spark, sf_dir, "zones"), load(spark, sf_dir, "facilities")))
    return rounded_columns(k.select("zone_id", F.col("rank").cast("long").alias("rank"), "pop_share", "acc_share", "percentile", "tier"), 4)


@query(_RANKED + f""", g AS (SELECT *, (ps-coalesce(lag(ps) OVER (ORDER BY rk),0e0))*(as_+coalesce(lag(as_) OVER (ORDER BY rk),0e0)) AS gs FROM k)
SELECT {r("least(1e0,greatest(0e0,1-sum(gs)))", "gini")}, {r("CASE WHEN sum(CASE WHEN rk*100e0/n<=40 THEN p*s ELSE 0e0 END)>0 THEN sum(CASE WHEN rk*100e0/n>=90 THEN p*s ELSE 0e0 END)/greatest(0.001e0,sum(CASE WHEN rk*100e0/n<=40 THEN p*s ELSE 0e0 END)) ELSE 1e0 END", "palma")},
 {r("greatest(0e0,sum(CASE WHEN s>0 THEN p/tp*(s/(ts/tp))*ln(s/(ts/tp)) ELSE 0e0 END))", "theil")}, {r("max(ts/tp)", "mean_score", 6)}, {r("max(med)", "median_score", 6)},
 count(*) FILTER (WHERE s<=0.0001e0) AS deserts, count(*) FILTER (WHERE s>0.0001e0 AND s<med*0.5e0) AS underserved, count(*) FILTER (WHERE s>0.0001e0 AND s>=med*0.5e0 AND s<med*1.5e0) AS adequate,
 count(*) FILTER (WHERE s>0.0001e0 AND s>=med*1.5e0) AS oases FROM g, m""", "zones", "facilities")
def equity_scorecard(spark, sf_dir):
    k = access.scorecard(access.ranked(access.catchment_scores(load(spark, sf_dir, "zones"), load(spark, sf_dir, "facilities"))))
    six = ("mean_score", "median_score")
    return rounded_columns(k.select(*[rounded(F.col(c), 6).alias(c) if c in six else F.col(c) for c in k.columns]), 4, *six)


@query(_RANKED + f""" SELECT 0 AS rank, 0e0 AS pop_share, 0e0 AS acc_share UNION ALL SELECT CAST(rk AS INTEGER), {r("ps", "pop_share")}, {r("as_", "acc_share")} FROM k WHERE (rk-1)%greatest(1,n//20)=0 OR rk=n""", "zones", "facilities")
def lorenz_curve(spark, sf_dir):
    curve = access.lorenz(access.ranked(access.catchment_scores(load(spark, sf_dir, "zones"), load(spark, sf_dir, "facilities"))))
    return rounded_columns(curve.withColumn("rank", F.col("rank").cast("int")), 4)


_HAV2 = hav("{0}", "{1}", "{2}", "{3}").replace("6371008.8e0", "6371000e0")


def _walk(a: str, b: str, c: str, d: str) -> str:
    return f"CAST(floor({_HAV2.format(a, b, c, d)}/(4.8e0/3.6e0)) AS BIGINT)"


_TRIPS = """SELECT zone_id AS query_id, lon AS olon, lat AS olat, 27.10e0 + ((zone_id*3+7) % 5)*0.006e0 AS dlon, 38.40e0 + floor(((zone_id*7+11) % 25)/5e0)*0.006e0 AS dlat, CAST(25200 + zone_id*600 AS BIGINT) AS depart_s FROM zones"""


@query(f"""WITH t AS ({_TRIPS}), b AS (SELECT query_id, depart_s, facility_id AS s, {_walk("olon", "olat", "lon", "lat")} AS w FROM t, facilities WHERE {_HAV2.format("olon", "olat", "lon", "lat")}<=1200),
a AS (SELECT query_id, facility_id AS s, {_walk("dlon", "dlat", "lon", "lat")} AS w FROM t, facilities WHERE {_HAV2.format("dlon", "dlat", "lon", "lat")}<=1200),
o AS (SELECT b.query_id, trip_id, b.s AS bs, b.w AS bw, stop_sequence AS bq, departure_s AS bt FROM b JOIN stop_times ON stop_id=b.s AND departure_s>=depart_s+b.w),
f AS (SELECT a.query_id, trip_id, a.s AS xs, a.w AS xw, stop_sequence AS xq, arrival_s AS xt FROM a JOIN stop_times ON stop_id=a.s),
j AS (SELECT *, min(xq) OVER (PARTITION BY query_id, trip_id, bs, xs) AS mx FROM o JOIN f USING (query_id, trip_id) WHERE bq<xq AND bs<>xs),
k AS (SELECT *, max(bq) OVER (PARTITION BY query_id, trip_id, bs, xs) AS mb FROM j WHERE xq=mx),
n AS (SELECT *, xt+xw AS arr, row_number() OVER (PARTITION BY query_id ORDER BY xt+xw, trip_id, bs, xs) AS rn FROM k WHERE bq=mb),
q AS (SELECT t.query_id, depart_s, {_walk("olon", "olat", "dlon", "dlat")} AS w, n.* EXCLUDE (query_id) FROM t LEFT JOIN n ON n.query_id=t.query_id AND rn=1)
SELECT query_id, CASE WHEN arr<depart_s+w THEN 'TRANSIT' ELSE 'WALK' END AS mode, CASE WHEN arr<depart_s+w THEN arr ELSE depart_s+w END AS arrive_s, CASE WHEN arr<depart_s+w THEN trip_id ELSE -1 END AS trip_id,
 CASE WHEN arr<depart_s+w THEN bs ELSE -1 END AS board_stop, CASE WHEN arr<depart_s+w THEN xs ELSE -1 END AS alight_stop, CASE WHEN arr<depart_s+w THEN bw+xw ELSE w END AS walk_s, CASE WHEN arr<depart_s+w THEN xt-bt ELSE 0 END AS ride_s FROM q""", "zones", "facilities", "stop_times")
def earliest_arrival(spark, sf_dir):
    trips = spark.sql(_TRIPS.replace("FROM zones", "FROM {zones}"), zones=load(spark, sf_dir, "zones"))
    stops = load(spark, sf_dir, "facilities").withColumnRenamed("facility_id", "stop_id")
    found = transit.earliest_arrival(trips, stops, load(spark, sf_dir, "stop_times"))
    return found.fillna(-1, ["trip_id", "board_stop", "alight_stop"])


@query(f"""WITH p AS (SELECT s_suppkey AS id, 1e0+(s_suppkey*7)%200/10e0 AS gx, 1e0+(s_suppkey*13)%200/10e0 AS gy FROM supplier),
e AS (SELECT id, floor(gx) AS c0, floor(gy) AS r0, gx-floor(gx) AS u, gy-floor(gy) AS v, i, j FROM p, (SELECT unnest([-1,0,1,2]) AS i) a, (SELECT unnest([-1,0,1,2]) AS j) b),
q AS (SELECT id, coalesce(value,0e0) AS z, u-i AS x, v-j AS y FROM e LEFT JOIN raster_cells ON col=c0+i AND row_=r0+j),
k AS (SELECT *, CASE WHEN abs(x)<=1 THEN 1.5e0*pow(abs(x),3)-2.5e0*x*x+1 WHEN abs(x)<2 THEN -0.5e0*pow(abs(x),3)+2.5e0*x*x-4*abs(x)+2 ELSE 0e0 END AS wx,
 CASE WHEN abs(y)<=1 THEN 1.5e0*pow(abs(y),3)-2.5e0*y*y+1 WHEN abs(y)<2 THEN -0.5e0*pow(abs(y),3)+2.5e0*y*y-4*abs(y)+2 ELSE 0e0 END AS wy,
 CASE WHEN x>=0 THEN 1 ELSE -1 END*CASE WHEN abs(x)<=1 THEN 4.5e0*x*x-5*abs(x) WHEN abs(x)<2 THEN -1.5e0*x*x+5*abs(x)-4 ELSE 0e0 END AS dx,
 CASE WHEN y>=0 THEN 1 ELSE -1 END*CASE WHEN abs(y)<=1 THEN 4.5e0*y*y-5*abs(y) WHEN abs(y)<2 THEN -1.5e0*y*y+5*abs(y)-4 ELSE 0e0 END AS dy FROM q),
s AS (SELECT id, sum(z*wx*wy) AS el, sum(z*dx*wy) AS du, sum(z*wx*dy) AS dv FROM k GROUP BY id)
SELECT id, {r("el", "elevation_m")}, {r("sqrt(du*du+dv*dv)/10*100", "slope_pct", 3)}, {r("du/10", "dz_dx")}, {r("dv/10", "dz_dy")} FROM s""", "raster_cells")
def bicubic_surface(spark, sf_dir):
    p = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (1.0 + (F.col("s_suppkey") * 7) % 200 / 10.0).alias("gx"), (1.0 + (F.col("s_suppkey") * 13) % 200 / 10.0).alias("gy"))
    s = spatial.bicubic(p, load(spark, sf_dir, "raster_cells")).select("id", "elevation_m", "slope_pct", "dz_dx", "dz_dy").withColumn("slope_pct", rounded(F.col("slope_pct"), 3))
    return rounded_columns(s, 4, "slope_pct")


@query(f"""WITH q AS (SELECT c.id, f.capacity, f.facility_id, sqrt(pow((c.lon-f.lon)*1000,2)+pow((c.lat-f.lat)*1000,2)) AS d, f.lon*1000 AS px, f.lat*1000 AS py FROM circles c, facilities f),
g AS (SELECT id, sum(CASE WHEN d>=1e-6 AND d<=12.3e0 THEN pow(d,-2) END) AS w, sum(CASE WHEN d>=1e-6 AND d<=12.3e0 THEN pow(d,-2)*capacity END) AS wz, min(d) AS m, arg_min(capacity,(d,px,py,capacity)) AS nz FROM q GROUP BY id)
SELECT id, {r("CASE WHEN m<1e-6 THEN nz WHEN coalesce(w,0)<=0 THEN nz ELSE wz/w END", "value", 3)} FROM g""", "circles", "facilities")
def inverse_distance(spark, sf_dir):
    # In degrees: multiplying before the difference would make other near ties of it than the SQL does.
    t = load(spark, sf_dir, "circles").select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    k = load(spark, sf_dir, "facilities").select(F.col("lon").alias("px"), F.col("lat").alias("py"), F.col("capacity").alias("pz"))
    return rounded_columns(spatial.inverse_distance(t, k, radius=0.0123, epsilon=1e-9), 3)


@query("""SELECT c.id, r.value FROM circles c LEFT JOIN raster_cells r ON r.col=CAST(floor((c.lon-27.0995e0)/0.001e0) AS BIGINT) AND r.row_=CAST(floor((c.lat-38.3995e0)/0.001e0) AS BIGINT)""", "circles", "raster_cells")
def raster_samples(spark, sf_dir):
    return spatial.sample_raster(load(spark, sf_dir, "circles"), load(spark, sf_dir, "raster_cells"), 27.0995, 38.3995, 0.001, 0.001).select("id", "value")


@query(f"""SELECT col, row_, {r("(value-(SELECT min(value) FROM raster_cells))/((SELECT max(value) FROM raster_cells)-(SELECT min(value) FROM raster_cells))", "normal")} FROM raster_cells""", "raster_cells")
def raster_normalised(spark, sf_dir):
    c = load(spark, sf_dir, "raster_cells").withColumn("layer", F.lit("dem"))
    return rounded_columns(spatial.min_max(c).select("col", "row_", "normal"), 4)


_SEGD = "sqrt(pow(ax+t*(bx-ax),2)+pow(ay+t*(by_-ay),2))"


@query(f"""WITH c AS (SELECT id, lon+(id%9-4)*0.0013e0+0.00013e0 AS lon, lat+(id%7-3)*0.0017e0+0.00021e0 AS lat FROM circles), s AS (SELECT u, v, lon1, lat1, z1, lon2, lat2, z2 FROM segments),
q AS (SELECT c.id, s.*, (s.lon1-c.lon)*cos(radians(c.lat))*111320e0 AS ax, (s.lat1-c.lat)*110540e0 AS ay, (s.lon2-c.lon)*cos(radians(c.lat))*111320e0 AS bx, (s.lat2-c.lat)*110540e0 AS by_
 FROM c JOIN s ON c.lon BETWEEN least(lon1,lon2)-0.004e0 AND greatest(lon1,lon2)+0.004e0 AND c.lat BETWEEN least(lat1,lat2)-0.004e0 AND greatest(lat1,lat2)+0.004e0),
t AS (SELECT *, least(1e0,greatest(0e0,(-ax*(bx-ax)-ay*(by_-ay))/((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)))) AS t FROM q),
d AS (SELECT *, {_SEGD} AS d FROM t), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, u, v) AS n FROM d WHERE d<=250)
SELECT id, {r("d", "dist_m", 3)}, {r("z1+t*(z2-z1)", "route_z", 3)} FROM k WHERE n=1""", "circles", "segments")
def corridor_distance(spark, sf_dir):
    """Each place's distance from the nearest street within 250 m, and the street's height there."""
    s = load(spark, sf_dir, "segments").withColumnsRenamed({"u": "route_id", "v": "seq"})
    p = load(spark, sf_dir, "circles").select("id", (F.col("lon") + (F.col("id") % 9 - 4) * 0.0013 + 0.00013).alias("lon"), (F.col("lat") + (F.col("id") % 7 - 3) * 0.0017 + 0.00021).alias("lat"))
    return rounded_columns(spatial.corridor_distance(p, s, 250.0), 3)


@query(f"""WITH l AS (SELECT track_id AS id, seq*10e0 AS t, lon, lat, lead(seq*10e0) OVER w AS t2, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM gps WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
k AS (SELECT DISTINCT track_id AS id, 10e0+7e0*n AS t FROM gps, range(12) r(n)), m AS (SELECT id, max(t) AS mt FROM l GROUP BY id)
SELECT k.id, k.t, {r("CASE WHEN k.t>=mt OR t2 IS NULL THEN lon ELSE lon+(k.t-l.t)/(t2-l.t)*(lon2-lon) END", "lon", 7)}, {r("CASE WHEN k.t>=mt OR t2 IS NULL THEN lat ELSE lat+(k.t-l.t)/(t2-l.t)*(lat2-lat) END", "lat", 7)}
FROM k JOIN m USING (id) JOIN l ON l.id=k.id AND l.t<=k.t AND (l.t2 IS NULL OR k.t<l.t2)""", "gps")
def position_at_time(spark, sf_dir):
    g = load(spark, sf_dir, "gps").select(F.col("track_id").alias("id"), (F.col("seq") * 10.0).alias("t"), "lon", "lat", F.lit(0.0).alias("z"))
    asked = g.select("id").distinct().select("id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("n")).select("id", (10.0 + 7.0 * F.col("n")).alias("t"))
    return rounded_columns(spatial.positions_at(g, asked).select("id", "t", "lon", "lat"), 7, "t")


@query(f"""WITH m AS (SELECT p_partkey AS decision, i, j, CASE WHEN i=j THEN 1e0 WHEN i<j THEN least(9e0,greatest(1e0/9,1e0+(p_partkey*(i+2*j))%5)) ELSE 1/least(9e0,greatest(1e0/9,1e0+(p_partkey*(j+2*i))%5)) END AS a
 FROM part, range(1,5) r(i), range(1,5) s(j)), c AS (SELECT decision, j, sum(a) AS s FROM m GROUP BY decision, j), w AS (SELECT m.decision, i, avg(a/s) AS w FROM m JOIN c USING (decision, j) GROUP BY m.decision, i),
a AS (SELECT m.decision, m.i, sum(a*w.w) AS aw FROM m JOIN w ON w.decision=m.decision AND w.i=m.j GROUP BY m.decision, m.i), l AS (SELECT decision, avg(aw/w) AS lm FROM a JOIN w USING (decision, i) GROUP BY decision)
SELECT decision, i, {r("w", "weight")}, {r("lm", "lambda_max")}, {r("(lm-4)/3", "consistency_index")}, {r("(lm-4)/3/0.9e0", "consistency_ratio")}, (lm-4)/3/0.9e0<=0.1e0 AS is_consistent FROM w JOIN l USING (decision)""")
def ahp_weights(spark, sf_dir):
    four = F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))
    m = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("decision"), F.explode(four).alias("i")).select("*", F.explode(four).alias("j"))
    up = lambda i, j: 1.0 + (F.col("decision") * (F.col(i) + 2 * F.col(j))) % 5
    a = F.when(F.col("i") == F.col("j"), 1.0).when(F.col("i") < F.col("j"), up("i", "j")).otherwise(1.0 / up("j", "i"))
    return rounded_columns(planning.ahp(m.withColumn("a", a)), 4)


@query(None)
def tour_order(spark, sf_dir):
    """Tours of as many facilities as a route may have waypoints, so tours grow in number with the table."""
    p = load(spark, sf_dir, "facilities").select(F.floor(F.col("facility_id") / 500).alias("tour_id"), F.col("facility_id").alias("seq"), "lon", "lat")
    return planning.tour_order(p)


def _planar(df, *columns):
    return df.select(*columns, ((F.col("lon") - 27.1) * 87000.0).alias("x"), ((F.col("lat") - 38.4) * 110540.0).alias("y"))


_HZ = "SELECT (lon-27.1e0)*87000e0 AS hx, (lat-38.4e0)*110540e0 AS hy, radius_m AS radius FROM circles"


def _evacuated(spark, sf_dir):
    o = _planar(load(spark, sf_dir, "zones"), F.col("zone_id").alias("origin_id")).withColumn("z", F.lit(10.0))
    m = _planar(load(spark, sf_dir, "facilities"), F.col("facility_id").alias("muster_id"), F.col("capacity").alias("z"))
    h = _planar(load(spark, sf_dir, "circles"), F.col("radius_m").alias("radius")).withColumnsRenamed({"x": "hx", "y": "hy"})
    return planning.evacuate(o, m, h)


_EVACUATED = f"""WITH o AS (SELECT zone_id, (lon-27.1e0)*87000e0 AS x, (lat-38.4e0)*110540e0 AS y, 10e0 AS z FROM zones), mu AS (SELECT facility_id, (lon-27.1e0)*87000e0 AS mx, (lat-38.4e0)*110540e0 AS my, capacity AS mz FROM facilities),
h AS ({_HZ}), p AS (SELECT *, sqrt(pow(mx-x,2)+pow(my-y,2)) AS d, sqrt(pow(mx-x,2)+pow(my-y,2)+pow(mz-z,2)) AS d3, greatest(mz-z,0e0) AS g FROM o, mu),
s AS (SELECT zone_id, facility_id, x+k/CAST(st AS DOUBLE)*(mx-x) AS sx, y+k/CAST(st AS DOUBLE)*(my-y) AS sy FROM (SELECT *, unnest(range(st+1)) AS k FROM (SELECT *, CAST(greatest(2,floor(d/100)) AS BIGINT) AS st FROM p) a) b),
c AS (SELECT zone_id, facility_id, min(sqrt(pow(sx-hx,2)+pow(sy-hy,2))-radius) AS c FROM s, h GROUP BY zone_id, facility_id),
q AS (SELECT p.*, coalesce(c.c,9999e0) AS c FROM p LEFT JOIN c USING (zone_id, facility_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY d3+CASE WHEN c<0 THEN 10000e0 ELSE 1000/greatest(1e0,c) END, facility_id) AS n FROM q)"""


@query(f"""{_EVACUATED}
SELECT zone_id AS origin_id, facility_id AS muster_id, {r("d3", "distance_m", 3)}, {r("g", "gain_m", 3)}, {r("d3/(4.5e0/3.6e0*greatest(0.5e0,1-2*g/greatest(1e0,d)))/60", "minutes", 3)}, {r("c", "clearance_m", 3)}, c>50 AS is_safe FROM k WHERE n=1""", "zones", "facilities", "circles")
def evacuate_straight(spark, sf_dir):
    return rounded_columns(_evacuated(spark, sf_dir), 3)


@query(f"""{_EVACUATED}, e AS (SELECT zone_id, facility_id, population, d3/(4.5e0/3.6e0*greatest(0.5e0,1-2*g/greatest(1e0,d)))/60 AS minutes FROM k JOIN zones USING (zone_id) WHERE n=1)
SELECT (SELECT sum(population) FROM zones) AS population, {r("avg(minutes)", "mean_minutes", 3)}, {r("max(minutes)", "max_minutes", 3)},
 (SELECT facility_id FROM (SELECT facility_id, sum(population) AS n FROM e GROUP BY facility_id) u ORDER BY n DESC, facility_id LIMIT 1) AS muster_id FROM e""", "zones", "facilities", "circles")
def evacuation_summary(spark, sf_dir):
    o = load(spark, sf_dir, "zones").select(F.col("zone_id").alias("origin_id"), "population")
    return rounded_columns(planning.evacuation_summary(_evacuated(spark, sf_dir), o), 3)


@query(f"""WITH f AS (SELECT facility_id AS flight_id, (lon-27.1e0)*87000e0 AS x0, (lat-38.4e0)*110540e0 AS y0, 5e0 AS z0, 1500e0 AS x1, 1500e0 AS y1, 8e0 AS z1 FROM facilities),
b AS (SELECT (lon-27.1e0)*87000e0-radius_m AS bx0, (lat-38.4e0)*110540e0-radius_m AS by0, (lon-27.1e0)*87000e0+radius_m AS bx1, (lat-38.4e0)*110540e0+radius_m AS by1, height_m AS height FROM circles),
p AS (SELECT *, sqrt(pow(x1-x0,2)+pow(y1-y0,2)) AS h, CAST(greatest(5,floor(sqrt(pow(x1-x0,2)+pow(y1-y0,2))/20)) AS BIGINT) AS n FROM f),
s AS (SELECT flight_id, x0+k/CAST(n AS DOUBLE)*(x1-x0) AS sx, y0+k/CAST(n AS DOUBLE)*(y1-y0) AS sy FROM (SELECT *, unnest(range(n+1)) AS k FROM p) a),
t AS (SELECT flight_id, max(height) AS top FROM s JOIN b ON sx BETWEEN bx0 AND bx1 AND sy BETWEEN by0 AND by1 GROUP BY flight_id),
q AS (SELECT p.*, coalesce(top,0e0) AS top FROM p LEFT JOIN t USING (flight_id)), z AS (SELECT *, least(z0+120,greatest(z0+60,CASE WHEN top>0 THEN top+25 ELSE z0+60 END)) AS zz, CASE WHEN top>0 THEN 60-top ELSE 60e0 END AS cl FROM q)
SELECT flight_id, {r("zz-z0+h+zz-z1", "distance_m", 3)}, {r("(zz-z0+h+zz-z1)/15/60", "minutes", 3)}, {r("(zz-z0+h+zz-z1)/1000/18*100", "battery_pct", 3)}, {r("cl", "clearance_m", 3)}, (zz-z0+h+zz-z1)/1000/18*100<=100 AND cl>=0 AS is_feasible FROM z""", "facilities", "circles")
def drone_corridor(spark, sf_dir):
    f = _planar(load(spark, sf_dir, "facilities"), F.col("facility_id").alias("flight_id")).withColumnsRenamed({"x": "x0", "y": "y0"})
    f = f.select("*", F.lit(5.0).alias("z0"), F.lit(1500.0).alias("x1"), F.lit(1500.0).alias("y1"), F.lit(8.0).alias("z1"))
    b = _planar(load(spark, sf_dir, "circles"), "radius_m", F.col("height_m").alias("height"))
    b = b.select("height", *[(F.col(c) + k * F.col("radius_m")).alias(f"b{c}{i}") for i, k in ((0, -1), (1, 1)) for c in ("x", "y")])
    return rounded_columns(planning.drone_corridor(f, b), 3)


_BR = "SELECT id AS obstacle_id, 100e0+(id*37)%900 AS ox, (id*11)%100*1e0 AS oy, clearance_m AS max_height, 30e0+id%20 AS max_tons, id%3=0 AS no_hazmat FROM circles"


@query(f"""WITH b AS ({_BR}), l AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2 FROM polylines WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
s AS (SELECT *, sqrt(pow(x2-x,2)+pow(y2-y,2)) AS h, abs(z2-z)/greatest(1e0,sqrt(pow(x2-x,2)+pow(y2-y,2)))*100 AS sl FROM l WHERE x2 IS NOT NULL),
g AS (SELECT route_id, sum(h)/1000 AS km, max(sl) AS m, count(*) FILTER (WHERE sl>9) AS sv FROM s GROUP BY route_id),
k AS (SELECT DISTINCT route_id, obstacle_id, max_height, max_tons, no_hazmat FROM s JOIN b ON sqrt(pow(x-ox,2)+pow(y-oy,2))<30),
o AS (SELECT route_id, count(*) FILTER (WHERE max_height<4.2e0) AS hv, count(*) FILTER (WHERE max_tons<40) AS wv, count(*) FILTER (WHERE no_hazmat) AS zv FROM k GROUP BY route_id)
SELECT route_id, {r("km", "distance_km")}, {r("m", "max_slope_pct", 3)}, sv AS slope_violations, coalesce(hv,0) AS height_violations, coalesce(wv,0) AS weight_violations, coalesce(zv,0) AS hazmat_violations,
 sv+coalesce(hv,0)+coalesce(wv,0)+coalesce(zv,0)=0 AS is_feasible FROM g LEFT JOIN o USING (route_id)""", "polylines", "circles")
def truck_clearance(spark, sf_dir):
    b = spark.sql(_BR.replace("FROM circles", "FROM {circles}"), circles=load(spark, sf_dir, "circles"))
    t = planning.truck_clearance(load(spark, sf_dir, "polylines"), b, hazmat=True).withColumn("max_slope_pct", rounded(F.col("max_slope_pct"), 3))
    return rounded_columns(t, 4, "max_slope_pct")


@query(f"""WITH s AS (SELECT facility_id AS site_id, (lon-27.1e0)*87000e0 AS x, (lat-38.4e0)*110540e0 AS y, 10e0 AS z FROM facilities),
o AS (SELECT id AS obstacle_id, (lon-27.1e0)*87000e0 AS ox, (lat-38.4e0)*110540e0 AS oy, height_m AS oz FROM circles),
p AS (SELECT *, sqrt(pow(ox-x,2)+pow(oy-y,2)) AS dist FROM s JOIN o ON abs(ox-x)<=500 AND abs(oy-y)<=500),
h AS (SELECT *, unnest([0e0,45e0,90e0,135e0,180e0,225e0,270e0,315e0]) AS heading FROM p WHERE dist<=500),
v AS (SELECT site_id, obstacle_id, heading, CASE WHEN dist<=30 THEN CASE WHEN oz>z+0.5e0 THEN oz-z END
  WHEN degrees(acos(least(1e0,greatest(-1e0,(sin(radians(heading))*(ox-x)+cos(radians(heading))*(oy-y))/greatest(dist,1e-4)))))<=15 AND oz>z+(dist-30)/8 THEN oz-(z+(dist-30)/8) END AS above FROM h),
b AS (SELECT site_id, max(above) AS m, count(DISTINCT obstacle_id) AS n, count(DISTINCT heading) AS k FROM v WHERE above IS NOT NULL GROUP BY site_id)
SELECT site_id, {r("coalesce(m,0e0)", "max_intrusion_m")}, coalesce(n,0) AS critical_obstacles, 8-coalesce(k,0) AS safe_headings, coalesce(k,0)<8 AND coalesce(m,0e0)=0 AS is_safe FROM s LEFT JOIN b USING (site_id)""", "facilities", "circles")
def landing_zones(spark, sf_dir):
    s = _planar(load(spark, sf_dir, "facilities"), F.col("facility_id").alias("site_id")).withColumn("z", F.lit(10.0))
    o = _planar(load(spark, sf_dir, "circles"), F.col("id").alias("obstacle_id"), F.col("height_m").alias("oz")).withColumnsRenamed({"x": "ox", "y": "oy"})
    return rounded_columns(planning.landing_zones(s, o), 4)


@query("""SELECT o_orderkey, CAST(lpad(CAST(((o_orderkey%40000)//3600)%24 AS VARCHAR),2,'0')||':'||lpad(CAST(((o_orderkey%40000)//60)%60 AS VARCHAR),2,'0')||':'||lpad(CAST((o_orderkey%40000)%60 AS VARCHAR),2,'0') AS VARCHAR) AS clock,
 CAST(o_orderkey%40000 AS INTEGER) AS seconds FROM orders""")
def service_clock(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", transit.clock(F.col("o_orderkey") % 40000).alias("clock"))
    return o.select("o_orderkey", "clock", transit.seconds_of("clock").alias("seconds"))


_S = "(p_size-25)/60e0"


def _cl(x: str, a: str, b: str) -> str:
    return f"least({b},greatest({a},{x}))"


_RIDE = _cl(_S, "-0.25e0", "0.25e0")
_CYC = f"CASE WHEN {_RIDE}< -0.02e0 THEN least(45e0,18e0*(1+2.2e0*abs({_RIDE}))) ELSE greatest(3.5e0,least(27e0,160e0/greatest(1e0,85e0*9.80665e0*sin(atan({_RIDE}))+0.005e0*85e0*9.80665e0*cos(atan(abs({_RIDE}))))*3.6e0)) END"


@query(f"""SELECT p_partkey, {r(f"least(8e0,greatest(0.5e0,6e0*exp(-3.5e0*abs({_cl(_S, '-0.6e0', '0.6e0')}+0.05e0))))", "tobler_kmh")}, {r(_CYC, "cyclist_kmh", 3)},
 {r("least(1e0,greatest(0.45e0,exp(-0.35e0*(0.12e0*p_size*100/1000+0.25e0*p_size*10/100))))", "fatigue")}, {r("0.5e0*1.225e0*0.88e0*0.55e0*pow(p_size/3.6e0,3)", "drag_w")},
 {r("least(1e0,greatest(0e0,(p_size+0.33e0*(35e0-p_size)-0.7e0*sqrt(greatest(0.1e0,p_partkey%7*1e0))-18)/20))", "heat")},
 {r("greatest(10e0,(CASE p_partkey%5+1 WHEN 1 THEN 80e0 WHEN 2 THEN 60e0 WHEN 3 THEN 45e0 WHEN 4 THEN 30e0 ELSE 20e0 END+least(10e0,4e0*greatest(0e0,p_partkey%4+1-2e0)))*greatest(0.5e0,1-0.85e0*least(35e0,abs(p_size-25e0))/100))", "vehicle_kmh")} FROM part""")
def kinematic_functions(spark, sf_dir):
    s = (F.col("p_size") - 25) / 60.0
    p = load(spark, sf_dir, "part").select(
        "p_partkey", K.tobler_speed(s, 5.0).alias("tobler_kmh"), rounded(K.cyclist_speed(s, 18.0), 3).alias("cyclist_kmh"),
        K.senior_fatigue(F.col("p_size") * 100.0, F.col("p_size") * 10.0).alias("fatigue"), K.drag_power(F.col("p_size") / 3.6).alias("drag_w"),
        K.thermal_stress(F.col("p_size").cast("double"), F.lit(35.0), F.col("p_partkey") % 7).alias("heat"),
        K.vehicle_speed(F.col("p_partkey") % 5 + 1, F.col("p_partkey") % 4 + 1, F.col("p_size") - 25.0, 50.0).alias("vehicle_kmh"),
    )
    return rounded_columns(p, 4, "cyclist_kmh")
