"""Registered queries on polylines and simulators, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import guidance
from ..operators import polylines as P
from ..operators import simulators as S
from ..sources.fixtures import load, oracle

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *needs: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = oracle(sql, *needs) if needs else sql
        return f

    return add


def r(expr: str, name: str, places: int = 4) -> str:
    k = f"1e{places}"
    return f"floor(({expr})*{k}+0.5e0)/{k} AS {name}"


_HAV = """2*6371008.8e0*atan2(sqrt(least(1e0,greatest(0e0,{a}))), sqrt(1e0-least(1e0,greatest(0e0,{a}))))"""


def hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    a = f"(pow(sin(radians({lat2}-{lat1})/2),2)+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lon2}-{lon1})/2),2))"
    d = _HAV.format(a=a)
    return f"(CASE WHEN abs({lon1}-{lon2})<1e-11 AND abs({lat1}-{lat2})<1e-11 THEN 0e0 ELSE {d} END)"


PLANAR = """
WITH l AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2 FROM polylines WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
s AS (SELECT *, sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)) AS h, z2-z AS dz, x2-x AS dx, y2-y AS dy,
             sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)+(z2-z)*(z2-z)) AS d FROM l WHERE x2 IS NOT NULL)
"""

DENSE = f"""
WITH l AS (SELECT *, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, lead(z) OVER w AS z2 FROM routes WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
m AS (SELECT *, CASE WHEN lon2 IS NOT NULL THEN CAST(greatest(ceil({hav("lon", "lat", "lon2", "lat2")}/12e0),1) AS INTEGER) ELSE 1 END AS steps FROM l),
e AS (SELECT *, unnest(range(steps)) AS step FROM m),
p AS (SELECT route_id, seq AS seg, CAST(step AS INTEGER) AS step,
             CASE WHEN lon2 IS NULL THEN lon ELSE lon+(lon2-lon)*(step/CAST(steps AS DOUBLE)) END AS lon,
             CASE WHEN lon2 IS NULL THEN lat ELSE lat+(lat2-lat)*(step/CAST(steps AS DOUBLE)) END AS lat,
             CASE WHEN lon2 IS NULL THEN z ELSE z+(z2-z)*(step/CAST(steps AS DOUBLE)) END AS z FROM e)
"""


def _kpi_oracle(speed: str, kcal: str) -> str:
    return (
        DENSE
        + f""", q AS (SELECT *, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, lead(z) OVER w AS z2 FROM p WINDOW w AS (PARTITION BY route_id ORDER BY seg, step)),
t AS (SELECT *, CASE WHEN lon2 IS NOT NULL THEN {hav("lon", "lat", "lon2", "lat2")} END AS flat, z2-z AS dz FROM q),
u AS (SELECT *, CASE WHEN sqrt(flat*flat+dz*dz) >= 0.01e0 THEN sqrt(flat*flat+dz*dz) END AS d FROM t),
v AS (SELECT *, CASE WHEN d IS NOT NULL THEN CASE WHEN flat>=0.01e0 THEN dz/greatest(flat,0.1e0) ELSE 0e0 END END AS s FROM u),
x AS (SELECT *, abs(s)*100 AS pct, {speed} AS kmh, {kcal} AS kcal FROM v)
SELECT route_id, {r("coalesce(sum(d),0e0)", "total_distance_m", 2)}, {r("coalesce(sum(d/greatest(kmh/3.6e0,0.1e0)),0e0)", "total_duration_s", 2)},
 {r("sum(CASE WHEN dz>0 AND d IS NOT NULL THEN dz ELSE 0e0 END)", "elevation_gain_m", 2)}, {r("coalesce(sum(CASE WHEN d IS NOT NULL AND dz<=0 THEN -dz END),0e0)", "elevation_loss_m", 2)},
 {r("min(z)", "min_elevation_m", 2)}, {r("max(z)", "max_elevation_m", 2)}, {r("coalesce(max(pct),0e0)", "max_slope_pct", 2)},
 {r("CASE WHEN coalesce(sum(d),0e0)>0 THEN sum(pct*d)/sum(d) ELSE 0e0 END", "avg_slope_pct", 2)}, {r("coalesce(sum(CASE WHEN d IS NOT NULL THEN kcal END),0e0)", "total_calories_kcal", 2)},
 count(*) FILTER (WHERE pct > 8.33e0) AS ada_violations_count,
 {", ".join(r(f"CASE WHEN coalesce(sum(d),0e0)>0 THEN 100e0*coalesce(sum(CASE WHEN pct>={a} AND pct<{b} THEN d END),0e0)/sum(d) ELSE 0e0 END", n, 2) for n, a, b in (("flat_0_3", "0e0", "3e0"), ("gentle_3_6", "3e0", "6e0"), ("moderate_6_10", "6e0", "10e0"), ("steep_10_15", "10e0", "15e0"), ("extreme_over_15", "15e0", "1e300")))}
FROM x GROUP BY route_id"""
    )


_TOBLER = "least(8e0,greatest(0.5e0,6e0*exp(-3.5e0*abs(least(0.6e0,greatest(-0.6e0,s))+0.05e0))*greatest(0.2e0,{base}/5e0)))"
_S5 = "least(0.5e0,greatest(-0.5e0,s))"
_MINETTI = f"greatest(0.6e0,280.5e0*pow({_S5},5)-58.7e0*pow({_S5},4)-76.8e0*pow({_S5},3)+51.9e0*pow({_S5},2)+19.6e0*{_S5}+2.5e0)*70e0*d/4184e0"


@query(_kpi_oracle(_TOBLER.format(base="5e0"), _MINETTI), "routes")
def route_kpis(spark, sf_dir):
    return P.rounded_columns(P.statistics(load(spark, sf_dir, "routes"), interval=12.0), 2)


_SC = "least(0.2e0,greatest(-0.2e0,s))"


@query(_kpi_oracle(f"CASE WHEN {_SC}>0.12e0 THEN 4e0 WHEN {_SC}>0 THEN greatest(4e0,20e0*greatest(0.25e0,1-pow(greatest({_SC},0e0)/0.14e0,1.5e0))) ELSE least(25e0,20e0*(1+abs({_SC})*0.5e0)) END", "0e0"), "routes")
def route_kpis_scooter(spark, sf_dir):
    return P.rounded_columns(P.statistics(load(spark, sf_dir, "routes"), "scooter", "micromobility", 20.0, interval=12.0), 2)


@query(_kpi_oracle("greatest(10e0,30e0*50e0/50e0*greatest(0.5e0,1-0.85e0*least(35e0,abs(s*100))/100))", "0e0"), "routes")
def route_kpis_car(spark, sf_dir):
    return P.rounded_columns(P.statistics(load(spark, sf_dir, "routes"), "car", "vehicle", 50.0, interval=12.0), 2)


_SO_FAR = "OVER (PARTITION BY route_id ORDER BY seg, step ROWS BETWEEN UNBOUNDED PRECEDING AND {0})"
_TIRED = f"""least(1e0,greatest(0.45e0,exp(-0.35e0*(0.12e0*coalesce(sum(d) {_SO_FAR.format("1 PRECEDING")},0e0)/1000
 +0.25e0*sum(CASE WHEN dz>0 AND d IS NOT NULL THEN dz ELSE 0e0 END) {_SO_FAR.format("CURRENT ROW")}/100))))"""


@query(_kpi_oracle(_TOBLER.format(base="3.2e0") + "*" + _TIRED, _MINETTI), "routes")
def route_kpis_senior(spark, sf_dir):
    return P.rounded_columns(P.statistics(load(spark, sf_dir, "routes"), "senior", "pedestrian", 3.2, interval=12.0), 2)


@query(DENSE + f"SELECT route_id, seg, step, {r('lon', 'lon', 6)}, {r('lat', 'lat', 6)}, {r('z', 'z')} FROM p", "routes")
def densify(spark, sf_dir):
    d = P.densify(load(spark, sf_dir, "routes"), 12.0)
    return d.select("route_id", "seg", "step", rounded(F.col("lon"), 6).alias("lon"), rounded(F.col("lat"), 6).alias("lat"), rounded(F.col("z"), 4).alias("z"))


@query(f"SELECT route_id, seq, {r('CASE WHEN count(*) OVER (PARTITION BY route_id) < 5 THEN z ELSE avg(z) OVER (PARTITION BY route_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END', 'smoothed')} FROM polylines", "polylines")
def smooth_elevation(spark, sf_dir):
    return P.smooth(load(spark, sf_dir, "polylines")).select("route_id", "seq", rounded(F.col("smoothed"), 4).alias("smoothed"))


_BRG = "((degrees(atan2({0},{1}))%360e0)+360e0)%360e0"
_TURN = f"""WITH l AS (SELECT route_id, seq, x-lag(x) OVER w AS ax, y-lag(y) OVER w AS ay, lead(x) OVER w-x AS bx, lead(y) OVER w-y AS by_ FROM polylines WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
a AS (SELECT *, ((({_BRG.format("bx", "by_")}-{_BRG.format("ax", "ay")}+180e0)%360e0)+360e0)%360e0-180e0 AS angle FROM l WHERE ax IS NOT NULL AND bx IS NOT NULL)"""
_DIR = "CASE WHEN abs(angle)<15 THEN 'straight' WHEN angle>45 THEN 'right' WHEN angle>15 THEN 'slight_right' WHEN angle< -45 THEN 'left' ELSE 'slight_left' END"


@query(_TURN + f"SELECT route_id, seq, {r('angle', 'angle')}, {_DIR} AS direction FROM a", "polylines")
def turn_directions(spark, sf_dir):
    t = P.turns(load(spark, sf_dir, "polylines"), "x", "y")
    return t.select("route_id", "seq", rounded(F.col("angle"), 4).alias("angle"), "direction")


_CUES = f"""
WITH RECURSIVE l AS (SELECT route_id, seq, lon, lat, z, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat, lag(z) OVER w AS pz, lead(lon) OVER w AS nlon, lead(lat) OVER w AS nlat,
   row_number() OVER w AS rn FROM routes WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
p AS MATERIALIZED (SELECT route_id, rn, {hav("plon", "plat", "lon", "lat")} AS d, z-pz AS dz, nlon IS NULL AS last,
   ((({_BRG.format("nlon-lon", "nlat-lat")}-{_BRG.format("lon-plon", "lat-plat")}+180e0)%360e0)+360e0)%360e0-180e0 AS angle FROM l WHERE plon IS NOT NULL),
f AS (SELECT route_id, CAST(1 AS BIGINT) AS rn, 0e0 AS d, 0e0 AS dz, 0e0 AS od, 0e0 AS odz, true AS emit, 'depart' AS direction FROM l WHERE rn = 1 AND nlon IS NOT NULL
  UNION ALL
  SELECT p.route_id, p.rn, CASE WHEN p.last OR {_DIR.replace("angle", "p.angle")}<>'straight' OR f.d+p.d>400e0 THEN 0e0 ELSE f.d+p.d END,
         CASE WHEN p.last OR {_DIR.replace("angle", "p.angle")}<>'straight' OR f.d+p.d>400e0 THEN 0e0 ELSE f.dz+p.dz END, f.d+p.d, f.dz+p.dz,
         p.last OR {_DIR.replace("angle", "p.angle")}<>'straight' OR f.d+p.d>400e0, CASE WHEN p.last THEN 'arrive' ELSE {_DIR.replace("angle", "p.angle")} END
  FROM f JOIN p ON p.route_id=f.route_id AND p.rn=f.rn+1)
SELECT route_id, CAST(row_number() OVER (PARTITION BY route_id ORDER BY rn) AS INTEGER) AS step, direction, {r("od", "distance_m", 3)}, {r("odz", "elevation_delta_m", 3)},
 {r("CASE WHEN direction IN ('depart','arrive') THEN 0e0 ELSE odz/greatest(od,0.1e0)*100 END", "slope_pct", 3)} FROM f WHERE emit
"""


@query(_CUES, "routes")
def cue_sheet(spark, sf_dir):
    c = P.cue_sheet(load(spark, sf_dir, "routes")).join(_with_steps(load(spark, sf_dir, "routes")), "route_id", "left_semi")
    return P.rounded_columns(c.select("route_id", "step", "direction", "distance_m", "elevation_delta_m", "slope_pct"), 3)


def _with_steps(points):
    return points.groupBy("route_id").count().where("count > 1")


@query(f"""WITH RECURSIVE p AS MATERIALIZED (SELECT route_id, row_number() OVER (PARTITION BY route_id ORDER BY seq) AS rn, lon, lat FROM routes),
f AS (SELECT route_id, rn, lon, lat, CAST(1 AS INTEGER) AS n FROM p WHERE rn = 1
 UNION ALL SELECT route_id, rn, CASE WHEN far THEN lon ELSE flon END, CASE WHEN far THEN lat ELSE flat END, CAST(n + far::INTEGER AS INTEGER)
 FROM (SELECT p.*, f.n, f.lon AS flon, f.lat AS flat, {hav("f.lon", "f.lat", "p.lon", "p.lat")}>0.05e0 AS far FROM f JOIN p ON p.route_id=f.route_id AND p.rn=f.rn+1) q)
SELECT route_id, max(n) AS n FROM f GROUP BY route_id""", "routes")
def deduplicate_adjacent(spark, sf_dir):
    return P.without_repeats(load(spark, sf_dir, "routes")).select("route_id", F.size("points").alias("n"))


@query(PLANAR + f"""SELECT route_id, count(*) AS n, {r("sum(d)", "distance_m", 3)}, {r("sum(CASE WHEN dz>0 THEN dz ELSE 0e0 END)", "gain_m", 3)} FROM s GROUP BY route_id""", "polylines")
def planar_segments(spark, sf_dir):
    s = P.planar_steps(load(spark, sf_dir, "polylines"))
    g = s.groupBy("route_id").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("distance_m"), F.sum(F.when(F.col("dz") > 0, F.col("dz")).otherwise(0.0)).alias("gain_m"))
    return P.rounded_columns(g, 3)


# ---- simulators on polylines ----

_EV = PLANAR.replace("WITH l", "WITH RECURSIVE l", 1) + f""",
f0 AS (SELECT route_id, row_number() OVER (PARTITION BY route_id ORDER BY seq) AS k, d, greatest(speed_kmh/3.6e0,1e0) AS v,
  0.01e0*1950e0*9.80665e0*cos(atan2(dz,greatest(h,1e-4)))+0.5e0*1.225e0*0.23e0*2.3e0*pow(greatest(speed_kmh/3.6e0,1e0),2)+1950e0*9.80665e0*sin(atan2(dz,greatest(h,1e-4))) AS f FROM s WHERE d>1e-4),
f1 AS (SELECT *, d/v AS t, f*v AS w FROM f0),
f2 AS MATERIALIZED (SELECT *, CASE WHEN w>=0 THEN w*t/3.6e6/0.9e0+1.5e0*t/3600 ELSE 1.5e0*t/3600-least(60e0,abs(w)/1000)*t/3600*0.75e0*0.9e0 END AS use FROM f1),
g AS (SELECT route_id, CAST(0 AS BIGINT) AS k, 67.5e0 AS b, 0e0 AS dd, CAST(NULL AS DOUBLE) AS gone FROM f2 WHERE k=1
 UNION ALL SELECT g.route_id, f2.k, least(75e0,greatest(0e0,g.b-f2.use)), g.dd+f2.d, CASE WHEN g.gone IS NULL AND least(75e0,greatest(0e0,g.b-f2.use))<=0 THEN (g.dd+f2.d)/1000 ELSE g.gone END
 FROM g JOIN f2 ON f2.route_id=g.route_id AND f2.k=g.k+1),
h AS (SELECT route_id, arg_max(b,k) AS b, max(gone) AS gone FROM g GROUP BY route_id),
i AS (SELECT route_id, sum(d)/1000 AS km, sum(t)/60 AS mins, sum(CASE WHEN use>0 THEN use ELSE 0e0 END) AS c, sum(CASE WHEN use<0 THEN -use ELSE 0e0 END) AS rg FROM f2 GROUP BY route_id)
SELECT route_id, {r("km", "total_distance_km")}, {r("mins", "total_duration_min")}, {r("c", "consumed_kwh")}, {r("rg", "regenerated_kwh")}, {r("c-rg", "net_kwh")},
 {r("b/75e0*100", "final_soc_percent")}, {r("(c-rg)*1000/greatest(km,0.01e0)", "wh_per_km", 3)}, gone IS NOT NULL AS is_depleted, gone AS depletion_km FROM i JOIN h USING (route_id)"""


@query(_EV, "polylines")
def ev_energy(spark, sf_dir):
    e = S.ev_energy(load(spark, sf_dir, "polylines")).withColumn("wh_per_km", rounded(F.col("wh_per_km"), 3))
    return P.rounded_columns(e, 4, "wh_per_km", "depletion_km")


@query(PLANAR + f""", t AS (SELECT *, (0.012e0*1600*9.81e0+0.5e0*1.225e0*0.32e0*2.2e0*pow(speed_kmh/3.6e0,2)+greatest(1600e0*9.81e0*dz/greatest(d,1e-4),0e0))*d AS w,
 greatest(1600e0*9.81e0*dz/greatest(d,1e-4),0e0)*d AS c FROM s), g AS (SELECT route_id, sum(d) AS d, sum(w)/0.3e0/36e6 AS l, sum(c)/0.3e0/36e6 AS lc, sum(w) AS w FROM t GROUP BY route_id)
SELECT route_id, {r("l*2640e0/1000", "co2_kg")}, {r("l", "fuel_litres")}, {r("l*2640e0/greatest(d/1000,0.01e0)", "co2_g_per_km")}, {r("w/3.6e6", "energy_kwh")}, {r("lc*2640e0/1000", "gradient_co2_kg")},
 l*2640e0/greatest(d/1000,0.01e0)<150 AS is_eco_optimal FROM g""", "polylines")
def co2_emissions(spark, sf_dir):
    return P.rounded_columns(S.co2_emissions(load(spark, sf_dir, "polylines")), 4)


_MENGER = """WITH l AS (SELECT route_id, seq, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM polylines WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
m AS (SELECT *, sqrt((x-x0)*(x-x0)+(y-y0)*(y-y0)) AS a, sqrt((x1-x)*(x1-x)+(y1-y)*(y1-y)) AS b, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS c FROM l WHERE x1 IS NOT NULL),
n AS (SELECT *, sqrt(greatest(0e0,(a+b+c)/2*((a+b+c)/2-a)*((a+b+c)/2-b)*((a+b+c)/2-c))) AS ar FROM m),
o AS (SELECT *, coalesce(CASE WHEN a*b*c>1e-4 AND ar>1e-4 THEN a*b*c/(4*ar) ELSE 500e0 END,500e0) AS rad FROM n),
q AS (SELECT *, 3.5e0+CASE WHEN rad>48 AND rad<500 THEN rad-sqrt(greatest(0e0,rad*rad-48e0*48e0)) ELSE 48e0*48e0/(2*greatest(rad,10e0)) END AS w FROM o WHERE b>=1e-4)"""


@query(_MENGER + f"SELECT route_id, {r('max(w)', 'max_swept_width_m')}, count(*) FILTER (WHERE w/2>4) AS encroachments, count(*) FILTER (WHERE w/2>4)=0 AS is_negotiable FROM q GROUP BY route_id", "polylines")
def swept_path(spark, sf_dir):
    return P.rounded_columns(S.swept_path(load(spark, sf_dir, "polylines")).drop("corridor_area_m2"), 4)


@query(PLANAR.replace("WITH l", "WITH RECURSIVE l", 1) + f""",
n AS MATERIALIZED (SELECT route_id, row_number() OVER (PARTITION BY route_id ORDER BY seq) AS k, h, dz/greatest(h,1e0) AS g, greatest(speed_kmh/3.6e0,1e0) AS v FROM s),
f AS (SELECT route_id, CAST(0 AS BIGINT) AS k, 85e0 AS t, 0e0 AS fan, 0e0 AS st, 0e0 AS pk FROM n WHERE k=1
 UNION ALL SELECT q.route_id, q.k, q.t2, q.fan, q.st+CASE WHEN q.t2>100 THEN (q.t2-100)*q.dt/60 ELSE 0e0 END, greatest(q.pk,floor(q.t2*10+0.5e0)/10) FROM (
  SELECT n.route_id, n.k, n.h/n.v AS dt, f.fan+CASE WHEN f.t>95 THEN n.h/n.v ELSE 0e0 END AS fan, f.st, f.pk,
   greatest(80e0, f.t+(0.65e0*least(370e0,(38000e0*9.81e0*greatest(n.g,0e0)*n.v+0.008e0*38000e0*9.81e0*n.v)/1000)-160e0*(greatest(f.t-35e0,0e0)/60)*sqrt(n.v/10)*CASE WHEN f.t>95 THEN 1.45e0 ELSE 1e0 END)*(n.h/n.v)/(45e0*4.18e0)) AS t2
  FROM f JOIN n ON n.route_id=f.route_id AND n.k=f.k+1) q)
SELECT route_id, {r("arg_max(pk,k)", "peak_coolant_c", 3)}, {r("arg_max(fan,k)", "fan_s", 3)}, {r("arg_max(st,k)", "stress_index", 3)}, arg_max(pk,k)>105 AS is_overheating FROM f GROUP BY route_id HAVING max(k)>0""", "polylines")
def heat_soak(spark, sf_dir):
    return P.rounded_columns(S.heat_soak(load(spark, sf_dir, "polylines")), 3)


@query(PLANAR + f""", t AS (SELECT *, CASE WHEN h>0 THEN abs(dz)/greatest(h,1e0)*100 ELSE 0e0 END AS sl FROM s),
g AS (SELECT route_id, sum(d) AS d, sum(CASE WHEN dz<0 THEN -dz ELSE 0e0 END) AS dr, CASE WHEN sum(h)>0 THEN sum(sl*h)/sum(h) ELSE 0e0 END AS av, max(sl) AS m, bool_or(dz>0.2e0) AS up FROM t GROUP BY route_id)
SELECT route_id, {r("d", "distance_m", 3)}, {r("dr", "vertical_drop_m", 3)}, {r("av", "avg_slope_pct", 3)}, {r("m", "max_slope_pct", 3)},
 CASE WHEN m<=15 THEN 'GREEN' WHEN m<=25 THEN 'BLUE' WHEN m<=40 THEN 'RED' ELSE 'BLACK' END AS piste,
 {r("d/(CASE WHEN m<=15 THEN 7e0 WHEN m<=25 THEN 11e0 WHEN m<=40 THEN 15e0 ELSE 19e0 END)/60", "minutes", 3)}, up AS has_uphill FROM g""", "polylines")
def ski_piste(spark, sf_dir):
    return P.rounded_columns(S.ski_piste(load(spark, sf_dir, "polylines")), 3)


@query(f"""WITH l AS (SELECT route_id, seq, lon, lat, (z-95e0)/2 AS dep, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, lead((z-95e0)/2) OVER w AS dep2 FROM routes WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
p AS (SELECT route_id, sqrt(pow((lat2-lat)*60,2)+pow((lon2-lon)*60*cos(radians((lat+lat2)/2)),2)) AS nm, least(dep,dep2) AS dep FROM l WHERE lon2 IS NOT NULL),
q AS (SELECT *, CASE WHEN nm>1 THEN 1.4e0 ELSE 2.8e0 END AS dr FROM p),
g AS (SELECT route_id, sum(nm) AS nm, min(dep-dr) AS uk, bool_or(dep/greatest(dr,0.5e0)<1.4e0) AS sq, sum(CASE WHEN nm>0.5e0 AND dep>4 THEN nm ELSE 0e0 END) AS f FROM q GROUP BY route_id),
k AS (SELECT *, CASE WHEN nm>0 THEN f/greatest(nm,1e-9)*100 ELSE 0e0 END AS pct FROM g)
SELECT route_id, {r("nm", "nautical_miles", 5)}, {r("nm/(CASE WHEN pct>50 THEN 38e0 ELSE 17.6e0 END)", "hours", 5)}, {r("pct", "foilborne_pct", 3)}, {r("uk", "min_under_keel_m", 5)}, sq AS squat_risk, {r("nm*(45e0/12.5e0)*3.8e0", "fuel_litres", 5)} FROM k""", "routes")
def hydrofoil(spark, sf_dir):
    points = load(spark, sf_dir, "routes").withColumn("depth", (F.col("z") - 95.0) / 2.0)
    out = S.hydrofoil(points).withColumn("foilborne_pct", rounded(F.col("foilborne_pct"), 3))
    return P.rounded_columns(out, 5, "foilborne_pct")


_SURF = ["asphalt_smooth", "asphalt_rough", "paving_tiles", "gravel", "cobblestone", "plank"]


@query(PLANAR + f""", t AS (SELECT route_id, h AS len, speed_kmh AS k, CASE seq%6 WHEN 0 THEN 1.5e0 WHEN 1 THEN 3.8e0 WHEN 2 THEN 5.2e0 WHEN 3 THEN 8e0 WHEN 4 THEN 12.5e0 ELSE 2.5e0 END AS iri FROM s),
u AS (SELECT *, 0.08e0*iri*pow(k/3.6e0/2.78e0,0.7e0)*sqrt(2.8e0) AS a FROM t),
v AS (SELECT *, a*pow(len/greatest(k/3.6e0,0.5e0),0.25e0) AS vdv, least(1e0,iri/15*(k/25)*(sqrt(2.8e0)/1.8e0)) AS risk FROM u),
g AS (SELECT route_id, sum(len)/1000 AS km, avg(a) AS rms, max(vdv) AS vdv, count(*) FILTER (WHERE a>0.63e0) AS un, count(*) FILTER (WHERE risk>=0.6e0) AS hs FROM v GROUP BY route_id)
SELECT route_id, {r("km", "distance_km")}, {r("rms", "mean_rms")}, {r("vdv", "max_vdv")}, un AS uncomfortable, hs AS hotspots, {r("greatest(0e0,100-45*rms-5*hs)", "bikeability", 3)} FROM g""", "polylines")
def micromobility(spark, sf_dir):
    surface = F.element_at(F.lit(_SURF), (F.col("seq") % 6 + 1).cast("int"))
    p = P.planar_steps(load(spark, sf_dir, "polylines")).select("route_id", F.col("h").alias("length_m"), surface.alias("surface"), "speed_kmh")
    out = S.micromobility(p).withColumn("bikeability", rounded(F.col("bikeability"), 3))
    return P.rounded_columns(out, 4, "bikeability")


@query(PLANAR + f""", t AS (SELECT route_id, h, speed_kmh/3.6e0 AS v, atan2(dx,dy) AS hd FROM s),
u AS (SELECT *, -6e0*sin(radians(270e0))-v*sin(hd) AS ax, -6e0*cos(radians(270e0))-v*cos(hd) AS ay FROM t),
w AS (SELECT *, sqrt(ax*ax+ay*ay) AS va, abs((((degrees(atan2(-ax,-ay))-degrees(hd)+180)%360e0)+360e0)%360e0-180) AS yaw FROM u),
x AS (SELECT *, (greatest(0e0,0.5e0*1.225e0*0.88e0*0.55e0*va*va*cos(radians(yaw))*v)-0.5e0*1.225e0*0.88e0*0.55e0*v*v*v)*(h/greatest(v,1e0)) AS j FROM w)
SELECT route_id, {r("sum(h)/1000", "distance_km")}, {r("sum(j)/3.6e6", "penalty_kwh")}, {r("avg(va)", "mean_apparent_ms")},
 {r("sum(CASE WHEN yaw>120 THEN h ELSE 0e0 END)/greatest(sum(h),1e0)", "tailwind_ratio")}, {r("sum(CASE WHEN yaw<60 THEN h ELSE 0e0 END)/greatest(sum(h),1e0)", "headwind_ratio")} FROM x GROUP BY route_id""", "polylines")
def wind_resistance(spark, sf_dir):
    return P.rounded_columns(S.wind(load(spark, sf_dir, "polylines")), 4)


_RC = "least(0.45e0,greatest(-0.45e0,sl))"


@query(PLANAR + f""", t AS (SELECT *, CASE WHEN h>0 THEN dz/greatest(h,1e-4) ELSE 0e0 END AS sl FROM s),
u AS (SELECT *, greatest(1.8e0,155.4e0*pow({_RC},5)-30.4e0*pow({_RC},4)-43.3e0*pow({_RC},3)+46.3e0*pow({_RC},2)+19.5e0*{_RC}+3.6e0)*75e0*d/4184e0 AS kc, greatest(1.5e0,8e0*exp(-3.5e0*abs(sl+0.05e0))) AS sp FROM t),
v AS (SELECT *, kc/70/greatest(d/1000/sp,1e-4) AS met FROM u), w AS (SELECT *, floor(least(185e0,60+least(1e0,met/14)*125)) AS hr FROM v),
x AS (SELECT *, sum(kc) OVER (PARTITION BY route_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (PARTITION BY route_id ORDER BY seq)-1 AS i, count(*) OVER (PARTITION BY route_id) AS n FROM w)
SELECT route_id, {r("sum(d)/1000", "distance_km")}, {r("sum(kc)", "kcal", 3)}, {r("avg(met)", "mean_mets", 3)}, CAST(floor(avg(hr)) AS BIGINT) AS mean_hr, CAST(max(hr) AS BIGINT) AS peak_hr, {r("max(least(1e0,cum/1200+0.3e0*i/n))", "max_fatigue")},
 {", ".join(r(f"100e0*count(*) FILTER (WHERE hr/185>={a} AND hr/185<{b})/count(*)", f"zone{k}", 3) for k, a, b in ((1, "-1", "0.6e0"), (2, "0.6e0", "0.7e0"), (3, "0.7e0", "0.8e0"), (4, "0.8e0", "0.9e0"), (5, "0.9e0", "9")))} FROM x GROUP BY route_id""", "polylines")
def biomechanics(spark, sf_dir):
    out = S.biomechanics(load(spark, sf_dir, "polylines"))
    three = ("kcal", "mean_mets", *[f"zone{k}" for k in range(1, 6)])
    out = out.select(*[rounded(F.col(c), 3).alias(c) if c in three else F.col(c) for c in out.columns])
    return P.rounded_columns(out, 4, *three)


@query(None)
def street_shade(spark, sf_dir):
    return P.rounded_columns(S.shade(load(spark, sf_dir, "polylines")), 4)


# ---- simulators on parameter rows ----


def _columns(df, made: dict, *keep: str, places: int = 4):
    return P.rounded_columns(df.select(*keep, *[c.alias(n) for n, c in made.items()]), places)


@query(f"""WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 80e0+0.65e0*24000*9.81e0*(l_quantity*8e0)/60000 AS pk, 30e0+l_quantity AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r("pk", "peak_c")}, {r("pk-80", "rise_c")}, CASE WHEN pk<=180 THEN 'LOW' WHEN pk<=300 THEN 'MODERATE' ELSE 'CRITICAL_RUNAWAY' END AS risk,
 {r("CASE WHEN pk<=180 THEN v WHEN pk<=300 THEN least(40e0,v*0.7e0) ELSE least(25e0,v*0.4e0) END", "safe_speed_kmh")}, pk<=300 AS is_safe FROM q""")
def brake_fade(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem")
    return _columns(t, S.brake_fade(F.col("l_quantity") * 8.0, 30.0 + F.col("l_quantity")), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"""WITH q AS (SELECT p_partkey, (p_size%40)/10e0 AS g, greatest(20e0+p_size,1e0) AS v, CASE p_partkey%5 WHEN 0 THEN 1e0 WHEN 1 THEN 0.72e0 WHEN 2 THEN 0.45e0 WHEN 3 THEN 0.5e0 ELSE 1e0 END AS f FROM part),
m AS (SELECT *, (7.5e0/(v+44)+0.161e0)*f AS mu FROM q), e AS (SELECT *, least(mu*120*9.81e0,6400e0/greatest(v/3.6e0,1e0)) AS ef, 2520*9.81e0*(g/100+0.0025e0) AS res FROM m)
SELECT p_partkey, {r("mu", "mu")}, {r("ef", "max_effort_kn")}, {r("(ef/(2520*9.81e0)-0.0025e0)*100", "max_grade_pct")}, res>mu*120*9.81e0 AS is_slip_risk,
 {r("least(100e0,greatest(0e0,res*(v/3.6e0)/6400*100))", "utilization_pct")}, {r("greatest(0e0,1000-v*v/(mu*9.81e0))", "braking_margin_m")} FROM e""")
def rail_adhesion(spark, sf_dir):
    t = load(spark, sf_dir, "part")
    state = F.element_at(F.lit(["DRY", "WET", "LEAF", "FROST", "OTHER"]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return _columns(t, S.rail_adhesion((F.col("p_size") % 40) / 10.0, state, 20.0 + F.col("p_size")), "p_partkey")


@query(f"""WITH q AS (SELECT p_partkey, 60e0+p_size AS v, 0.00338e0*pow(1e0/25.4e0,0.11e0)*pow(7.5e0*3.28084e0,0.43e0)*pow(greatest(p_size*2e0/25.4e0,0.1e0),0.59e0)*pow(0.02e0,-0.42e0)-1e0/25.4e0 AS w FROM part),
f AS (SELECT p_partkey, v, greatest(w,0e0)*25.4e0 AS film FROM q), c AS (SELECT *, 6.35e0*sqrt(220e0)*0.65e0*CASE WHEN film<1 THEN 1e0 ELSE greatest(0.7e0,1-0.08e0*(film-1)) END AS cr FROM f)
SELECT p_partkey, {r("film", "film_mm")}, {r("cr", "critical_kmh")}, v>=cr AS is_risk, {r("cr-v", "margin_kmh")} FROM c""")
def hydroplaning(spark, sf_dir):
    t = load(spark, sf_dir, "part")
    return _columns(t, S.hydroplaning(60.0 + F.col("p_size"), F.col("p_size") * 2.0), "p_partkey")


@query(f"""WITH q AS (SELECT p_partkey, greatest(2e0,1e0+p_partkey%6) AS n, greatest(4e0,p_size*1e0) AS g FROM part),
f AS (SELECT *, least(10e0,greatest(2e0,9.5e0*exp(-0.035e0*g))) AS le, least(22e0,greatest(5e0,20e0*exp(-0.04e0*g))) AS tr FROM q), o AS (SELECT *, (le+(n-1)*tr)/n AS ov FROM f), s AS (SELECT *, n*4.5e0*31e0*ov/100 AS sv FROM o)
SELECT p_partkey, {r("le", "lead_pct")}, {r("tr", "trailing_pct")}, {r("ov", "overall_pct")}, {r("sv", "saved_litres")}, {r("sv*2.68e0", "co2_kg")}, {r("sv*1.45e0", "usd")} FROM s""")
def platooning(spark, sf_dir):
    t = load(spark, sf_dir, "part")
    return _columns(t, S.platooning(1.0 + F.col("p_partkey") % 6, F.col("p_size") * 1.0), "p_partkey")


@query(f"""WITH q AS (SELECT p_partkey, 1e0+p_size AS mw, 500e0+p_size*40 AS len FROM part), t AS (SELECT *, 293.15e0+mw*1000/(1.2e0*1.005e0*65*2.5e0) AS tf FROM q),
c AS (SELECT *, 1.07e0*pow(9.81e0*8.5e0*mw*1000/greatest(1.2e0*1.005e0*65*tf,1e0),1e0/3e0) AS vc FROM t), v AS (SELECT *, greatest(2.5e0,vc*1.05e0) AS va FROM c)
SELECT p_partkey, {r("vc", "critical_ms")}, {r("va", "air_ms")}, {r("tf-273.15e0", "smoke_c")}, {r("least(30e0,greatest(10e0,250e0/greatest(4*mw,10e0)))", "visibility_m")},
 CAST(greatest(4,ceil(0.5e0*1.2e0*va*va*(1.5e0+0.022e0*len/8.5e0)*65/1200)) AS INTEGER) AS jet_fans, va>=vc AS is_prevented FROM v""")
def tunnel_smoke(spark, sf_dir):
    t = load(spark, sf_dir, "part")
    return _columns(t, S.tunnel_smoke(1.0 + F.col("p_size"), 500.0 + F.col("p_size") * 40.0), "p_partkey")


@query(f"""WITH q AS (SELECT p_partkey, (300e0+p_size*18)/3.6e0 AS v, least(0.95e0,greatest(0.05e0,3.8e0/(pi()*4e0))) AS br FROM part),
k AS (SELECT *, sqrt(5e0*(pow(1/(1-br),0.4e0/1.4e0)-1)) AS lim, v/sqrt(1.4e0*287.05e0*293.15e0) AS m FROM q),
d AS (SELECT *, 0.5e0*(100e0/(287.05e0*293.15e0))*v*v*0.2e0*3.8e0/greatest(0.2e0,sqrt(greatest(0.05e0,1-least(0.95e0,m*m))))*CASE WHEN m>lim THEN 3.5e0 ELSE 1e0 END AS dr FROM k)
SELECT p_partkey, {r("br", "blockage")}, {r("lim", "kantrowitz_mach")}, {r("m", "mach")}, m>lim AS is_choked, {r("dr", "drag_n")}, {r("dr*v/1000", "power_kw", 4)} FROM d""")
def hyperloop(spark, sf_dir):
    return _columns(load(spark, sf_dir, "part"), S.hyperloop(300.0 + F.col("p_size") * 18.0), "p_partkey")


@query(f"""WITH q AS (SELECT p_partkey, radians(38.4e0+p_size/10e0) AS ph, 6e0+p_partkey%13 AS hr, radians(23.45e0*sin(radians(360e0/365e0*(284e0+p_size*7)))) AS de FROM part),
e AS (SELECT *, least(1e0,greatest(-1e0,sin(ph)*sin(de)+cos(ph)*cos(de)*cos(radians(15*(hr-12))))) AS se FROM q),
a AS (SELECT *, degrees(acos(least(1e0,greatest(-1e0,(sin(de)-se*sin(ph))/greatest(1e-6,cos(asin(se))*cos(ph)))))) AS az FROM e)
SELECT p_partkey, {r("degrees(asin(se))", "elevation_deg", 3)}, {r("CASE WHEN hr=12 THEN 0e0 WHEN hr>12 THEN 360-az ELSE az END", "azimuth_deg", 3)}, {r("CASE WHEN se>0 THEN 1000*se ELSE 0e0 END", "irradiance", 3)} FROM a""")
def solar_position(spark, sf_dir):
    t = load(spark, sf_dir, "part")
    hour = 6.0 + F.col("p_partkey") % 13
    made = S.solar_position(38.4 + F.col("p_size") / 10.0, hour, F.col("p_size") * 7)
    made["azimuth_deg"] = F.when(hour == 12, 0.0).otherwise(made["azimuth_deg"])  # acos near -1 is not stable to 3 places
    return _columns(t, made, "p_partkey", places=3)


@query(f"""WITH q AS (SELECT id, 0e0 AS x, 0e0 AS y, id%24 AS hour FROM circles), f AS (SELECT *, CASE hour WHEN 7 THEN 0.75e0 WHEN 8 THEN 0.6e0 WHEN 9 THEN 0.7e0 WHEN 12 THEN 0.85e0 WHEN 13 THEN 0.85e0 WHEN 17 THEN 0.55e0 WHEN 18 THEN 0.5e0 WHEN 19 THEN 0.65e0 ELSE 0.95e0 END AS fa FROM q)
SELECT id, hour, cutoff_min, {r("40e0*fa*1000/60*cutoff_min", "radius_m")}, count(*) AS vertices FROM f CROSS JOIN (SELECT unnest([5e0,15e0,30e0]) AS cutoff_min) c CROSS JOIN range(37) k GROUP BY id, hour, cutoff_min, fa""", "circles")
def congested_rings(spark, sf_dir):
    d = load(spark, sf_dir, "circles").select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), (F.col("id") % 24).alias("hour"))
    rings = S.congested_rings(d, [5.0, 15.0, 30.0])
    return rings.groupBy("id", "hour", "cutoff_min").agg(rounded(F.max("radius_m"), 4).alias("radius_m"), F.count(F.lit(1)).alias("vertices"))


@query(f"""WITH p AS (SELECT route_id, row_number() OVER w AS step, x, y, z, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM polylines WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
q AS (SELECT *, coalesce(sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)),0e0) AS d, coalesce(z2-z,0e0) AS dz, sqrt((x-x0)*(x-x0)+(y-y0)*(y-y0)) AS d0, degrees(atan2(x2-x,y2-y)-atan2(x-x0,y-y0)) AS a FROM p WHERE x2 IS NOT NULL OR x0 IS NOT NULL),
s AS (SELECT *, dz/greatest(d,1e0)*100 AS pct, floor((CASE WHEN a>180 THEN a-360 WHEN a<-180 THEN a+360 ELSE a END)*1e9+0.5e0)/1e9 AS t FROM q),
m AS (SELECT *, CASE WHEN x0 IS NULL THEN 'DEPART' WHEN x2 IS NULL THEN 'ARRIVE' WHEN t>45 THEN 'TURN_RIGHT' WHEN t<-45 THEN 'TURN_LEFT' WHEN pct>10 THEN 'STEEP_CLIMB' WHEN pct<-10 THEN 'STEEP_DESCENT' ELSE 'STRAIGHT' END AS maneuver FROM s)
SELECT route_id, step, maneuver, {r("d", "distance_to_next_m")}, {r("pct", "slope_percent")}, {r("dz", "elevation_delta_m")},
 CASE maneuver WHEN 'DEPART' THEN 'Start your route and proceed straight ahead.' WHEN 'ARRIVE' THEN 'You have arrived at your destination.' WHEN 'TURN_RIGHT' THEN 'In '||CAST(floor(d0) AS BIGINT)||' meters, turn right.'
 WHEN 'TURN_LEFT' THEN 'In '||CAST(floor(d0) AS BIGINT)||' meters, turn left.' WHEN 'STEEP_CLIMB' THEN 'Steep climb ahead: '||CAST(floor(pct) AS BIGINT)||'% incline.'
 WHEN 'STEEP_DESCENT' THEN 'Steep descent ahead: '||CAST(floor(abs(pct)) AS BIGINT)||'% slope, control speed.' ELSE 'Continue straight.' END AS text_en FROM m""", "polylines")
def voice_guidance(spark, sf_dir):
    return P.rounded_columns(guidance.instructions(load(spark, sf_dir, "polylines")).drop("text_de", "text_tr"), 4)
