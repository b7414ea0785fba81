"""Registered queries on what stands along routes and on raster files, each with the SQL that checks it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import projection as P
from ..functions.durable import durable, shared_folder
from ..functions.numbers import rounded
from ..operators import corridor, spatial, surface
from ..operators.polylines import elevation_profile, rounded_columns
from ..sources import elevation_store, exports, geotiff, networks, urban
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


@query(f"""WITH RECURSIVE c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY (id*7919)%1009, id) AS k, id, lon, lat, 100e0+(id%3)*40 AS s FROM nodes),
g(k, placed) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE)[])
 UNION ALL SELECT c.k, CASE WHEN len(list_filter(g.placed, lambda p: {hav("c.lon", "c.lat", "p.x", "p.y")}<c.s))=0 THEN list_append(g.placed, {{'id': c.id, 'x': c.lon, 'y': c.lat}}) ELSE g.placed END FROM g JOIN c ON c.k=g.k+1)
SELECT p.id AS id FROM (SELECT unnest(placed) AS p FROM (SELECT placed FROM g ORDER BY k DESC LIMIT 1) q) t""", "nodes")
def spaced_nodes(spark, sf_dir):
    """Nodes chosen in a shuffled order so that each is 100 to 180 m from those chosen before."""
    n = load(spark, sf_dir, "nodes").select("id", "lon", "lat", ((F.col("id") * 7919) % 1009).alias("turn"), (100.0 + (F.col("id") % 3) * 40).alias("spacing_m"))
    return corridor.spaced(n, "turn", "id").select("id")


#: Footprints with four to eight corners on a circle; levels and heights are missing for some.
_CORNERS = """SELECT id AS building_id, k AS seq, lon + (id % 7)*0.0001e0 + radius_m*cos(6.283185307179586e0*k/n)/87000e0 AS lon, lat + (id % 5)*0.0001e0 + radius_m*sin(6.283185307179586e0*k/n)/110540e0 AS lat,
 CASE WHEN id % 11 = 0 THEN NULL ELSE height_m END AS height_m, id % 6 AS levels FROM"""


@query(f"""WITH b AS ({_CORNERS} (SELECT *, 4 + id % 5 AS n, unnest(range(4 + id % 5)) AS k FROM circles) q),
c AS (SELECT building_id, avg(lon) AS lon, avg(lat) AS lat, max(height_m) AS height_m, max(levels) AS levels FROM b GROUP BY building_id),
p AS (SELECT c.*, s.*, cos(radians((lat1+lat2)*0.5e0))*111320e0 AS k FROM c JOIN segments s ON c.lon BETWEEN least(lon1,lon2)-0.001e0 AND greatest(lon1,lon2)+0.001e0 AND c.lat BETWEEN least(lat1,lat2)-0.001e0 AND greatest(lat1,lat2)+0.001e0),
q AS (SELECT *, least(1e0,greatest(0e0,((lon-lon1)*k*(lon2-lon1)*k+(lat-lat1)*110540e0*(lat2-lat1)*110540e0)/(pow((lon2-lon1)*k,2)+pow((lat2-lat1)*110540e0,2)))) AS f FROM p),
d AS (SELECT *, {hav("lon", "lat", "(lon1+f*(lon2-lon1))", "(lat1+f*(lat2-lat1))")} AS d, z1+f*(z2-z1) AS z FROM q),
n AS (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY d, u, v) AS i FROM d WHERE d<=27),
w AS (SELECT b.building_id, max({hav("c.lon", "c.lat", "b.lon", "b.lat")})+3 AS reach_m FROM b JOIN c USING (building_id) GROUP BY b.building_id)
SELECT building_id, {r("d", "dist_m", 3)}, {r("z", "base_m", 3)}, {r("reach_m", "reach_m", 3)}, CASE WHEN height_m>0 THEN height_m ELSE 12e0 END AS height_m, CAST(CASE WHEN levels>0 THEN levels ELSE 4 END AS BIGINT) AS levels FROM n JOIN w USING (building_id) WHERE i=1""", "circles", "segments")
def corridor_buildings(spark, sf_dir):
    """Buildings beside streets, with a buffer of 12 m and the 15 m that buildings may exceed it by."""
    c = load(spark, sf_dir, "circles").withColumn("n", 4 + F.col("id") % 5)
    corners = spark.sql(_CORNERS + " {c}", c=c.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))))
    found = corridor.buildings_beside(corners, _streets(spark, sf_dir), 12.0)
    return found.select("building_id", *[rounded(F.col(x), 3).alias(x) for x in ("dist_m", "base_m", "reach_m")], "height_m", F.col("levels").cast("long").alias("levels"))


def _streets(spark, sf_dir):
    return load(spark, sf_dir, "segments").withColumnsRenamed({"u": "route_id", "v": "seq"})


@query(None)
def corridor_trees(spark, sf_dir):
    """Trees along all streets, clear of the buildings beside them: those of suppliers' places first, then planted rows."""
    c = load(spark, sf_dir, "circles")
    buildings = c.select((F.col("lon") + 0.0003).alias("lon"), (F.col("lat") + 0.0002).alias("lat"), (F.col("radius_m") / 4).alias("reach_m"))
    f = load(spark, sf_dir, "facilities")
    mapped = f.select(F.col("facility_id").alias("tree_id"), F.col("lon") + 0.0001, (F.col("lat") + 0.00005).alias("lat"), F.lit(8.0).alias("height_m"), F.lit(3.0).alias("canopy_m"), F.lit("deciduous").alias("kind")).toDF("tree_id", "lon", "lat", "height_m", "canopy_m", "kind")
    t = corridor.trees_beside(_streets(spark, sf_dir), buildings, mapped)
    return rounded_columns(t.select("stage", "a", "b", "c", "d", "dist_m", "base_m", "height_m", "canopy_m", "trunk_m", "trunk_radius_m", "kind"), 3)


#: Cells of 0.0003 degrees over the whole network, from a corner a little outside it.
_RES, _X0, _Y0 = 0.0003, 27.0991, 38.3991
_GRID = """w AS (SELECT CAST(ceil((max(gx)*0.001e0+0.0018e0)/0.0003e0) AS BIGINT) AS width, CAST(ceil((max(gy)*0.001e0+0.0018e0)/0.0003e0) AS BIGINT) AS height FROM nodes),
t AS (SELECT *, 38.3991e0+height*0.0003e0 AS top FROM w),
c AS (SELECT col, row_, 27.0991e0+(col+0.5e0)*0.0003e0 AS lon, top-(row_+0.5e0)*0.0003e0 AS lat FROM (SELECT *, unnest(range(width)) AS col FROM (SELECT *, unnest(range(height)) AS row_ FROM t) a) b)"""


def _grid(spark, sf_dir) -> dict:
    x, y = load(spark, sf_dir, "nodes").agg(F.ceil((F.max("gx") * 0.001 + 0.0018) / _RES), F.ceil((F.max("gy") * 0.001 + 0.0018) / _RES)).first()
    return {"x0": _X0, "top": _Y0 + y * _RES, "res": _RES, "width": x, "height": y}


_NEAR_CELLS = f"""{_GRID},
p AS (SELECT c.col, c.row_, c.lon, c.lat, s.*, cos(radians(lat)) AS k FROM c JOIN segments s ON lon BETWEEN least(lon1,lon2)-0.0004e0 AND greatest(lon1,lon2)+0.0004e0 AND lat BETWEEN least(lat1,lat2)-0.0004e0 AND greatest(lat1,lat2)+0.0004e0
 WHERE highway NOT IN ('motorway', 'primary')),
q AS (SELECT *, least(1e0,greatest(0e0,((lon-lon1)*k*(lon2-lon1)*k+(lat-lat1)*(lat2-lat1))/(pow((lon2-lon1)*k,2)+pow(lat2-lat1,2)))) AS f FROM p),
near AS (SELECT DISTINCT col, row_ FROM q WHERE {hav("lon", "lat", "(lon1+f*(lon2-lon1))", "(lat1+f*(lat2-lat1))")}<=25)"""


def _lanes(spark, sf_dir):
    """A corridor is asked along all but the largest roads."""
    return _streets(spark, sf_dir).where("highway not in ('motorway', 'primary')")


@query(f"WITH {_NEAR_CELLS} SELECT col, row_ FROM near", "nodes", "segments")
def corridor_grid(spark, sf_dir):
    """Cells within 15 m, and the edge of 10 m, of all smaller streets."""
    return corridor.grid_cells(_lanes(spark, sf_dir), **_grid(spark, sf_dir), buffer_m=15.0).select("col", "row_")


@query(f"WITH {_NEAR_CELLS} SELECT c.col, c.row_, CASE WHEN near.col IS NULL THEN NULL ELSE CAST(c.col*3+c.row_ AS DOUBLE) END AS value FROM c LEFT JOIN near ON near.col=c.col AND near.row_=c.row_", "nodes", "segments")
def corridor_masked_grid(spark, sf_dir):
    """A layer over the whole network whose values stay near smaller streets only."""
    g = _grid(spark, sf_dir)
    cells = spark.range(g["width"] * g["height"]).select((F.col("id") % g["width"]).alias("col"), F.floor(F.col("id") / g["width"]).alias("row_"))
    return corridor.masked_grid(cells.withColumn("value", (F.col("col") * 3 + F.col("row_")).cast("double")), _lanes(spark, sf_dir), **g, buffer_m=15.0)


_CELLS = """SELECT col, row_, 27.10e0+col*0.001e0+(row_%5)*0.0001e0 AS lon, 38.40e0+row_*0.001e0+(col%6)*0.0001e0 AS lat, value FROM"""


@query(f"""WITH c AS ({_CELLS} raster_cells),
q AS (SELECT c.*, (lon1-lon)*cos(radians(lat))*111320e0 AS ax, (lat1-lat)*110540e0 AS ay, (lon2-lon)*cos(radians(lat))*111320e0 AS bx, (lat2-lat)*110540e0 AS by_ FROM c JOIN segments ON lon BETWEEN least(lon1,lon2)-0.001e0 AND greatest(lon1,lon2)+0.001e0 AND lat BETWEEN least(lat1,lat2)-0.001e0 AND greatest(lat1,lat2)+0.001e0),
t AS (SELECT *, least(1e0,greatest(0e0,(-ax*(bx-ax)-ay*(by_-ay))/((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)))) AS t FROM q),
n AS (SELECT DISTINCT col, row_ FROM t WHERE sqrt(pow(ax+t*(bx-ax),2)+pow(ay+t*(by_-ay),2))<=22)
SELECT c.col, c.row_, CASE WHEN n.col IS NULL THEN NULL ELSE value END AS value FROM c LEFT JOIN n ON n.col=c.col AND n.row_=c.row_""", "raster_cells", "segments")
def raster_masked(spark, sf_dir):
    """Raster cells at places of their own, masked to 12 m and the edge of 10 m around streets."""
    c = spark.sql(_CELLS + " {c}", c=load(spark, sf_dir, "raster_cells")).withColumn("layer", F.lit("dem"))
    return spatial.masked_cells(c, _streets(spark, sf_dir), 12.0).select("col", "row_", "value")


def _terrain_files(spark, sf_dir):
    """The nodes' heights as raster files of 64 x 64 cells in the shared folder, a cell a node; rows go up."""
    at = f"{shared_folder(spark)}/terrain-{uuid.uuid4().hex}"
    cells = load(spark, sf_dir, "nodes").select(F.col("gx").alias("col"), F.col("gy").alias("row_"), F.col("z").alias("value"))
    geotiff.write_cells(cells, at, 27.0995, 38.3995, 0.001, 0.001, sheet=64, tile=16)
    return at


@query("SELECT CAST(gx AS BIGINT) AS col, CAST(gy AS BIGINT) AS row_, z AS value FROM nodes", "nodes")
def raster_file_cells(spark, sf_dir):
    """Heights written as raster files and read back."""
    cells = geotiff.read_cells(spark, _terrain_files(spark, sf_dir)).where("value is not null")
    return cells.select(F.rint((F.col("x") - 27.1) / 0.001).cast("long").alias("col"), F.rint((F.col("y") - 38.4) / 0.001).cast("long").alias("row_"), "value")


@query("""SELECT c.id, n.z AS value FROM (SELECT id, lon+(id%9-4)*0.0001e0 AS lon, lat+(id%7-3)*0.0001e0 AS lat FROM circles) c
LEFT JOIN nodes n ON n.gx=CAST(floor((c.lon-27.0995e0)/0.001e0) AS BIGINT) AND n.gy=CAST(floor((c.lat-38.3995e0)/0.001e0) AS BIGINT)""", "circles", "nodes")
def raster_file_samples(spark, sf_dir):
    """Heights at places, from the tiles of raster files that they are in."""
    p = load(spark, sf_dir, "circles").select("id", (F.col("lon") + (F.col("id") % 9 - 4) * 0.0001).alias("x"), (F.col("lat") + (F.col("id") % 7 - 3) * 0.0001).alias("y"))
    return geotiff.sample(p, _terrain_files(spark, sf_dir), "id")


#: One document a part: a street, a building, a tree, a row of trees and a lawn around it, with tags of all sorts.
_URBAN = """SELECT id, lon, lat, radius_m*0.00001e0 AS d, CASE id%4 WHEN 0 THEN 'x' WHEN 1 THEN NULL WHEN 2 THEN concat(CAST(id%9 AS VARCHAR(9)), '.6') ELSE CAST(id%9 AS VARCHAR(9)) END AS levels,
 CASE id%5 WHEN 0 THEN NULL WHEN 1 THEN 'tall' WHEN 2 THEN concat(CAST(id%50 AS VARCHAR(9)), ' m') ELSE concat(CAST(id%50 AS VARCHAR(9)), '.5') END AS height, CASE id%3 WHEN 0 THEN NULL WHEN 1 THEN concat(CAST(id%30 AS VARCHAR(9)), 'm') ELSE 'wide' END AS crown,
 CASE id%7 WHEN 0 THEN 'Stone Pine' WHEN 1 THEN NULL ELSE 'oak' END AS species, CASE id%6 WHEN 0 THEN 'needleleaved' ELSE 'broadleaved' END AS leaf FROM"""


def _urban(spark, sf_dir):
    # Parts are few bytes of files, and so few tasks, but documents take long to write and read.
    parts = load(spark, sf_dir, "circles").repartition(3 * spark.sparkContext.defaultParallelism, "id")
    c = spark.sql(_URBAN + " {c}", c=parts)
    at = lambda x, y: F.struct((F.col("lat") + y * F.col("d")).alias("lat"), (F.col("lon") + x * F.col("d")).alias("lon"))
    ring = F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, -1))
    element = lambda i, kind, tags, **more: F.to_json(F.struct(F.lit(kind).alias("type"), (F.col("id") * 10 + i).alias("id"), F.struct(*[F.lit(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in tags.items()]).alias("tags"), *[v.alias(k) for k, v in more.items()]))
    node = lambda i: F.to_json(F.struct(F.lit("node").alias("type"), (F.col("id") * 10 + i).alias("id"), (F.col("lat") + i * F.col("d")).alias("lat"), F.col("lon")))
    made = [
        node(5), node(6), element(0, "way", {"highway": "residential", "name": "Way", "oneway": F.when(F.col("id") % 2 == 0, "yes").otherwise("-1")}, nodes=F.array(F.col("id") * 10 + 5, F.col("id") * 10 + 9, F.col("id") * 10 + 6)),
        element(1, "way", {"building": "house", "building:levels": F.col("levels"), "height": F.col("height")}, geometry=ring),
        element(2, "node", {"natural": "tree", "species": F.col("species"), "leaf_type": F.col("leaf"), "height": F.col("height"), "diameter_crown": F.col("crown")}, lat=F.col("lat"), lon=F.col("lon") + F.col("d")),
        element(3, "way", {"natural": "tree_row"}, geometry=F.array(at(0, 2), F.struct(F.lit(None).cast("double").alias("lat"), F.lit(1.0).alias("lon")), at(0, 3))),
        element(4, "way", {"landuse": "grass", "natural": "scrub"}, geometry=F.array(at(2, 0), at(3, 0), at(3, 1))),
    ]
    texts = c.select("id", F.concat(F.lit('{"elements":['), F.concat_ws(",", *made), F.lit("]}")).alias("value"))
    return urban.elements(texts, "id")


_METRES = "try_cast(trim(replace({0}, 'm', '')) AS DOUBLE)"
_H, _C = _METRES.format("height"), _METRES.format("crown")


@query(f"""WITH u AS ({_URBAN} circles), f AS (SELECT *, CAST(floor(try_cast(levels AS DOUBLE)) AS BIGINT) AS lv, {_H} AS h, {_C} AS cr FROM u),
b AS (SELECT *, CASE WHEN (levels IS NULL AND h IS NULL) OR (levels IS NOT NULL AND lv IS NULL) THEN 12e0 WHEN levels IS NULL THEN greatest(h,3e0) ELSE greatest(lv,1)*3.2e0 END AS bh, CASE WHEN (levels IS NULL AND h IS NULL) OR (levels IS NOT NULL AND lv IS NULL) THEN 4 WHEN levels IS NULL THEN greatest(CAST(floor(greatest(h,3e0)/3.2e0) AS BIGINT),1) ELSE greatest(lv,1) END AS bl,
 CASE WHEN h IS NULL THEN 8e0 ELSE least(35e0,greatest(3e0,h)) END AS th FROM f),
a AS (SELECT 'road' AS kind, CAST(id*10 AS VARCHAR) AS id, CASE WHEN id%2=0 THEN 'oneway' ELSE 'both' END AS told, k AS seq, lon AS x, lat+(5+k/2)*d AS y, CAST(NULL AS DOUBLE) AS height_m, CAST(NULL AS DOUBLE) AS size FROM b, (SELECT unnest([0,2]) AS k) q
 UNION ALL SELECT 'building', CAST(id*10+1 AS VARCHAR), 'house', k, lon+[-1,1,1,-1][k+1]*d, lat+[-1,-1,1,-1][k+1]*d, bh, CAST(bl AS DOUBLE) FROM b, range(4) r(k)
 UNION ALL SELECT 'tree', CAST(id*10+2 AS VARCHAR), CASE WHEN id%6=0 OR id%7=0 THEN 'conifer' ELSE 'deciduous' END, 0, lon+d, lat, th, CASE WHEN cr IS NULL THEN least(8e0,greatest(1.5e0,th*0.38e0)) ELSE least(10e0,greatest(1.5e0,cr*0.5e0)) END FROM b
 UNION ALL SELECT 'tree', concat(CAST(id*10+3 AS VARCHAR), '_', CAST(k AS VARCHAR)), 'deciduous', 0, lon, lat+(2+k/2)*d, 7.5e0, 2.6e0 FROM b, (SELECT unnest([0,2]) AS k) q
 UNION ALL SELECT 'park', CAST(id*10+4 AS VARCHAR), 'grass', k, lon+[2,3,3][k+1]*d, lat+[0,0,1][k+1]*d, NULL, NULL FROM b, range(3) r(k))
SELECT kind, id, told, CAST(seq AS BIGINT) AS seq, {r("x", "x", 7)}, {r("y", "y", 7)}, {r("height_m", "height_m", 3)}, {r("size", "size", 3)} FROM a""", "circles")
def import_urban(spark, sf_dir):
    """Streets, buildings, trees and lawns around all parts, written as OpenStreetMap-style documents and read back."""
    e = durable(_urban(spark, sf_dir), "elements")
    none, place = F.lit(None).cast("double"), (F.col("lon").alias("x"), F.col("lat").alias("y"))
    parts = [
        urban.roads(e).select(F.lit("road").alias("kind"), F.col("road_id").alias("id"), F.when(F.col("oneway"), "oneway").otherwise("both").alias("told"), "seq", *place, none.alias("height_m"), none.alias("size")),
        urban.buildings(e).select(F.lit("building").alias("kind"), F.col("building_id").alias("id"), F.col("use").alias("told"), "seq", *place, "height_m", F.col("levels").cast("double").alias("size")),
        urban.trees(e).select(F.lit("tree").alias("kind"), F.col("tree_id").alias("id"), F.col("kind").alias("told"), F.lit(0).alias("seq"), *place, "height_m", F.col("canopy_m").alias("size")),
        urban.parks(e).select(F.lit("park").alias("kind"), F.col("park_id").alias("id"), F.col("use").alias("told"), "seq", *place, none.alias("height_m"), none.alias("size")),
    ]
    all_ = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return all_.select("kind", "id", "told", F.col("seq").cast("long").alias("seq"), *[rounded(F.col(c), 7).alias(c) for c in "xy"], *[rounded(F.col(c), 3).alias(c) for c in ("height_m", "size")])


def _krueger(code: str) -> str:
    """(x, y) of rows (id, lon, lat, code) by the same series, told anew for a zone in ``code``."""
    terms = lambda a, b: "+".join(f"{f!r}*{a}({2 * j}e0*xi)*{b}({2 * j}e0*eta)" for j, f in enumerate(P._TO, 1))
    return f"""s AS (SELECT *, radians(lon)-radians(({code}%100)*6e0-183e0) AS lam, sinh(atanh(sin(radians(lat)))-{P._E!r}*atanh({P._E!r}*sin(radians(lat)))) AS t FROM p),
e AS (SELECT *, atan2(t, cos(lam)) AS xi, asinh(sin(lam)/sqrt(t*t+cos(lam)*cos(lam))) AS eta FROM s),
k AS (SELECT *, 500000e0+0.9996e0*{P._A!r}*(eta+{terms("cos", "sinh")}) AS e, CASE WHEN {code}>32700 THEN 10000000e0 ELSE 0e0 END+0.9996e0*{P._A!r}*(xi+{terms("sin", "cosh")}) AS n FROM e)"""


#: Nodes moved over the earth, each in a plane of its own: its zone, web Mercator, or degrees.
_MOVED = """SELECT id, lon+(id%13-6)*11e0 AS lon, CASE WHEN id%2=0 THEN lat ELSE lat-70e0 END AS lat, id%4 AS way FROM"""


@query(f"""WITH m AS ({_MOVED} nodes), p AS (SELECT *, CASE WHEN way=0 THEN 3857 WHEN way=1 THEN 4326 ELSE CAST(floor((lon+180e0)/6e0) AS BIGINT)%60+1+CASE WHEN lat>=0 THEN 32600 ELSE 32700 END END AS code FROM m),
{_krueger("code")} SELECT id, CAST(code AS BIGINT) AS code, {r("CASE WHEN code=3857 THEN 6378137e0*radians(lon) WHEN code=4326 THEN lon ELSE e END", "x", 3)}, {r("CASE WHEN code=3857 THEN 6378137e0*asinh(tan(radians(lat))) WHEN code=4326 THEN lat ELSE n END", "y", 3)},
{r("lon", "back_lon", 7)}, {r("lat", "back_lat", 7)} FROM k""", "nodes")
def projected_nodes(spark, sf_dir):
    """Places all over the earth in planes of their own, and back: the way back is checked against where they were."""
    n = spark.sql(_MOVED + " {n}", n=load(spark, sf_dir, "nodes"))
    n = n.withColumn("code", F.when(F.col("way") == 0, P.WEB).when(F.col("way") == 1, P.DEGREES).otherwise(P.zone_of(F.col("lon"), F.col("lat"))))
    there = P.to_plane(n.select("id", "lon", "lat", "code"), F.col("code"))
    back = P.to_degrees(there, F.col("code"), lon="back_lon", lat="back_lat")
    return back.select("id", F.col("code").cast("long").alias("code"), *[rounded(F.col(c), 3).alias(c) for c in "xy"], *[rounded(F.col(c), 7).alias(c) for c in ("back_lon", "back_lat")])


@query(f"""SELECT u, v, CASE WHEN is_oneway AND (u+v)%2=0 THEN {r("lon2", "lon1", 7).rpartition(" AS ")[0]} ELSE {r("lon1", "lon1", 7).rpartition(" AS ")[0]} END AS lon1, CASE WHEN is_oneway AND (u+v)%2=0 THEN {r("lat1", "lat2", 7).rpartition(" AS ")[0]} ELSE {r("lat2", "lat2", 7).rpartition(" AS ")[0]} END AS lat2,
 CASE WHEN is_oneway AND (u+v)%2=0 THEN z2 ELSE z1 END AS z1, highway, surface, is_oneway FROM segments""", "segments")
def import_table(spark, sf_dir):
    """Segments as lines of text in the metres of their zone, a table with columns of its own names, read back as a network."""
    s = load(spark, sf_dir, "segments")
    a = P.to_plane(s, 32635, "lon1", "lat1", "x1", "y1")
    b = P.to_plane(a, 32635, "lon2", "lat2", "x2", "y2")
    number = lambda c: F.col(c).cast("string")
    line = F.concat(F.lit("LINESTRING Z ("), F.concat_ws(", ", F.concat_ws(" ", *map(number, ("x1", "y1", "z1"))), F.concat_ws(" ", *map(number, ("x2", "y2", "z2")))), F.lit(")"))
    against = F.when(F.col("is_oneway") & ((F.col("u") + F.col("v")) % 2 == 0), "reverse").when(F.col("is_oneway"), "true").otherwise("no")
    t = b.select(F.struct("u", "v").alias("k"), line.alias("shape"), F.col("highway").alias("class"), "surface", against.alias("direction"))
    got = networks.table_segments(t, "k", "shape", 32635, highway="class", oneway="direction")
    return got.select("seq.doc.u", "seq.doc.v", rounded(F.col("lon1"), 7).alias("lon1"), rounded(F.col("lat2"), 7).alias("lat2"), "z1", "highway", "surface", "is_oneway")


#: Three layers of heights with steps of their own: fine with holes, coarse over a part, and coarsest over all.
_LAYERS = {
    "l0": ("SELECT gx AS col, 40-gy AS row_, CASE WHEN (gx+gy)%5=1 THEN CAST('NaN' AS DOUBLE) ELSE z END AS value FROM nodes WHERE (gx+2*gy)%3<>0", 27.0995, 38.4405, 0.001, 0.001),
    "l1": ("SELECT CAST(floor(gx/3e0) AS BIGINT) AS col, CAST(floor((60-gy)/2e0) AS BIGINT) AS row_, 100e0+avg(z) AS value FROM nodes WHERE gx%12<8 GROUP BY CAST(floor(gx/3e0) AS BIGINT), CAST(floor((60-gy)/2e0) AS BIGINT)", 27.0995, 38.4605, 0.003, 0.002),
    "l2": ("SELECT CAST(floor(gx/10e0) AS BIGINT) AS col, CAST(floor((90-gy)/10e0) AS BIGINT) AS row_, 200e0+min(z) AS value FROM nodes GROUP BY CAST(floor(gx/10e0) AS BIGINT), CAST(floor((90-gy)/10e0) AS BIGINT)", 27.0995, 38.4905, 0.01, 0.01),
}


def _layers(spark, sf_dir):
    n = load(spark, sf_dir, "nodes")
    return [surface.Layer(durable(spark.sql(sql.replace("FROM nodes", "FROM {n}"), n=n), "cells"), *geo_) for sql, *geo_ in _LAYERS.values()]


def _layer_join(points: str, lon: str, lat: str) -> str:
    joins = "".join(f" LEFT JOIN {k} ON {k}.col=CAST(floor(({lon}-{x0!r})/{dx!r}) AS BIGINT) AND {k}.row_=CAST(floor(({top!r}-{lat})/{dy!r}) AS BIGINT) AND NOT isnan({k}.value)" for k, (_, x0, top, dx, dy) in _LAYERS.items())
    return f"{points}{joins}"


_LAYER_CTES = ", ".join(f"{k} AS ({sql})" for k, (sql, *_) in _LAYERS.items())


@query(f"""WITH {_LAYER_CTES}, c AS (SELECT id, lon+(id%11-5)*0.0007e0+0.00013e0 AS lon, lat+(id%13-6)*0.0009e0+0.00017e0 AS lat FROM circles)
SELECT id, coalesce(l0.value,l1.value,l2.value) AS value, CASE WHEN l0.value IS NOT NULL THEN 0 WHEN l1.value IS NOT NULL THEN 1 WHEN l2.value IS NOT NULL THEN 2 END AS layer FROM {_layer_join("c", "c.lon", "c.lat")}""", "circles", "nodes")
def surface_layers(spark, sf_dir):
    """Heights at places, from the first of three layers that has one."""
    p = load(spark, sf_dir, "circles").select("id", (F.col("lon") + (F.col("id") % 11 - 5) * 0.0007 + 0.00013).alias("lon"), (F.col("lat") + (F.col("id") % 13 - 6) * 0.0009 + 0.00017).alias("lat"))
    return surface.first_of(p, _layers(spark, sf_dir), "id")


_ENDS = """SELECT u, v, lon1+0.00013e0 AS lon1, lat1+0.00017e0 AS lat1, CASE WHEN (u+v)%3=0 THEN z1 END AS z1, CASE WHEN v%17=0 THEN lon1 ELSE lon2 END+0.00013e0 AS lon2, CASE WHEN v%17=0 THEN lat1 ELSE lat2 END+0.00017e0 AS lat2, CASE WHEN v%4=0 THEN z2 END AS z2 FROM"""


@query(f"""WITH {_LAYER_CTES}, s AS ({_ENDS} segments), a AS (SELECT s.*, coalesce(z1,l0.value,l1.value,l2.value) AS h1 FROM {_layer_join("s", "s.lon1", "s.lat1")}),
b AS (SELECT a.*, coalesce(z2,l0.value,l1.value,l2.value) AS h2, {hav("lon1", "lat1", "lon2", "lat2")} AS m FROM {_layer_join("a", "a.lon2", "a.lat2")}),
c AS (SELECT u, v, m<0.1e0 AS short, h1 IS NULL OR h2 IS NULL AS unknown, (h2-h1)/m*100 AS sl, degrees(atan2((lon2-lon1)*cos(radians((lat1+lat2)*0.5e0)),lat2-lat1)) AS az FROM b),
d AS (SELECT u, v, short, unknown, CASE WHEN short OR unknown THEN 0e0 ELSE sl END AS sl, CASE WHEN short OR unknown THEN 0e0 WHEN az<0 THEN az+360 ELSE az END AS az FROM c)
SELECT u, v, {r("sl", "slope_pct", 3)}, {r("az", "aspect_deg", 3)}, {r("CASE WHEN short THEN 0.5e0 WHEN unknown THEN 1e0 ELSE least(1e0,greatest(0e0,sin(radians(55e0))*cos(atan(abs(sl)/100))+cos(radians(55e0))*sin(atan(abs(sl)/100))*cos(radians(180e0-az)))) END", "light", 4)} FROM d""", "segments", "nodes")
def segment_slopes(spark, sf_dir):
    """Slope, direction and light of all segments, whose heights are partly their own, partly from layers."""
    s = spark.sql(_ENDS + " {s}", s=load(spark, sf_dir, "segments"))
    found = surface.slopes(s, _layers(spark, sf_dir), "u", "v")
    return found.select("u", "v", rounded(F.col("slope_pct"), 3).alias("slope_pct"), rounded(F.col("aspect_deg"), 3).alias("aspect_deg"), rounded(F.col("light"), 4).alias("light"))


_KEYS_SQL = """k AS (SELECT *, CASE WHEN abs(x)<=1 THEN 1.5e0*pow(abs(x),3)-2.5e0*x*x+1 WHEN abs(x)<2 THEN -0.5e0*pow(abs(x),3)+2.5e0*x*x-4*abs(x)+2 ELSE 0e0 END AS wx,
 CASE WHEN abs(y)<=1 THEN 1.5e0*pow(abs(y),3)-2.5e0*y*y+1 WHEN abs(y)<2 THEN -0.5e0*pow(abs(y),3)+2.5e0*y*y-4*abs(y)+2 ELSE 0e0 END AS wy,
 CASE WHEN x>=0 THEN 1 ELSE -1 END*CASE WHEN abs(x)<=1 THEN 4.5e0*x*x-5*abs(x) WHEN abs(x)<2 THEN -1.5e0*x*x+5*abs(x)-4 ELSE 0e0 END AS dx,
 CASE WHEN y>=0 THEN 1 ELSE -1 END*CASE WHEN abs(y)<=1 THEN 4.5e0*y*y-5*abs(y) WHEN abs(y)<2 THEN -1.5e0*y*y+5*abs(y)-4 ELSE 0e0 END AS dy FROM q)"""


@query(f"""WITH w AS (SELECT max(gx)+1 AS width, max(gy)+1 AS height FROM nodes), g AS (SELECT gx AS col, (SELECT height FROM w)-1-gy AS row_, z FROM nodes),
l AS (SELECT route_id, seq, lon, lat, lead(lon) OVER o AS lon2, lead(lat) OVER o AS lat2 FROM routes WINDOW o AS (PARTITION BY route_id ORDER BY seq)),
m AS (SELECT *, CASE WHEN lon2 IS NULL THEN 1 ELSE greatest(1,CAST(ceil({hav("lon", "lat", "lon2", "lat2")}/25e0) AS BIGINT)) END AS steps FROM l WHERE route_id IN (SELECT route_id FROM routes GROUP BY route_id HAVING count(*)>1)),
p AS (SELECT route_id, seq AS seg, k AS step, CASE WHEN lon2 IS NULL THEN lon ELSE lon+(lon2-lon)*(k/CAST(steps AS DOUBLE)) END AS lon, CASE WHEN lat2 IS NULL THEN lat ELSE lat+(lat2-lat)*(k/CAST(steps AS DOUBLE)) END AS lat FROM (SELECT *, unnest(range(steps)) AS k FROM m) a),
i AS (SELECT *, (lon-27.0995e0)/0.001e0-0.5e0 AS gx, (38.3995e0+height*0.001e0-lat)/0.001e0-0.5e0 AS gy, lon>=27.0995e0 AND lon<=27.0995e0+width*0.001e0 AND lat>=38.3995e0 AND lat<=38.3995e0+height*0.001e0 AS ok FROM p, w),
e AS (SELECT *, floor(gx) AS c0, floor(gy) AS r0, gx-floor(gx) AS uu, gy-floor(gy) AS vv, di, dj FROM i, (SELECT unnest([-1,0,1,2]) AS di) a, (SELECT unnest([-1,0,1,2]) AS dj) b WHERE ok),
q AS (SELECT e.*, coalesce(g.z,0e0) AS zz, uu-di AS x, vv-dj AS y FROM e LEFT JOIN g ON g.col=c0+di AND g.row_=r0+dj), {_KEYS_SQL},
s AS (SELECT route_id, seg, step, max(lat) AS lat, sum(zz*wx*wy) AS el, sum(zz*dx*wy) AS du, sum(zz*wx*dy) AS dv FROM k GROUP BY route_id, seg, step),
t AS (SELECT i.route_id, i.seg, i.step, coalesce(el,0e0) AS el, coalesce(du/(0.001e0*111320e0*cos(radians(i.lat))),0e0) AS zx, coalesce(dv/(0.001e0*111320e0),0e0) AS zy FROM i LEFT JOIN s USING (route_id, seg, step))
SELECT route_id, seg, CAST(step AS BIGINT) AS step, {r("el", "elevation_m", 3)}, {r("sqrt(zx*zx+zy*zy)*100", "slope_pct", 3)} FROM t""", "routes", "nodes")
def smooth_profiles(spark, sf_dir):
    """All routes in steps of 25 m on the smooth surface through the nodes' heights."""
    width, height = load(spark, sf_dir, "nodes").agg(F.max("gx") + 1, F.max("gy") + 1).first()
    cells = load(spark, sf_dir, "nodes").select(F.col("gx").alias("col"), (height - 1 - F.col("gy")).alias("row_"), F.col("z").alias("value"))
    layer = surface.Layer(cells, 27.0995, 38.3995 + height * 0.001, 0.001, 0.001)
    p = surface.smooth_profile(load(spark, sf_dir, "routes"), layer, width, height, 25.0)
    return p.select("route_id", "seg", F.col("step").cast("long").alias("step"), rounded(F.col("elevation_m"), 3).alias("elevation_m"), rounded(F.col("slope_pct"), 3).alias("slope_pct"))


@query(f"""SELECT id, CASE WHEN id%2=0 THEN z ELSE {r("lon*10+lat", "v").rpartition(" AS ")[0]} END AS value FROM nodes""", "nodes")
def stored_heights(spark, sf_dir):
    """Heights of all nodes: every other one is known beforehand, the rest are asked for, of a service that tells a sum of coordinates, and kept."""
    n = load(spark, sf_dir, "nodes")
    at = f"{shared_folder(spark)}/heights-{uuid.uuid4().hex}"
    elevation_store.seed(n.where("id % 2 = 0").select("lon", "lat", F.col("z").alias("value")), at)
    elevation_store.prefetch(n, at, lambda places: [x * 10 + y for x, y in places])
    return elevation_store.heights(n, at, "id").select("id", rounded(F.col("value"), 4).alias("value"))


@query(f"""WITH l AS (SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0, lag(z) OVER w AS z0, count(*) OVER (PARTITION BY route_id) AS n FROM routes WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
m AS (SELECT *, coalesce({hav("lon0", "lat0", "lon", "lat")},0e0) AS m FROM l WHERE n>1), s AS (SELECT *, CASE WHEN m>0 THEN (z-z0)/m*100 ELSE 0e0 END AS sl FROM m),
c AS (SELECT *, greatest(-0.5e0,least(0.5e0,sl/100)) AS g FROM s), e AS (SELECT *, greatest(0.6e0,280.5e0*pow(g,5)-58.7e0*pow(g,4)-76.8e0*pow(g,3)+51.9e0*g*g+19.6e0*g+2.5e0)*70e0*m/4184e0 AS kcal FROM c)
SELECT route_id, seq, {r("sum(m) OVER u/1000", "distance_km")}, {r("z", "elevation_m")}, {r("sl", "slope_pct", 3)}, {r("sum(kcal) OVER u", "calories_kcal", 3)} FROM e WINDOW u AS (PARTITION BY route_id ORDER BY seq ROWS UNBOUNDED PRECEDING)""", "routes")
def elevation_profiles(spark, sf_dir):
    """What the elevation profiles of all routes on foot are drawn from."""
    p = elevation_profile(load(spark, sf_dir, "routes"))
    return p.select("route_id", "seq", rounded(F.col("distance_km"), 4).alias("distance_km"), rounded(F.col("elevation_m"), 4).alias("elevation_m"), rounded(F.col("slope_pct"), 3).alias("slope_pct"), rounded(F.col("calories_kcal"), 3).alias("calories_kcal"))


@query("""SELECT route_id, concat('<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="orograph" xmlns="http://www.topografix.com/GPX/1/1"><metadata><name>', route_id, '</name></metadata><trk><trkseg>',
 string_agg(printf('<trkpt lat="%.6f" lon="%.6f"><ele>%.2f</ele><extensions><residual_m>%.2f</residual_m><slope_pct>%.1f</slope_pct></extensions></trkpt>', lat, lon, z, coalesce(CASE WHEN seq%3<>0 THEN seq*0.25e0 END,0e0), seq*0.5e0), '' ORDER BY seq), '</trkseg></trk></gpx>') AS value FROM routes GROUP BY route_id""", "routes")
def export_matched_gpx(spark, sf_dir):
    """All routes as GPX whose points carry how far off they were, unknown for every third, and the slope."""
    p = load(spark, sf_dir, "routes").withColumns({"residual_m": F.when(F.col("seq") % 3 != 0, F.col("seq") * 0.25), "slope_pct": F.col("seq") * 0.5})
    return exports.gpx_matched(p, "route_id")
