"""Networks, tracks and timetables from the text of GeoJSON, OpenStreetMap-style JSON, GPX and timetable files.

Readers take a DataFrame with one document a row (column ``value``; spark.read.text with wholetext gives it), so that any store that
Spark reads will do. Segments are (seq, lon1, lat1, z1, lon2, lat2, z2, highway, surface, lanes, is_oneway), as operators.graph.build wants them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, projection
from ..functions.numbers import finite_or
from ..functions.projection import DEGREES

_TAGS = "highway string, surface string, lanes string, oneway string, junction string"
_POINTS = "array<array<string>>"
#: Coordinates stay text until the geometry's type is known.
_GEOMETRY = "struct<type:string, coordinates:string, geometries:array<struct<type:string, coordinates:string>>>"


def documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


#: What a table of segments has at least.
SEGMENT = ["lon1", "lat1", "lon2", "lat2"]


def network(spark: SparkSession, source: str | DataFrame, key: str = "id", **columns: object) -> DataFrame:
    """Segments from whatever a network is given as: a table of segments as it is, a table of lines (``key``, geometry, ...; more is as in ``table_segments``), or the path of .geojson or .json files of features or elements.

    A path that isn't there, another kind of file and a table with neither are errors, as an empty network would only fail later.
    """
    if isinstance(source, DataFrame):
        if set(SEGMENT) <= set(source.columns):
            return source
        if str(columns.get("geometry", "geometry")) in source.columns:
            return table_segments(source, key, **columns)
        raise ValueError(f"a table of a network has {', '.join(SEGMENT)}, or a geometry; this one has {', '.join(source.columns)}")
    ending = source.rstrip("/").rpartition(".")[2].lower() if "." in source.rpartition("/")[2] else ""
    if ending not in ("json", "geojson"):
        raise ValueError(f"{source}: networks are read from .geojson and .json files")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(source)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at):
        raise FileNotFoundError(f"no network at {source}")
    texts = documents(spark, source).withColumn("name", F.col("_metadata.file_path"))
    elements = F.get_json_object("value", "$.elements").isNotNull()
    return geojson_segments(texts.where(~elements)).withColumn("seq", F.to_json("seq")).unionByName(osm_segments(texts.where(elements)).withColumn("seq", F.to_json("seq")))


def _features(value: Column) -> Column:
    """Features of a document: those of a collection, of a list, the document itself, or one around a bare geometry."""
    own = f"struct<type:string, geometry:{_GEOMETRY}, properties:string>"
    many = F.from_json(F.get_json_object(value, "$.features"), f"array<{own}>")
    listed = F.from_json(F.when(F.ltrim(value).startswith("["), value), f"array<{own}>")
    one = F.array(F.from_json(value, own))
    bare = F.array(F.struct(F.lit("Feature").alias("type"), F.from_json(value, _GEOMETRY).alias("geometry"), F.lit(None).cast("string").alias("properties")))
    kind = F.get_json_object(value, "$.type")
    return F.when(kind == "FeatureCollection", many).when(kind == "Feature", one).when(kind.isNotNull(), bare).otherwise(listed)


def _rules(df: DataFrame) -> DataFrame:
    """Attributes from tags; ``swap`` where a line is one-way against its direction."""
    one = F.lower(F.coalesce("oneway", F.lit("")))
    back = one.isin("-1", "reverse")
    lanes = F.greatest(F.coalesce(F.expr("try_cast(lanes AS BIGINT)"), F.lit(1)), F.lit(1).cast("long"))
    return df.select(
        "*", F.coalesce("highway", F.lit("residential")).alias("_highway"), F.coalesce("surface", F.lit("asphalt")).alias("_surface"), lanes.alias("_lanes"),
        (one.isin("yes", "1", "true") | back | (F.coalesce("junction", F.lit("")) == "roundabout")).alias("is_oneway"), back.alias("swap"),
    )


def _segments(points: DataFrame, line: list[str], order: str, least_m: float = 0.1) -> DataFrame:
    """Consecutive points of each line as segments of ``least_m`` or more. Points have lon, lat, z and the line's rules."""
    w = Window.partitionBy(*line).orderBy(order)
    s = points.select("*", *[F.lead(c).over(w).alias(f"_{c}") for c in ("lon", "lat", "z")]).where("_lon is not null")
    s = s.where(geo.haversine(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat")) >= least_m)
    pick = lambda a, b, name: F.when(F.col("swap"), F.col(b)).otherwise(F.col(a)).alias(name)
    seq = F.struct(*line, F.col(order).alias("pos")).alias("seq")
    return s.select(
        seq, pick("lon", "_lon", "lon1"), pick("lat", "_lat", "lat1"), pick("z", "_z", "z1"), pick("_lon", "lon", "lon2"), pick("_lat", "lat", "lat2"), pick("_z", "z", "z2"),
        F.col("_highway").alias("highway"), F.col("_surface").alias("surface"), F.col("_lanes").alias("lanes"), "is_oneway",
    )


def geojson_segments(texts: DataFrame, name: str = "name") -> DataFrame:
    """Segments of the lines in GeoJSON documents (``name``, value): features, collections, lists, bare geometries and geometry collections.

    Positions that aren't finite are dropped; a missing height is 0. Documents that are no JSON, and null ones, give nothing.
    """
    f = texts.select(F.col(name).alias("doc"), F.posexplode(_features(F.col("value"))).alias("feature", "f"))
    single = F.array(F.struct(F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates")))
    geometries = F.when(F.col("f.geometry.type") == "GeometryCollection", F.col("f.geometry.geometries")).otherwise(single)
    g = f.select("doc", "feature", F.from_json("f.properties", _TAGS).alias("p"), F.posexplode(geometries).alias("geometry", "g"))
    one = F.array(F.from_json("g.coordinates", _POINTS))
    lines = F.when(F.col("g.type") == "LineString", one).when(F.col("g.type") == "MultiLineString", F.from_json("g.coordinates", f"array<{_POINTS}>"))
    lined = _rules(g.select("doc", "feature", "geometry", "p.*", F.posexplode(lines).alias("line", "points")))
    number = lambda i: F.expr(f"try_cast(try_element_at(c, {i}) AS DOUBLE)")
    p = lined.select("*", F.posexplode("points").alias("pos", "c")).select(
        "*", finite_or(number(1), None).alias("lon"), finite_or(number(2), None).alias("lat"), finite_or(number(3), 0.0).alias("z")
    )
    return _segments(p.where("lon is not null and lat is not null"), ["doc", "feature", "geometry", "line"], "pos")


def osm_segments(texts: DataFrame, name: str = "name") -> DataFrame:
    """Segments of the highways in OpenStreetMap-style JSON (``elements`` of nodes and ways), heights 0. Ways' unknown nodes are passed over."""
    element = f"struct<type:string, id:bigint, lon:double, lat:double, nodes:array<bigint>, tags:struct<{', '.join(x.replace(' ', ':') for x in _TAGS.split(', '))}>>"
    e = texts.select(F.col(name).alias("doc"), F.explode(F.from_json(F.get_json_object("value", "$.elements"), f"array<{element}>")).alias("e")).select("doc", "e.*")
    nodes = e.where("type = 'node'").groupBy("doc", "id").agg(F.first("lon", True).alias("lon"), F.first("lat", True).alias("lat"))
    ways = _rules(e.where("type = 'way' and tags.highway is not null").select("doc", F.col("id").alias("way"), "tags.*", "nodes"))
    p = ways.select("*", F.posexplode("nodes").alias("pos", "id")).drop("nodes").join(nodes, ["doc", "id"]).withColumn("z", F.lit(0.0))
    return _segments(p, ["doc", "way"], "pos")


def table_segments(table: DataFrame, key: str, geometry: str = "geometry", epsg: int | Column = DEGREES, highway: str | None = "highway", surface: str | None = "surface", oneway: str | None = "oneway") -> DataFrame:
    """Segments of a table's lines: ``geometry`` is their text (LINESTRING or MULTILINESTRING, with or without heights), in degrees or in the plane that ``epsg`` names, by a column too.

    The columns of the road's kind, surface and direction are named; what the table doesn't have, and nulls, are residential, asphalt and both ways. A line against its direction (-1, reverse) is turned round. Other
    geometries, empty ones, points that aren't numbers or that the plane doesn't hold give nothing; a height that is no number is 0. ``key`` tells rows apart.
    """
    named = {c.lower(): c for c in table.columns}
    value = lambda c, usual: F.coalesce(table[named[c.lower()]].cast("string"), F.lit(usual)) if c and c.lower() in named else F.lit(usual)
    one = F.lower(F.trim(value(oneway, "no")))
    text = F.upper(F.trim(table[geometry].cast("string")))
    lines = F.when(text.rlike(r"^(MULTI)?LINESTRING\b"), F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1)))
    code = epsg if isinstance(epsg, Column) else F.lit(epsg)
    lined = table.select(
        table[key].alias("doc"), code.alias("_epsg"), value(highway, "residential").alias("_highway"), value(surface, "asphalt").alias("_surface"), F.lit(1).cast("long").alias("_lanes"),
        one.isin("yes", "true", "1", "-1", "reverse").alias("is_oneway"), one.isin("-1", "reverse").alias("swap"), F.posexplode(lines).alias("line", "_text"),
    )
    p = lined.withColumn("_points", F.split("_text", r"\s*,\s*")).drop("_text").select("*", F.posexplode("_points").alias("pos", "_p")).drop("_points")
    p = p.withColumn("_c", F.split(F.trim("_p"), r"\s+"))
    number = lambda i, usual: finite_or(F.try_element_at("_c", F.lit(i)).try_cast("double"), usual)
    p = p.withColumns({"x": number(1, None), "y": number(2, None), "z": F.coalesce(number(3, 0.0), F.lit(0.0))}).drop("_p", "_c")
    # A filter would be moved below the projection and work it out twice; points without a place have an empty list to be made rows of instead.
    p = projection.to_degrees(p, F.col("_epsg")).withColumn("_live", F.explode(F.when(F.col("lon").isNotNull(), F.array(F.lit(True)))))
    return _segments(p, ["doc", "line"], "pos", 0.0)


def gpx_points(texts: DataFrame, name: str = "name") -> DataFrame:
    """(``name``, seq, lon, lat, z) of the track points in GPX texts, attributes in any order. Bad heights are 0, points with a bad place are dropped."""
    found = F.regexp_extract_all("value", F.lit(r"(?s)<trkpt\b[^>]*?/>|<trkpt\b.*?</trkpt>"), F.lit(0))
    p = texts.select(F.col(name), F.posexplode(found).alias("seq", "t"))
    number = lambda pattern: finite_or(F.regexp_extract("t", pattern, 1).try_cast("double"), None)
    p = p.select(name, "seq", number(r"""\blon\s*=\s*["']([^"']*)""").alias("lon"), number(r"""\blat\s*=\s*["']([^"']*)""").alias("lat"), F.coalesce(number(r"<ele>\s*([^<]*?)\s*</ele>"), F.lit(0.0)).alias("z"))
    return p.where("abs(lon) <= 180 and abs(lat) <= 90")


def timetable(stop_times: DataFrame) -> DataFrame:
    """(trip_id, stop_id, stop_sequence, arrival_s, departure_s) of a feed's stop_times rows, whose times are HH:MM:SS and may pass 24 hours."""

    def seconds(c: str) -> Column:
        part = lambda i: F.split_part(F.trim(F.col(c)), F.lit(":"), F.lit(i)).try_cast("long")
        return part(1) * 3600 + part(2) * 60 + part(3)

    return stop_times.select(
        "trip_id", "stop_id", F.col("stop_sequence").cast("long").alias("stop_sequence"), F.coalesce(seconds("arrival_time"), seconds("departure_time")).alias("arrival_s"),
        F.coalesce(seconds("departure_time"), seconds("arrival_time")).alias("departure_s"),
    )


def tile_id(lon: Column, lat: Column) -> Column:
    """The name of the one-degree elevation tile of a place, as N38_00_E027_00."""
    x, y = F.floor(lon).cast("int"), F.floor(lat).cast("int")
    return F.format_string("%s%02d_00_%s%03d_00", F.when(y >= 0, "N").otherwise("S"), F.abs(y), F.when(x >= 0, "E").otherwise("W"), F.abs(x))


def tiles(boxes: DataFrame) -> DataFrame:
    """Each row of boxes (lon1, lat1, lon2, lat2, ...) once for each tile it touches: tile. Reversed and too wide boxes are put right."""
    def span(a: str, b: str, edge: float) -> Column:
        low = F.greatest(F.least(a, b), F.lit(-edge))
        high = F.least(F.greatest(a, b), F.lit(edge))
        return F.sequence(F.floor(low).cast("int"), F.floor(F.least(high, F.lit(edge - 1e-6))).cast("int"))

    t = boxes.withColumn("_x", F.explode(span("lon1", "lon2", 180.0))).withColumn("_y", F.explode(span("lat1", "lat2", 90.0)))
    return t.withColumn("tile", tile_id(F.col("_x") + F.lit(0.1), F.col("_y") + F.lit(0.1))).drop("_x", "_y")
