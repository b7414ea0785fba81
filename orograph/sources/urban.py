"""Roads, buildings, trees and parks from OpenStreetMap-style JSON: typed features from tags, and their outlines as rows of corners.

Readers take a DataFrame with one document a row (column ``value``). A way's places are its ``geometry`` where it has one, else the document's nodes by the way's node list. Each element is one
feature, of the first kind that its tags say: a road, a building, a tree, a row of trees, a park. Outlines of any length are rows, one a corner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, finite_or

#: A storey's height, and what is taken where tags say nothing.
STOREY_M, USUAL_HEIGHT_M, USUAL_LEVELS, LEAST_HEIGHT_M = 3.2, 12.0, 4, 3.0
TREE_HEIGHT_M, ROW_HEIGHT_M, ROW_CROWN_M = 8.0, 7.5, 2.6
GREEN = ("wood", "scrub", "heath")

_PLACE = "struct<lat:string, lon:string>"
_ELEMENT = f"struct<type:string, id:string, lat:string, lon:string, nodes:array<string>, geometry:array<{_PLACE}>, tags:map<string,string>>"


def _number(c: Column) -> Column:
    """A finite number, or null."""
    return finite_or(c.try_cast("double"), None)


def _metres(c: Column) -> Column:
    return _number(F.trim(F.replace(c, F.lit("m"), F.lit(""))))


def elements(texts: DataFrame, name: str = "name") -> DataFrame:
    """(doc, at, type, id, lat, lon, nodes, geometry, tags, kind) of every element; at is its place in the document, kind null for what is no feature. Documents that are no JSON give nothing."""
    e = texts.select(F.col(name).alias("doc"), F.posexplode(F.from_json(F.get_json_object("value", "$.elements"), f"array<{_ELEMENT}>")).alias("at", "e")).select("doc", "at", "e.*")
    tag = lambda t: F.col("tags")[t]
    way = F.col("type") == "way"
    park = tag("leisure").isNotNull() | tag("landuse").isNotNull() | F.coalesce(tag("natural").isin(*GREEN), F.lit(False))
    kind = F.when(tag("highway").isNotNull() & way, "road").when(tag("building").isNotNull(), "building").when((tag("natural") == "tree") & (F.col("type") == "node"), "tree")
    return e.withColumn("kind", kind.when((tag("natural") == "tree_row") & way, "row").when(park & way, "park"))


def _nodes(found: DataFrame) -> DataFrame:
    """(doc, id, lon, lat) of each document's nodes."""
    return found.where("type = 'node'").groupBy("doc", "id").agg(F.first(_number(F.col("lon")), True).alias("lon"), F.first(_number(F.col("lat")), True).alias("lat"))


def corners(found: DataFrame) -> DataFrame:
    """(doc, at, kind, seq, lon, lat) of the features' places, in order: those that aren't two finite numbers are left out, and so are nodes that the document doesn't have."""
    own = found.where("kind is not null and kind <> 'tree'")
    given = own.where("geometry is not null").select("doc", "at", "kind", F.posexplode("geometry").alias("seq", "p")).select("doc", "at", "kind", "seq", _number(F.col("p.lon")).alias("lon"), _number(F.col("p.lat")).alias("lat"))
    named = own.where("geometry is null").select("doc", "at", "kind", F.posexplode("nodes").alias("seq", "id")).join(_nodes(found), ["doc", "id"]).select("doc", "at", "kind", "seq", "lon", "lat")
    return given.unionByName(named).where("lon is not null and lat is not null")


def outlines(found: DataFrame) -> DataFrame:
    """(doc, at, kind, corners, missing, closed): how many corners a feature has, how many of its places are unknown or no numbers, and if the last is the first."""
    c = corners(found).groupBy("doc", "at").agg(F.count(F.lit(1)).alias("corners"), F.min(F.struct("seq", "lon", "lat")).alias("a"), F.max(F.struct("seq", "lon", "lat")).alias("z"))
    whole = found.where("kind is not null and kind <> 'tree'").select("doc", "at", "kind", F.coalesce(F.size(F.coalesce("geometry", F.transform("nodes", lambda n: F.lit(None).cast(_PLACE)))), F.lit(0)).alias("places"))
    j = whole.join(c, ["doc", "at"], "left").withColumn("corners", F.coalesce("corners", F.lit(0).cast("long")))
    same = (F.col("a.lon") == F.col("z.lon")) & (F.col("a.lat") == F.col("z.lat")) & (F.col("corners") > 1)
    return j.select("doc", "at", "kind", "corners", (F.greatest(F.col("places"), F.lit(0)) - F.col("corners")).alias("missing"), F.coalesce(same, F.lit(False)).alias("closed"))


def _with_corners(found: DataFrame, kind: str, least: int, *columns: Column) -> DataFrame:
    """Corners of the features of a kind that have enough of them, with the columns. A feature with places of its own meets no other row; one with a node list meets its nodes."""
    own = found.where((F.col("kind") == kind) & F.col("doc").isNotNull())
    names = found.select("doc", *columns).columns
    numbered = F.transform("geometry", lambda p, i: F.struct(i.alias("seq"), _number(p["lon"]).alias("lon"), _number(p["lat"]).alias("lat")))
    given = own.where("geometry is not null").select("doc", *columns, F.filter(numbered, lambda p: p["lon"].isNotNull() & p["lat"].isNotNull()).alias("_c"))
    given = given.select(*names, F.inline(F.when(F.size("_c") >= least, F.col("_c"))))
    w = Window.partitionBy("doc", "at")
    named = own.where("geometry is null").select("doc", "at", *columns, F.posexplode("nodes").alias("seq", "_node"))
    named = named.join(_nodes(found).withColumnRenamed("id", "_node"), ["doc", "_node"]).where("lon is not null and lat is not null")
    named = named.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= least)
    return given.unionByName(named.select(*names, "seq", "lon", "lat"))


def roads(found: DataFrame) -> DataFrame:
    """(doc, road_id, highway, road, oneway, seq, lon, lat) of roads with two places."""
    t = F.col("tags")
    return _with_corners(found, "road", 2, F.col("id").alias("road_id"), t["highway"].alias("highway"), F.coalesce(t["name"], F.lit("")).alias("road"), F.coalesce(t["oneway"].isin("yes", "1", "true"), F.lit(False)).alias("oneway"))


def buildings(found: DataFrame) -> DataFrame:
    """(doc, building_id, use, height_m, levels, seq, lon, lat) of buildings with three corners, as ``corridor.buildings_beside`` takes them.

    Levels give the height, or else the height the levels; what is no number counts as not said.
    """
    t = F.col("tags")
    told = F.floor(_number(t["building:levels"]))
    levels = F.greatest(told, F.lit(1).cast("long"))
    height = F.greatest(_metres(t["height"]), F.lit(LEAST_HEIGHT_M))
    by_levels = t["building:levels"].isNotNull()
    h = F.when(by_levels, F.when(told.isNotNull(), levels * STOREY_M)).otherwise(F.when(_metres(t["height"]).isNotNull(), height))
    n = F.when(by_levels, F.when(told.isNotNull(), levels)).otherwise(F.when(_metres(t["height"]).isNotNull(), F.greatest(F.floor(height / STOREY_M), F.lit(1).cast("long"))))
    return _with_corners(found, "building", 3, F.col("id").alias("building_id"), t["building"].alias("use"), F.coalesce(h, F.lit(USUAL_HEIGHT_M)).alias("height_m"), F.coalesce(n, F.lit(USUAL_LEVELS).cast("long")).alias("levels"))


def trees(found: DataFrame) -> DataFrame:
    """(doc, tree_id, lon, lat, species, height_m, canopy_m, kind): single trees, and one at each place of a row of trees, named by the row and the place's number.

    A tree without a place, or at 0 E or 0 N, is none. Heights are within 3 and 35 m, crowns within 1.5 and 8 m by the height, or 10 m by their diameter.
    """
    t = F.col("tags")
    species = F.coalesce(t["species"], t["genus"], t["taxon"], F.lit("tree"))
    leaf = F.lower(F.coalesce(t["leaf_type"], F.lit("")))
    kind = F.when(leaf.contains("needle") | leaf.contains("conifer") | F.lower(species).contains("pine"), "conifer").otherwise("deciduous")
    height = F.when(_metres(t["height"]).isNotNull(), clamp(_metres(t["height"]), 3.0, 35.0)).otherwise(TREE_HEIGHT_M)
    crown = F.when(_metres(t["diameter_crown"]).isNotNull(), clamp(_metres(t["diameter_crown"]) * 0.5, 1.5, 10.0)).otherwise(clamp(F.col("height_m") * 0.38, 1.5, 8.0))
    single = found.where("kind = 'tree'").select(
        "doc", F.col("id").alias("tree_id"), _number(F.coalesce("lon", t["lon"])).alias("lon"), _number(F.coalesce("lat", t["lat"])).alias("lat"), species.alias("species"), height.alias("height_m"), kind.alias("kind"), "tags"
    ).where("lon <> 0 and lat <> 0")
    single = single.select("doc", "tree_id", "lon", "lat", "species", "height_m", crown.alias("canopy_m"), "kind")
    rows = _with_corners(found, "row", 1, F.col("id").alias("row_id")).select(
        "doc", F.concat_ws("_", "row_id", "seq").alias("tree_id"), "lon", "lat", F.lit("tree_row").alias("species"), F.lit(ROW_HEIGHT_M).alias("height_m"), F.lit(ROW_CROWN_M).alias("canopy_m"), F.lit("deciduous").alias("kind")
    )
    return single.unionByName(rows)


def parks(found: DataFrame) -> DataFrame:
    """(doc, park_id, use, park, seq, lon, lat) of parks and other green areas with three corners."""
    t = F.col("tags")
    return _with_corners(found, "park", 3, F.col("id").alias("park_id"), F.coalesce(t["leisure"], t["landuse"], t["natural"]).alias("use"), F.coalesce(t["name"], F.lit("")).alias("park"))


def roads_and_buildings(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    return roads(found), buildings(found)


def counts(found: DataFrame) -> DataFrame:
    """(kind, features, missing, open): how many features each kind has, how many of their places are missing, and how many outlines of buildings and parks don't end where they begin."""
    o = outlines(found).unionByName(found.where("kind = 'tree'").select("doc", "at", "kind", F.lit(1).cast("long").alias("corners"), F.lit(0).cast("long").alias("missing"), F.lit(False).alias("closed")))
    is_open = F.col("kind").isin("building", "park") & ~F.col("closed")
    return o.groupBy("kind").agg(F.count(F.lit(1)).alias("features"), F.sum("missing").cast("long").alias("missing"), F.count_if(is_open).alias("open"))
