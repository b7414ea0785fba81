"""Routes, bands and matched tracks as GeoJSON and GPX text, one document a route, made by Spark and written by its text writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _in_order(order: str, text: Column, between: str) -> Column:
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return F.array_join(F.transform(parts, lambda p: p["t"]), between)


def geojson_lines(points: DataFrame, key: str, order: str = "seq", properties: DataFrame | None = None) -> DataFrame:
    """(key, value): a GeoJSON Feature for each line of points (key, order, lon, lat, z), places to 6 and heights to 2 decimals.

    ``properties`` (key, any columns) become the Feature's; a line is one row, so it is as large as its points.
    """
    place = F.format_string("[%.6f,%.6f,%.2f]", "lon", "lat", F.coalesce("z", F.lit(0.0)))
    lines = points.where("lon is not null and lat is not null").groupBy(key).agg(_in_order(order, place, ",").alias("c"))
    if properties is None:
        lines = lines.withColumn("p", F.lit("{}"))
    else:
        own = [c for c in properties.columns if c != key]
        lines = lines.join(properties.select(key, F.to_json(F.struct(*own)).alias("p")), key, "left").fillna({"p": "{}"})
    text = F.format_string('{"type":"Feature","geometry":{"type":"LineString","coordinates":[%s]},"properties":%s}', "c", "p")
    return lines.select(key, text.alias("value"))


def gpx_lines(points: DataFrame, key: str, order: str = "seq", creator: str = "orograph") -> DataFrame:
    """(key, value): a GPX 1.1 document with one track for each line."""
    point = F.format_string('<trkpt lat="%.6f" lon="%.6f"><ele>%.2f</ele></trkpt>', "lat", "lon", F.coalesce("z", F.lit(0.0)))
    lines = points.where("lon is not null and lat is not null").groupBy(key).agg(_in_order(order, point, "").alias("c"))
    head = f'<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="{creator}" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>'
    return lines.select(key, F.concat(F.lit(head), F.col(key).cast("string"), F.lit("</name><trkseg>"), "c", F.lit("</trkseg></trk></gpx>")).alias("value"))


def gpx_matched(points: DataFrame, key: str, order: str = "seq", creator: str = "orograph") -> DataFrame:
    """(key, value): a GPX 1.1 document with one track for each matched line of points (key, order, lon, lat, z, residual_m, slope_pct), whose points carry how far off they were and the slope. What is missing there is 0."""
    of = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    point = F.format_string(
        '<trkpt lat="%.6f" lon="%.6f"><ele>%.2f</ele><extensions><residual_m>%.2f</residual_m><slope_pct>%.1f</slope_pct></extensions></trkpt>', "lat", "lon", of("z"), of("residual_m"), of("slope_pct")
    )
    lines = points.where("lon is not null and lat is not null").groupBy(key).agg(_in_order(order, point, "").alias("c"))
    head = f'<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="{creator}" xmlns="http://www.topografix.com/GPX/1/1"><metadata><name>'
    return lines.select(key, F.concat(F.lit(head), F.col(key).cast("string"), F.lit("</name></metadata><trk><trkseg>"), "c", F.lit("</trkseg></trk></gpx>")).alias("value"))


def wkt_lines(points: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """(key, value): LINESTRING Z text."""
    place = F.format_string("%.6f %.6f %.2f", "lon", "lat", F.coalesce("z", F.lit(0.0)))
    lines = points.where("lon is not null and lat is not null").groupBy(key).agg(_in_order(order, place, ", ").alias("c"))
    return lines.select(key, F.concat(F.lit("LINESTRING Z ("), "c", F.lit(")")).alias("value"))


def band_collections(bands: DataFrame, profile: str = "adult") -> DataFrame:
    """(src, value): a GeoJSON FeatureCollection of each origin's bands (src, cutoff_min, node_count, area_ha, ring), the widest first.

    A band of under three points has a null geometry. There are at most twelve bands an origin.
    """
    ring = F.concat("ring", F.slice("ring", 1, 1))
    places = F.array_join(F.transform(ring, lambda p: F.format_string("[%.6f,%.6f]", p["lon"], p["lat"])), ",")
    shape = F.when(F.size("ring") >= 3, F.format_string('{"type":"Polygon","coordinates":[[%s]]}', places)).otherwise("null")
    told = F.to_json(F.struct(
        F.col("cutoff_min").alias("time_cutoff_min"), F.col("node_count").alias("reachable_node_count"), F.round("area_ha", 2).alias("approx_area_ha"),
        F.round(F.col("area_ha") / 100.0, 4).alias("area_sqkm"), F.size("ring").alias("boundary_points_count"),
    ))
    feature = F.format_string('{"type":"Feature","geometry":%s,"properties":%s}', shape, told)
    g = bands.groupBy("src").agg(F.max("node_count").alias("n"), F.sort_array(F.collect_list(F.struct("cutoff_min", feature.alias("t"))), asc=False).alias("f"))
    head = F.to_json(F.struct(F.lit(profile).alias("profile_key"), F.col("n").alias("total_reachable_nodes")))
    all_of = F.array_join(F.transform("f", lambda f: f["t"]), ",")
    return g.select("src", F.format_string('{"type":"FeatureCollection","properties":%s,"features":[%s]}', head, all_of).alias("value"))
