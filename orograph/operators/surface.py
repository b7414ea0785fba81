"""What rasters say about places and segments: heights through several layers, warmth and green, slope and aspect, and a smooth surface along routes.

A layer is a table of cells (col, row_, value) and its own georeference: columns go right from ``x0``, rows down from ``top``, a cell has ``dx`` x ``dy`` degrees.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, kinematics
from ..functions.durable import durable
from ..functions.numbers import clamp, finite_or, floor_mod
from .polylines import LINE, densify_lines, lines_of
from .spatial import bicubic

#: Warmth from none to full in degrees Celsius, and the sun that slopes are judged by.
WARM_C = (20.0, 50.0)
SUN_AZIMUTH, SUN_ELEVATION = 180.0, 55.0
#: Segments shorter than this have no slope; their share of light, and that of segments without a height.
LEAST_M, SHORT_LIGHT, UNKNOWN_LIGHT = 0.1, 0.5, 1.0
#: Metres of a degree, as cell sizes of the smooth surface have it.
DEGREE_M = 111320.0


@dataclass
class Layer:
    cells: DataFrame
    x0: float
    top: float
    dx: float
    dy: float

    def cell(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return F.floor((lon - self.x0) / self.dx).cast("long"), F.floor((self.top - lat) / self.dy).cast("long")


def first_of(points: DataFrame, layers: Sequence[Layer], *key: str) -> DataFrame:
    """(key..., value, layer) of points (key..., lon, lat): the value of the first layer that has one in the point's cell, and that layer's number from 0; both null where none has.

    Only points that a layer left open go on to the next, so a raster that covers all is the only one that is joined in full. Cells that are null, no numbers or infinite say nothing; if a layer has a cell twice, the greater value counts. ``key`` tells points apart.
    """
    left = points.select(*key, F.col("lon").cast("double").alias("_lon"), F.col("lat").cast("double").alias("_lat"))
    nowhere = F.coalesce(F.isnan("_lon") | F.isnan("_lat") | (F.abs(F.col("_lon")) > 1e6) | (F.abs(F.col("_lat")) > 1e6), F.lit(True))
    found = []
    for n, layer in enumerate(layers):
        c = layer.cells.select("col", "row_", finite_or(F.col("value").cast("double"), None).alias("_v")).where("_v is not null").groupBy("col", "row_").agg(F.max("_v").alias("_v"))
        col, row = layer.cell(F.col("_lon"), F.col("_lat"))
        j = left.where(~nowhere).select(*key, "_lon", "_lat", col.alias("col"), row.alias("row_")).join(c, ["col", "row_"], "left")
        # A write, as the open points are read both for their values and by the next layer.
        j = durable(j.select(*key, "_lon", "_lat", "_v"), "layer")
        found.append(j.where("_v is not null").select(*key, F.col("_v").alias("value"), F.lit(n).alias("layer")))
        left = j.where("_v is null").drop("_v")
    none = (F.lit(None).cast("double").alias("value"), F.lit(None).cast("int").alias("layer"))
    out = points.select(*key, F.col("lon").cast("double").alias("_lon"), F.col("lat").cast("double").alias("_lat")).where(nowhere).select(*key, *none)
    out = out.unionByName((left.where(~nowhere) if not layers else left).select(*key, *none))
    for f in found:
        out = out.unionByName(f)
    return out


def warmth(celsius: Column, low: float = WARM_C[0], high: float = WARM_C[1]) -> Column:
    """From 0 (cool) to 1 (hot); null stays null."""
    return F.when(celsius.isNotNull(), clamp((celsius - low) / (high - low), 0, 1))


def greenery(index: Column) -> Column:
    """From 0 (bare) to 1 (lush): what is under 0 is water or rock; null stays null."""
    return F.when(index.isNotNull(), clamp(index, 0, 1))


def slopes(segments: DataFrame, layers: Sequence[Layer], *key: str, sun_azimuth: float = SUN_AZIMUTH, sun_elevation: float = SUN_ELEVATION) -> DataFrame:
    """(key..., slope_pct, aspect_deg, light) of segments (key..., lon1, lat1, z1, lon2, lat2, z2): rise over distance, the direction it goes in, and its share of direct light.

    A height that isn't given is that of the first layer which has one. Segments under 0.1 m, and those with a place that is no number, have (0, 0, 0.5); those without a height at an end (0, 0, 1). ``key`` tells segments apart.
    """
    ends = [segments.select(*key, F.lit(i).alias("_end"), F.col(f"lon{i}").alias("lon"), F.col(f"lat{i}").alias("lat"), finite_or(F.col(f"z{i}").cast("double"), None).alias("_z")) for i in (1, 2)]
    open_ = ends[0].unionByName(ends[1]).where("_z is null")
    sampled = first_of(open_.drop("_z"), layers, *key, "_end").groupBy(*key).agg(*[F.max(F.when(F.col("_end") == i, F.col("value"))).alias(f"_s{i}") for i in (1, 2)])
    s = segments.join(sampled, list(key), "left")
    z = [F.coalesce(finite_or(F.col(f"z{i}").cast("double"), None), F.col(f"_s{i}")) for i in (1, 2)]
    places = [F.col(c) for c in ("lon1", "lat1", "lon2", "lat2")]
    bad = F.lit(False)
    for p in places:
        bad = bad | finite_or(p, None).isNull()
    s = s.select(*key, *places, z[0].alias("_z1"), z[1].alias("_z2"), bad.alias("_bad"), geo.haversine(*places).alias("_m"))
    short = F.col("_bad") | (F.col("_m") < LEAST_M)
    unknown = F.col("_z1").isNull() | F.col("_z2").isNull()
    slope = (F.col("_z2") - F.col("_z1")) / F.when(F.col("_m") > 0, F.col("_m")) * 100.0
    aspect = floor_mod(F.degrees(F.atan2((F.col("lon2") - F.col("lon1")) * F.cos(F.radians((F.col("lat1") + F.col("lat2")) * 0.5)), F.col("lat2") - F.col("lat1"))), 360.0)
    s = s.select(*key, short.alias("_short"), unknown.alias("_unknown"), F.when(~short & ~unknown, slope).otherwise(0.0).alias("slope_pct"), F.when(~short & ~unknown, aspect).otherwise(0.0).alias("aspect_deg"))
    light = kinematics.solar_aspect(F.lit(sun_elevation), F.lit(sun_azimuth), F.degrees(F.atan(F.abs(F.col("slope_pct")) / 100.0)), F.col("aspect_deg"))
    return s.select(*key, "slope_pct", "aspect_deg", F.when(F.col("_short"), SHORT_LIGHT).when(F.col("_unknown"), UNKNOWN_LIGHT).otherwise(light).alias("light"))


_SURFACE = ["elevation_m", "slope_pct", "slope_degrees", "aspect_degrees", "dz_dx", "dz_dy", "curvature"]


def gradients(points: DataFrame, layer: Layer, width: int, height: int, *keep: str) -> DataFrame:
    """(id, elevation_m, slope_pct, slope_degrees, aspect_degrees, dz_dx, dz_dy, curvature) of points (id, lon, lat) on the smooth surface through the centres of the layer's ``width`` x ``height`` cells.

    Cells count in metres at the point's latitude; cells without a value count as 0. Outside the layer, and for places that are no numbers, the surface is flat at 0. ``keep`` names the columns that come along, id where none is named.
    """
    keep = keep or ("id",)
    inside = F.coalesce((F.col("lon") >= layer.x0) & (F.col("lon") <= layer.x0 + width * layer.dx) & (F.col("lat") <= layer.top) & (F.col("lat") >= layer.top - height * layer.dy) & ~F.isnan("lon") & ~F.isnan("lat"), F.lit(False))
    p = points.select(
        *keep, F.when(inside, (F.col("lon") - layer.x0) / layer.dx - 0.5).alias("gx"), F.when(inside, (layer.top - F.col("lat")) / layer.dy - 0.5).alias("gy"),
        (layer.dx * DEGREE_M * F.cos(F.radians("lat"))).alias("cell_x_m"), F.lit(layer.dy * DEGREE_M).alias("cell_y_m"),
    )
    cells = layer.cells.select("col", "row_", finite_or(F.col("value").cast("double"), None).alias("value"))
    found = bicubic(p, cells, 10.0, 10.0, *keep, "gx")
    return found.select(*keep, *[F.when(F.col("gx").isNotNull(), F.col(c)).otherwise(0.0).alias(c) for c in _SURFACE])


def smooth_profile(points: DataFrame, layer: Layer, width: int, height: int, interval: float = 5.0) -> DataFrame:
    """(route_id, seg, step, lon, lat, ...) along routes (route_id, seq, lon, lat, z): each pair of points in steps of ``interval`` metres at most, with the smooth surface there. Routes of one point have none.

    The surface is worked out along different lines once, however many routes run there.
    """
    several = points.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("route_id"))).where("_n > 1").drop("_n")
    pairs, lines = lines_of(several, interval)
    # The number is given so that few bytes, which stand for many places, stay many tasks.
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = gradients(densify_lines(durable(lines, "lines").repartition(tasks, *LINE)), layer, width, height, *LINE, "step", "lon", "lat")
    pairs = pairs.withColumnsRenamed({c: f"_{c}" for c in LINE})
    met = pairs.join(found, [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in LINE])
    return met.select("route_id", "seg", "step", "lon", "lat", *_SURFACE)
