"""What stands along routes: distances from them, buildings beside them, and trees placed at least so far apart.

Routes are rows of segments (route_id, seq, lon1, lat1, z1, lon2, lat2, z2). All joins are by cells.
"""

from __future__ import annotations

from functools import reduce
from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.durable import durable, durable_counting, release
from ..functions.numbers import clamp, rounded
from .spatial import beside, cells_of_box, with_cell

#: Metres of a degree of a great circle on the sphere that distances are measured on.
_DEGREE = 111_195.1
#: The buffer around routes, and what buildings, single trees and planted rows may exceed it by.
BUFFER_M, BUILDING_M, TREE_M, ROW_M = 30.0, 15.0, 5.0, 2.0
#: Least distances from a route of mapped trees, trees on the edges of parks, and planted rows; and from trees that stand already.
FROM_ROUTE = {"mapped": 1.0, "park": 4.0, "row": 4.5}
SPACING = {"mapped": 5.0, "park": 8.0, "row": 9.0}
#: Metres beside a route at which rows are planted, and along it; green shares under the least have no trees.
OFFSETS, STEP_M, LEAST_GREEN, USUAL_GREEN = (-24.0, -16.0, -9.0, 9.0, 16.0, 24.0), 18.0, 0.15, 0.55
#: Soft edge of masks around routes, and columns that a block of a grid row has.
EDGE_M, BLOCK = 10.0, 1024


def route_distances(points: DataFrame, segments: DataFrame, radius_m: float, *key: str) -> DataFrame:
    """(key..., dist_m, route_z) of points (key..., lon, lat) with a route within the radius: the nearest one's distance and height there.

    The nearest place of a segment is found in the plane of its middle latitude, its distance is great-circle. Of equally near segments the first by (route_id, seq) counts; a height that is missing is 0.
    Where lon and lat are in the key, points aren't dealt out again by it.
    """
    size = max(2e-4, radius_m / geo.LAT_M)
    # All that a pair of point and segment doesn't need both for is worked out before they meet.
    k = F.cos(F.radians((F.col("lat1") + F.col("lat2")) * 0.5)) * geo.LON_M
    s = segments.select(F.struct("route_id", "seq").alias("_of"), F.col("lon1").alias("_x"), F.col("lat1").alias("_y"), beside(F.col("lon2"), F.col("lon1")).alias("_x2"), F.col("lat2").alias("_y2"),
                        F.coalesce("z1", F.lit(0.0)).alias("_z"), F.coalesce("z2", F.lit(0.0)).alias("_z2"), k.alias("_k"))
    dx, dy = (F.col("_x2") - F.col("_x")) * F.col("_k"), (F.col("_y2") - F.col("_y")) * geo.LAT_M
    s = s.withColumns({"_dx": dx, "_dy": dy, "_n": dx * dx + dy * dy})
    s = cells_of_box(s, F.col("_x"), F.col("_y"), F.col("_x2"), F.col("_y2"), radius_m, size)
    own = list(dict.fromkeys([*key, "lon", "lat"]))

    def met(p: DataFrame) -> DataFrame:
        """``p`` with ``_d`` and ``_at``, the distance from each segment in reach and the height there."""
        j = p.join(s, ["_cx", "_cy"])
        dot = (F.col("lon") + F.col("_turn") - F.col("_x")) * F.col("_k") * F.col("_dx") + (F.col("lat") - F.col("_y")) * geo.LAT_M * F.col("_dy")
        f = F.when(F.col("_n") > 1e-9, clamp(dot / F.when(F.col("_n") > 1e-9, F.col("_n")).otherwise(1.0), 0, 1)).otherwise(0.0)
        j = j.select(*p.columns, "_of", "_x", "_y", "_x2", "_y2", "_z", "_z2", f.alias("_f"))
        at = [F.col(f"_{c}") + F.col("_f") * (F.col(f"_{c}2") - F.col(f"_{c}")) for c in "xyz"]
        return j.select(*p.columns, "_of", geo.haversine(F.col("lon"), F.col("lat"), *at[:2]).alias("_d"), at[2].alias("_at"))

    # Points stay where they met segments, as they are in one cell. The least distance is added up by hash; which segment has it is only asked of those that do, so what points and segments meet is never sorted.
    least = met(with_cell(points.select(*own), F.col("lon"), F.col("lat"), size)).groupBy("_cx", "_cy", *own).agg(F.min("_d").alias("_least")).where(F.col("_least") <= radius_m)
    # A filter would be moved into the join, where distances were worked out several times.
    whose = F.when(F.col("_d") == F.col("_least"), F.array(F.struct(F.col("_d").alias("d"), "_of", F.col("_at").alias("z"))))
    best = met(least).select("_cx", "_cy", *own, F.explode(whose).alias("_best")).groupBy("_cx", "_cy", *own).agg(F.min("_best").alias("_best"))
    if len(own) > len(key):
        best = best.groupBy(*key).agg(F.min("_best").alias("_best"))
    return best.select(*key, F.col("_best.d").alias("dist_m"), F.col("_best.z").alias("route_z"))


def buildings_beside(corners: DataFrame, segments: DataFrame, buffer_m: float = BUFFER_M) -> DataFrame:
    """(building_id, lon, lat, reach_m, dist_m, base_m, height_m, levels): buildings whose centre is within the buffer and 15 m of a route.

    ``corners`` are rows (building_id, seq, lon, lat, height_m, levels), so a building of very many corners is many rows. Corners without a place don't count; a building
    needs three. ``reach_m`` is the farthest corner's distance from the centre and 3 m; ``base_m`` is the height of the nearest route. Heights and levels that are missing or not positive
    are 12 m and 4. A building across the 180th meridian isn't put together.
    """
    known = corners.where("lon is not null and lat is not null and not isnan(lon) and not isnan(lat)")
    centres = known.groupBy("building_id").agg(
        F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.count(F.lit(1)).alias("n"), F.max("height_m").alias("height_m"), F.max("levels").alias("levels")
    ).where("n >= 3")
    near = durable(centres.join(route_distances(centres, segments, buffer_m + BUILDING_M, "building_id"), "building_id"), "buildings")
    c = known.select("building_id", F.col("lon").alias("x"), F.col("lat").alias("y")).join(near.select("building_id", "lon", "lat"), "building_id")
    reach = c.groupBy("building_id").agg((F.max(geo.haversine(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"))) + 3.0).alias("reach_m"))
    height = F.when(F.col("height_m") > 0, F.col("height_m")).otherwise(12.0)
    levels = F.when(F.col("levels") > 0, F.col("levels")).otherwise(4)
    return near.join(reach, "building_id").select("building_id", "lon", "lat", "reach_m", "dist_m", F.col("route_z").alias("base_m"), height.alias("height_m"), levels.alias("levels"))


def clear_of(points: DataFrame, buildings: DataFrame) -> DataFrame:
    """The points (lon, lat, ...) that lie in no building's reach (lon, lat, reach_m). Of buildings at one place the widest counts."""
    size = 5e-4
    b = buildings.groupBy(F.col("lon").alias("blon"), F.col("lat").alias("blat")).agg(F.max("reach_m").alias("reach_m"))
    b = cells_of_box(b, F.col("blon"), F.col("blat"), F.col("blon"), F.col("blat"), F.col("reach_m"), size).withColumnsRenamed({"_cx": "_bx", "_cy": "_by"})
    inside = geo.haversine(F.col("lon"), F.col("lat"), F.col("blon"), F.col("blat")) < F.col("reach_m")
    return with_cell(points, F.col("lon"), F.col("lat"), size).join(b, (F.col("_cx") == F.col("_bx")) & (F.col("_cy") == F.col("_by")) & inside, "left_anti").drop("_cx", "_cy")


def spaced(candidates: DataFrame, *order: str) -> DataFrame:
    """The candidates (lon, lat, spacing_m, ...) that stand when each, in the order of the ``order`` columns, is placed unless one placed before is nearer than its spacing.

    That is the sequence's own result, found in rounds without going through it: a candidate is placed as soon as no undecided one before it is within its spacing, and those
    after it that are too near to it go. Cells are so small that two of one cell are always too near, so only the first undecided candidate of a cell, or of its part in a larger one, can be
    next, and a placed one is alone in its cell: each candidate meets a fixed number of others, however many stand in one place. A round is two joins by larger cells, so wide that
    what is near to a candidate is in two or three of them on average. Where the order jumps about, rounds grow with the
    logarithm of the number of candidates; where each waits for the one before it along a line, with the number of links.

    ``order`` tells candidates apart: of rows equal in it one counts. Rows without a place or without a positive spacing are never placed.
    """
    real = "lon is not null and lat is not null and spacing_m > 0 and not isnan(lon) and not isnan(lat)"
    asked = candidates.where(real).dropDuplicates(list(order))
    least, most = asked.agg(F.min("spacing_m"), F.max("spacing_m")).first()
    if least is None:
        return candidates.limit(0)
    size = 0.999 * least / sqrt(2) / _DEGREE
    place = F.struct(*order)
    wide = 4.0 * most / _DEGREE
    small = with_cell(asked.select(place.alias("o"), "lon", "lat", "spacing_m"), F.col("lon"), F.col("lat"), size).withColumnsRenamed({"_cx": "_sx", "_cy": "_sy"})
    open_ = durable(with_cell(small, F.col("lon"), F.col("lat"), wide), "open")
    parts = []
    met = (F.col("_cx") == F.col("_px")) & (F.col("_cy") == F.col("_py"))
    near = geo.haversine(F.col("lon"), F.col("lat"), F.col("plon"), F.col("plat")) < F.col("spacing_m")

    def around(df: DataFrame) -> DataFrame:
        p = df.select(F.col("o").alias("po"), F.col("lon").alias("plon"), F.col("lat").alias("plat"))
        return cells_of_box(p, F.col("plon"), F.col("plat"), F.col("plon"), F.col("plat"), F.lit(float(most)), wide).drop("_turn").withColumnsRenamed({"_cx": "_px", "_cy": "_py"})

    # Candidates stay in their own larger cell and look there for what is around: nothing is dealt out by candidate.
    while True:
        heads = open_.repartition("_cx", "_cy").groupBy("_cx", "_cy", "_sx", "_sy").agg(F.min(F.struct("o", "lon", "lat", "spacing_m")).alias("h")).select("_cx", "_cy", "h.*")
        free = durable(heads.join(around(open_), met & (F.col("po") < F.col("o")) & near, "left_anti").drop("_cx", "_cy"), "placed")
        parts.append(free)
        gone = (F.col("o") == F.col("po")) | ((F.col("o") > F.col("po")) & near)
        left, n = durable_counting(open_.join(around(free), met & gone, "left_anti"), "true", "open")
        release(open_)
        open_ = left
        if not n:
            break
    placed = reduce(DataFrame.unionByName, parts).select("o.*")
    return asked.join(placed, list(order), "left_semi")


def planted_rows(segments: DataFrame, buffer_m: float = BUFFER_M) -> DataFrame:
    """(route_id, seq, step, side, lon, lat): places beside segments of 2 m and more, every 18 m or so along and at OFFSETS across, none farther than the buffer."""
    lon2 = beside(F.col("lon2"), F.col("lon1"))
    s = segments.select("route_id", "seq", "lon1", "lat1", lon2.alias("lon2"), "lat2").withColumn("m", geo.haversine(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))).where("m >= 2")
    dx = (F.col("lon2") - F.col("lon1")) * geo.LON_M * F.cos(F.radians((F.col("lat1") + F.col("lat2")) * 0.5))
    dy = (F.col("lat2") - F.col("lat1")) * geo.LAT_M
    s = s.withColumns({"n": F.greatest(F.lit(1), F.rint(F.col("m") / STEP_M).cast("int")), "nx": -dy / F.hypot(dx, dy), "ny": dx / F.hypot(dx, dy)})
    sides = [(i, o) for i, o in enumerate(OFFSETS) if abs(o) <= buffer_m]
    if not sides:
        sides = [(0, None)]
    s = s.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    s = s.withColumn("o", F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.lit(o).cast("double").alias("off")) for i, o in sides]))).where("o.off is not null")
    f = (F.col("step") + 0.5) / F.col("n")
    mid = [F.col(f"{c}1") + f * (F.col(f"{c}2") - F.col(f"{c}1")) for c in ("lon", "lat")]
    lat = mid[1] + F.col("ny") * F.col("o.off") / geo.LAT_M
    lon = mid[0] + F.col("nx") * F.col("o.off") / (geo.LON_M * F.cos(F.radians(mid[1])))
    return s.select("route_id", "seq", "step", F.col("o.side").alias("side"), lon.alias("lon"), lat.alias("lat"))


_ORDER = ["stage", "a", "b", "c", "d"]
_KINDS = ("deciduous", "broadleaf", "conifer", "pine")


def trees_beside(segments: DataFrame, buildings: DataFrame, mapped: DataFrame | None = None, park_corners: DataFrame | None = None, green: DataFrame | None = None, buffer_m: float = BUFFER_M) -> DataFrame:
    """Trees along routes, all stages at once: (stage, a, b, c, d, lon, lat, dist_m, base_m, height_m, canopy_m, trunk_m, trunk_radius_m, kind, greenery).

    First come ``mapped`` trees (tree_id, lon, lat, height_m, canopy_m, kind) in the order of their id, then corners of parks (park_id, seq, lon, lat) whose centre is near a route, then rows planted along
    the routes where ``green`` (route_id, seq, step, side, green; USUAL_GREEN where it says nothing) isn't under LEAST_GREEN. A tree stands if it is neither too near to a route nor beyond
    the buffer, in no building's reach (of ``buildings_beside``), and not too near to any before it. Sizes of planted ones vary by a checksum of their place.
    """
    nothing = segments.sparkSession.createDataFrame([], "tree_id long, lon double, lat double, height_m double, canopy_m double, kind string")
    m = (nothing if mapped is None else mapped).select(
        F.lit(1).alias("stage"), F.col("tree_id").cast("long").alias("a"), *[F.lit(0).cast("long").alias(c) for c in "bcd"], "lon", "lat",
        F.col("height_m").cast("double").alias("height_m"), F.col("canopy_m").cast("double").alias("canopy_m"), "kind", F.lit(0.85).alias("greenery"),
    )
    parts = [(m, "mapped", buffer_m + TREE_M)]
    if park_corners is not None:
        centres = park_corners.groupBy("park_id").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.count(F.lit(1)).alias("n")).where("n >= 3")
        near = route_distances(centres, segments, buffer_m + 10.0, "park_id").select("park_id")
        p = park_corners.join(near, "park_id").select(
            F.lit(2).alias("stage"), F.col("park_id").cast("long").alias("a"), F.col("seq").cast("long").alias("b"), *[F.lit(0).cast("long").alias(c) for c in "cd"], "lon", "lat",
            F.lit(9.0).alias("height_m"), F.lit(3.8).alias("canopy_m"), F.lit("broadleaf").alias("kind"), F.lit(0.9).alias("greenery"),
        )
        parts.append((p, "park", buffer_m))
    rows = planted_rows(segments, buffer_m)
    rows = rows.withColumn("green", F.lit(None).cast("double")) if green is None else rows.join(green, ["route_id", "seq", "step", "side"], "left")
    rows = rows.withColumn("greenery", F.coalesce(F.when(~F.isnan("green"), F.col("green")), F.lit(USUAL_GREEN))).where(F.col("greenery") >= LEAST_GREEN)
    h = F.crc32(F.concat_ws(" ", F.format_number("lon", 5), F.format_number("lat", 5)).cast("binary"))
    rows = rows.select(
        F.lit(3).alias("stage"), F.col("route_id").cast("long").alias("a"), F.col("seq").cast("long").alias("b"), F.col("step").cast("long").alias("c"), F.col("side").cast("long").alias("d"), "lon", "lat",
        rounded(5.5 + (h % 45) * 0.12 + F.col("greenery") * 2.8, 1).alias("height_m"), rounded(2.0 + (h % 25) * 0.09 + F.col("greenery") * 1.3, 1).alias("canopy_m"),
        F.element_at(F.array(*map(F.lit, _KINDS)), (h % len(_KINDS) + 1).cast("int")).alias("kind"), "greenery",
    )
    parts.append((rows, "row", buffer_m + ROW_M))
    widest = max(most for _, _, most in parts)
    asked = reduce(DataFrame.unionByName, [df.withColumns({"spacing_m": F.lit(SPACING[name]), "_least_m": F.lit(FROM_ROUTE[name]), "_most_m": F.lit(most)}) for df, name, most in parts])
    found = route_distances(asked, segments, widest, *asked.columns).where("dist_m between _least_m and _most_m").drop("_least_m", "_most_m")
    all_ = durable(clear_of(found, buildings), "candidates")
    stand = spaced(all_, *_ORDER)
    planted = F.col("stage") == 3
    trunk = F.when(planted, rounded(1.5 + (F.floor(F.col("height_m") * 10).cast("long") % 18) * 0.08, 1)).when(F.col("stage") == 2, 2.2).otherwise(rounded(F.col("height_m") * 0.3, 1))
    girth = F.when(planted, rounded(0.2 + (F.floor(F.col("canopy_m") * 10).cast("long") % 12) * 0.015, 2)).when(F.col("stage") == 2, 0.32).otherwise(rounded(F.greatest(F.lit(0.18), F.col("canopy_m") * 0.08), 2))
    return stand.select(*_ORDER, "lon", "lat", "dist_m", F.col("route_z").alias("base_m"), "height_m", "canopy_m", trunk.alias("trunk_m"), girth.alias("trunk_radius_m"), "kind", "greenery")


def _nearest_m(lon: Column, lat: Column) -> Column:
    """Great-circle metres from a place to that place of the segment (_x, _y, _x2, _y2) which is nearest in the plane of the place's latitude."""
    k = F.cos(F.radians(lat))
    dx, dy = (F.col("_x2") - F.col("_x")) * k, F.col("_y2") - F.col("_y")
    n = dx * dx + dy * dy
    t = F.when(n > 0, clamp(((lon - F.col("_x")) * k * dx + (lat - F.col("_y")) * dy) / F.when(n > 0, n).otherwise(1.0), 0, 1)).otherwise(0.0)
    return geo.haversine(lon, lat, F.col("_x") + t * (F.col("_x2") - F.col("_x")), F.col("_y") + t * (F.col("_y2") - F.col("_y")))


def grid_cells(segments: DataFrame, x0: float, top: float, res: float, width: int, height: int, buffer_m: float = BUFFER_M) -> DataFrame:
    """(col, row_, lon, lat) of the cells of a grid whose centres are within the buffer and EDGE_M of a route.

    The grid has ``width`` x ``height`` cells of ``res`` degrees, from the corner (x0, top) to the right and down. What is within a distance of a segment is a capsule, which a grid row cuts in one interval, so
    each segment gives an interval of columns for each row that it reaches, and no other cell is ever made. Intervals of a row are put together, BLOCK columns at a time: of those that begin in one column the longest stays
    before the shuffle, so routes that share a street, however many, are as few rows as one. Segments without a place don't count; the grid doesn't go over the 180th meridian.
    """
    reach = buffer_m + EDGE_M
    rho = reach / _DEGREE
    s = segments.where("lon1 is not null and lat1 is not null and lon2 is not null and lat2 is not null").select(
        F.col("lon1").alias("_x"), F.col("lat1").alias("_y"), F.col("lon2").alias("_x2"), F.col("lat2").alias("_y2")
    ).distinct()
    first = F.floor((top - F.greatest("_y", "_y2")) / res - 0.5 - rho / res * 1.001)
    last = F.ceil((top - F.least("_y", "_y2")) / res - 0.5 + rho / res * 1.001)
    s = s.withColumns({"_a": F.greatest(first, F.lit(0)).cast("long"), "_z": F.least(last, F.lit(height - 1)).cast("long")}).where("_a <= _z")
    s = s.withColumn("row_", F.explode(F.sequence("_a", "_z"))).withColumn("lat", top - (F.col("row_") + 0.5) * res)
    s = s.withColumn("k", F.cos(F.radians("lat"))).withColumns({"x1": F.col("_x") * F.col("k"), "x2": F.col("_x2") * F.col("k"), "y1": F.col("_y") - F.col("lat"), "y2": F.col("_y2") - F.col("lat")})
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = F.when(F.hypot(dx, dy) > 0, F.hypot(dx, dy))
    wide = rho * 1.0001  # the ends are then found exactly
    half = lambda y: F.when(F.abs(F.col(y)) <= wide, F.sqrt(wide * wide - F.col(y) * F.col(y)))
    s = s.withColumns({"_h1": half("y1"), "_h2": half("y2"), "_nx": -dy / length * wide, "_ny": dx / length * wide})
    ends = [F.col("x1") - F.col("_h1"), F.col("x1") + F.col("_h1"), F.col("x2") - F.col("_h2"), F.col("x2") + F.col("_h2")]
    for side in (1.0, -1.0):
        t = -(F.col("y1") + side * F.col("_ny")) / F.when(dy != 0, dy)
        ends.append(F.when((t >= 0) & (t <= 1), F.col("x1") + side * F.col("_nx") + t * dx))
    column = lambda x: F.floor((x / F.col("k") - x0) / res - 0.5).cast("long")
    s = s.withColumns({"_lo": column(F.least(*ends)), "_hi": column(F.greatest(*ends))}).select("row_", "lat", "_x", "_y", "_x2", "_y2", "_lo", "_hi")
    inside = lambda c: _nearest_m(x0 + (c + 0.5) * res, F.col("lat")) <= reach
    # Of an interval whose ends are off by a cell at most the exact ends are among the nearest cells; a short one is looked at as a whole. Cells are columns, which are compiled; a function of an array is not.
    s = s.withColumns({"_n": F.least(F.lit(3), F.greatest(F.lit(0), F.col("_hi") - F.col("_lo") + 1)), "_b": F.greatest(F.col("_lo"), F.col("_hi") - 1)})
    s = s.withColumns({f"_l{i}": inside(F.col("_lo") + i) for i in range(4)} | {f"_r{i}": inside(F.col("_b") + i) for i in range(3)})
    low, high = F.lit(None).cast("long"), F.lit(None).cast("long")
    for i in reversed(range(4)):
        low = F.when(F.col(f"_l{i}") & (F.col("_n") >= i), F.col("_lo") + i).otherwise(low)
    for i in range(3):
        high = F.when(F.col(f"_r{i}") & (F.col("_b") + i <= F.col("_hi") + 1), F.col("_b") + i).otherwise(high)
    s = s.withColumns({"_lo2": low, "_hi2": high})
    s = s.select("row_", F.coalesce("_lo2", "_hi2").alias("lo"), F.coalesce("_hi2", "_lo2").alias("hi"))
    s = s.select("row_", F.when(F.col("lo") < 0, 0).otherwise(F.col("lo")).alias("lo"), F.when(F.col("hi") >= width, width - 1).otherwise(F.col("hi")).alias("hi"))
    # Segments that miss a row have no blocks. A filter instead would be moved down, and all of the above be worked out twice.
    s = s.withColumn("block", F.explode(F.when(F.col("lo") <= F.col("hi"), F.sequence(F.floor(F.col("lo") / BLOCK), F.floor(F.col("hi") / BLOCK)))))
    s = s.select("row_", "block", F.greatest("lo", F.col("block") * BLOCK).alias("lo"), F.least("hi", F.col("block") * BLOCK + BLOCK - 1).alias("hi"))
    s = s.groupBy("row_", "block", "lo").agg(F.max("hi").alias("hi"))
    before = Window.partitionBy("row_", "block").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)  # BLOCK rows at most
    s = s.withColumn("done", F.coalesce(F.max("hi").over(before), F.lit(-1).cast("long"))).withColumn("lo", F.greatest("lo", F.col("done") + 1)).where("lo <= hi")
    cells = s.select(F.explode(F.sequence("lo", "hi")).alias("col"), "row_")
    return cells.select("col", "row_", (x0 + (F.col("col") + 0.5) * res).alias("lon"), (top - (F.col("row_") + 0.5) * res).alias("lat"))


def masked_grid(cells: DataFrame, segments: DataFrame, x0: float, top: float, res: float, width: int, height: int, buffer_m: float = BUFFER_M) -> DataFrame:
    """``cells`` (col, row_, value, ...) of a grid with null values outside ``grid_cells``."""
    near = grid_cells(segments, x0, top, res, width, height, buffer_m).select("col", "row_", F.lit(True).alias("_in"))
    return cells.join(near, ["col", "row_"], "left").withColumn("value", F.when(F.col("_in"), F.col("value"))).drop("_in")
