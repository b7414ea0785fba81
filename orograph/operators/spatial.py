"""Spatial joins by grid cells, and what is built on them.

A join within a radius puts one side into the cells its reach touches and joins on equal cells, so it is an equi-join that shuffles by
cell, and the exact distance filters. No side is broadcast by hand: Spark does that where it knows a side to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.durable import durable
from ..functions.numbers import at_least, floor_mod

#: Rows of cells that reach beyond this latitude are one cell each: cells of equal degrees would be slivers there.
_POLAR = 84.0
#: A little under the metres of a degree on the sphere that distances are measured on, so that reaches in degrees are wide enough.
_DEGREE_M = 111_150.0


def _columns(size: float) -> int:
    """How many cells go round the earth: a whole number, so that the last one ends where the first begins."""
    return max(1, int(360.0 / size))


def _row(lat: Column, size: float) -> Column:
    return F.floor(lat / size).cast("long")


def _polar(row: Column, size: float) -> Column:
    return F.greatest(F.abs(row * size), F.abs((row + 1) * size)) > _POLAR


def _column(lon: Column, size: float) -> Column:
    """Counted on beyond 180 degrees; modulo ``_columns`` it is a cell's."""
    return F.floor((lon + 180.0) / (360.0 / _columns(size))).cast("long")


def beside(lon: Column, other: Column) -> Column:
    """The longitude as the number of degrees that is within 180 of ``other``; unchanged if it is already."""
    return F.when(F.abs(lon - other) > 180.0, lon - 360.0 * F.round((lon - other) / 360.0)).otherwise(lon)


def cells_of_box(df: DataFrame, lon1: Column, lat1: Column, lon2: Column, lat2: Column, pad_m: float | Column, size: float) -> DataFrame:
    """Each row once for every cell (_cx, _cy) of ``size`` degrees that its box, padded by metres, touches.

    The box goes the short way round from lon1 to lon2. Cells go on over the 180th meridian; near a pole the whole circle is in reach. ``_turn`` is by how many
    degrees a place in the cell has to count on so that it is beside the box.
    """
    pad = pad_m if isinstance(pad_m, Column) else F.lit(float(pad_m))
    high = pad / _DEGREE_M
    far = F.greatest(F.abs(lat1), F.abs(lat2))
    # Points within an angle of a place are within this many degrees of its meridian, unless the pole is as near.
    wide = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(high)) / F.greatest(F.lit(1e-9), F.cos(F.radians(far))))))
    wide = F.when(far + high < 89.9, wide * 1.0001 + 1e-9).otherwise(180.0)
    other = beside(lon2, lon1)
    n = _columns(size)
    first, last = _column(F.least(lon1, other) - wide, size), _column(F.greatest(lon1, other) + wide, size)
    rows = df.withColumns({"_first": first, "_last": last}).withColumn(
        "_cy", F.explode(F.sequence(_row(F.least(lat1, lat2) - high, size), _row(F.greatest(lat1, lat2) + high, size)))
    )
    polar = _polar(F.col("_cy"), size)
    rows = rows.withColumn("_cx", F.explode(F.when(polar, F.array("_first")).otherwise(F.sequence("_first", F.least(F.col("_last"), F.col("_first") + n - 1)))))
    turn = F.when(polar, 0.0).otherwise(360.0 * F.floor(F.col("_cx") / n))
    return rows.withColumns({"_turn": turn, "_cx": F.when(polar, F.lit(0).cast("long")).otherwise(F.pmod("_cx", F.lit(n)).cast("long"))}).drop("_first", "_last")


def with_cell(df: DataFrame, lon: Column, lat: Column, size: float) -> DataFrame:
    row = _row(lat, size)
    column = F.pmod(_column(lon, size), F.lit(_columns(size))).cast("long")
    return df.withColumns({"_cx": F.when(_polar(row, size), F.lit(0).cast("long")).otherwise(column), "_cy": row})


def within(points: DataFrame, targets: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of ``points`` (lon, lat, ...) and ``targets`` (tlon, tlat, ...) at most ``radius_m`` apart, with ``dist_m``; over the 180th meridian and the poles too."""
    size = max(1e-4, radius_m / geo.LAT_M)
    left = with_cell(points, F.col("lon"), F.col("lat"), size)
    right = cells_of_box(targets, F.col("tlon"), F.col("tlat"), F.col("tlon"), F.col("tlat"), radius_m, size)
    joined = left.join(right, ["_cx", "_cy"]).drop("_cx", "_cy", "_turn")
    d = geo.haversine(F.col("lon"), F.col("lat"), F.col("tlon"), F.col("tlat"))
    return joined.withColumn("dist_m", d).where(F.col("dist_m") <= radius_m)


def nearest(points: DataFrame, targets: DataFrame, radius_m: float, key: str, target_key: str) -> DataFrame:
    """(key, target, dist_m): the nearest target within the radius, the least target key of equals.

    A target within a small circle is nearer than all outside it, so circles widen, and only points that found nothing go on to the
    next. Dense places are thus never joined over the whole radius.
    """
    found, left = None, points
    for r in (radius_m / 32, radius_m / 6, radius_m):
        pairs = within(left, targets, r)
        best = pairs.groupBy(key).agg(F.min(F.struct("dist_m", F.col(target_key).alias("t"))).alias("b"))
        if r < radius_m:
            best = durable(best, "nearest")
            left = left.join(best, key, "left_anti")
        found = best if found is None else found.unionByName(best)
    # Null keys are one group in each pass.
    return found.groupBy(key).agg(F.min("b").alias("b")).select(key, F.col("b.t").alias(target_key), F.col("b.dist_m").alias("dist_m"))


def near_segments(points: DataFrame, segments: DataFrame, radius_m: float, tasks: int | None = None) -> DataFrame:
    """Pairs of points and segments (lon1, lat1, lon2, lat2, ...) within the radius: fraction, snap_lon, snap_lat, dist_m.

    The nearest place is found in degrees, its distance is great-circle. Across the 180th meridian lon, lon2 and snap_lon count on beside lon1. ``tasks`` is for points of few
    bytes, which stand for many pairs and would be one task.
    """
    size = max(1e-3, 4 * radius_m / geo.LAT_M)
    left = with_cell(points, F.col("lon"), F.col("lat"), size)
    left = left if tasks is None else left.repartition(tasks, "_cx", "_cy")
    right = cells_of_box(segments, F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"), radius_m, size)
    j = left.join(right.withColumn("lon2", beside(F.col("lon2"), F.col("lon1"))), ["_cx", "_cy"])
    j = j.withColumn("lon", F.col("lon") + F.col("_turn")).drop("_cx", "_cy", "_turn")
    j = j.withColumn("fraction", geo.fraction_on_segment(*(F.col(c) for c in ("lon", "lat", "lon1", "lat1", "lon2", "lat2"))))
    j = j.withColumn("snap_lon", F.col("lon1") + F.col("fraction") * (F.col("lon2") - F.col("lon1")))
    j = j.withColumn("snap_lat", F.col("lat1") + F.col("fraction") * (F.col("lat2") - F.col("lat1")))
    j = j.withColumn("dist_m", geo.haversine(F.col("lon"), F.col("lat"), F.col("snap_lon"), F.col("snap_lat")))
    return j.where(F.col("dist_m") <= radius_m)


def places_of(points: DataFrame) -> DataFrame:
    """(_lon, _lat, lon, lat): the different places of points, twice, as a join may turn lon; points find theirs by ``at_place``."""
    return points.select(F.col("lon").alias("_lon"), F.col("lat").alias("_lat")).distinct().select("*", F.col("_lon").alias("lon"), F.col("_lat").alias("lat"))


def at_place(points: DataFrame, found: DataFrame) -> DataFrame:
    """Points without their lon and lat, with what was found for their place (_lon, _lat, ...)."""
    p = points.withColumnsRenamed({"lon": "_plon", "lat": "_plat"})
    return p.join(found, (F.col("_plon") == F.col("_lon")) & (F.col("_plat") == F.col("_lat"))).drop("_plon", "_plat", "_lon", "_lat")


def segments_in_reach(points: DataFrame, segments: DataFrame, radius_m: float, *keys: str) -> DataFrame:
    """(keys, n, dist_m): how many segments are within the radius of each point, and how far the nearest is; points at one place are looked up once."""
    near = near_segments(places_of(points), segments, radius_m).groupBy("_lon", "_lat").agg(F.count(F.lit(1)).alias("n"), F.min("dist_m").alias("dist_m"))
    return at_place(points.select(*keys, "lon", "lat"), near).groupBy(*keys).agg(F.sum("n").alias("n"), F.min("dist_m").alias("dist_m"))


def corridor_distance(points: DataFrame, segments: DataFrame, buffer_m: float, key: str = "id") -> DataFrame:
    """(key, dist_m, route_z): nearest of the routes' segments within the buffer, and the route's height at the nearest place.

    Of equally near segments the first by (route_id, seq) wins. Points at one place are looked up once.
    """
    size = max(1e-3, 2 * buffer_m / geo.LAT_M)
    places = points.select(F.col("lon").alias("_lon"), F.col("lat").alias("_lat")).distinct()
    left = with_cell(places.select("*", F.col("_lon").alias("lon"), F.col("_lat").alias("lat")), F.col("lon"), F.col("lat"), size)
    right = cells_of_box(segments, F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"), buffer_m, size)
    j = left.join(right.withColumn("lon2", beside(F.col("lon2"), F.col("lon1"))), ["_cx", "_cy"])
    j = j.withColumn("lon", F.col("lon") + F.col("_turn"))
    j = j.withColumn("d", geo.metres_to_segment(*(F.col(c) for c in ("lon", "lat", "lon1", "lat1", "lon2", "lat2")))).where(F.col("d") <= buffer_m)
    k = F.cos(F.radians("lat")) * geo.LON_M
    zero = F.lit(0.0)
    ax, ay = (F.col("lon1") - F.col("lon")) * k, (F.col("lat1") - F.col("lat")) * geo.LAT_M
    bx, by = (F.col("lon2") - F.col("lon")) * k, (F.col("lat2") - F.col("lat")) * geo.LAT_M
    z = F.col("z1") + geo.fraction_on_segment(zero, zero, ax, ay, bx, by) * (F.col("z2") - F.col("z1"))
    best = j.groupBy("_lon", "_lat").agg(F.min(F.struct("d", "route_id", "seq", z.alias("z"))).alias("b"))
    best = points.select(key, "lon", "lat").join(best, (F.col("lon") == F.col("_lon")) & (F.col("lat") == F.col("_lat"))).groupBy(key).agg(F.min("b").alias("b"))
    return best.select(key, F.col("b.d").alias("dist_m"), F.col("b.z").alias("route_z"))


def masked_cells(cells: DataFrame, segments: DataFrame, buffer_m: float) -> DataFrame:
    """Raster cells (layer, col, row_, lon, lat, value): the value stays within ``buffer_m`` + 10 m of a route, else null."""
    near = corridor_distance(cells.withColumn("id", F.struct("layer", "col", "row_")), segments, buffer_m + 10.0)
    near = near.select(F.col("id.layer").alias("layer"), F.col("id.col").alias("col"), F.col("id.row_").alias("row_"), F.lit(True).alias("_in"))
    return cells.join(near, ["layer", "col", "row_"], "left").withColumn("value", F.when(F.col("_in"), F.col("value"))).drop("_in")


def inverse_distance(targets: DataFrame, known: DataFrame, power: float = 2.0, radius: float | None = None, epsilon: float = 1e-6) -> DataFrame:
    """(id, value): heights at ``targets`` (id, x, y) from all ``known`` (px, py, pz) by inverse distance.

    A known point at the place gives its value; without one in the radius the nearest does. All known points count for each target, so
    it pairs both sides, but only their different places.
    """
    k = known.groupBy("px", "py").agg(F.count("pz").alias("n"), F.sum("pz").alias("sum"), F.min("pz").alias("pz"))
    # The number is given so that few bytes, which stand for many pairs, stay many tasks.
    tasks = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    j = targets.select("x", "y").repartition(tasks, "x", "y").distinct().join(k)
    # Not hypot: of stations at equal distances, sums of squares tell none apart by rounding.
    d = F.sqrt(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2))
    j = j.withColumn("d", d).withColumn("w", F.when(F.col("d") >= epsilon, F.pow(at_least(F.col("d"), epsilon), F.lit(-power))))
    if radius is not None:
        j = j.withColumn("w", F.when(F.col("d") <= radius, F.col("w")))
    at = j.groupBy("x", "y").agg(F.sum(F.col("w") * F.col("n")).alias("w"), F.sum(F.col("w") * F.col("sum")).alias("wz"), F.min(F.struct("d", "px", "py", "pz")).alias("n"))
    at = at.withColumnsRenamed({"x": "_x", "y": "_y"})
    g = targets.join(at, F.col("x").eqNullSafe(F.col("_x")) & F.col("y").eqNullSafe(F.col("_y"))).groupBy("id").agg(F.sum("w").alias("w"), F.sum("wz").alias("wz"), F.min("n").alias("n"))
    value = F.when(F.col("n.d") < epsilon, F.col("n.pz")).when(F.coalesce(F.col("w"), F.lit(0.0)) <= 0, F.col("n.pz")).otherwise(F.col("wz") / F.when(F.col("w") > 0, F.col("w")).otherwise(1.0))
    return g.select("id", value.alias("value"))


def _keys(x: Column, derivative: bool = False, a: float = -0.5) -> Column:
    """Keys' cubic convolution kernel."""
    t = F.abs(x)
    if derivative:
        inner, outer = 3 * (a + 2) * t * t - 2 * (a + 3) * t, 3 * a * t * t - 10 * a * t + 8 * a
        return F.when(x >= 0, 1.0).otherwise(-1.0) * F.when(t <= 1, inner).when(t < 2, outer).otherwise(0.0)
    inner, outer = (a + 2) * t * t * t - (a + 3) * t * t + 1, a * t * t * t - 5 * a * t * t + 8 * a * t - 4 * a
    return F.when(t <= 1, inner).when(t < 2, outer).otherwise(0.0)


def bicubic(points: DataFrame, cells: DataFrame, cell_x_m: float = 10.0, cell_y_m: float = 10.0, *keep: str) -> DataFrame:
    """Surface at points (id, gx, gy in cell units) from the 4 x 4 cells around: height, slope, aspect and curvature; ``keep`` names the columns that come along, id where none is named.

    Cells that are missing or null count as 0. Points of one cell share its surroundings: the different cells that points are in meet the 16 around each,
    and each point meets one row, so points themselves aren't multiplied; they are read twice. Points with columns cell_x_m and cell_y_m have cells of their own sizes.
    """
    own = [F.col(c).alias(f"_{c}") if c in points.columns else F.lit(float(v)).alias(f"_{c}") for c, v in (("cell_x_m", cell_x_m), ("cell_y_m", cell_y_m))]
    keep = keep or ("id",)
    around = range(-1, 3)
    # A write, as the join's filter for places would be moved to where points are made and work these out again.
    place = durable(points.select(F.floor("gx").alias("_c0"), F.floor("gy").alias("_r0")).distinct(), "places")
    wanted = place.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in around for i in around])).alias("_o"))
    wanted = wanted.select("_c0", "_r0", F.col("_o.i").alias("_i"), F.col("_o.j").alias("_j"), (F.col("_c0") + F.col("_o.i")).alias("col"), (F.col("_r0") + F.col("_o.j")).alias("row_"))
    met = wanted.join(cells.select("col", "row_", "value"), ["col", "row_"])
    z = [F.sum(F.when((F.col("_i") == i) & (F.col("_j") == j), F.col("value"))) for j in around for i in around]
    near = durable(met.groupBy("_c0", "_r0").agg(F.array(*[F.coalesce(c, F.lit(0.0)) for c in z]).alias("_z")), "surroundings")
    p = points.select(*keep, F.col("gx").alias("_gx"), F.col("gy").alias("_gy"), *own, F.floor("gx").alias("_c0"), F.floor("gy").alias("_r0")).join(near, ["_c0", "_r0"], "left")
    p = p.select(*keep, "_cell_x_m", "_cell_y_m", "_z", (F.col("_gx") - F.col("_c0")).alias("_u"), (F.col("_gy") - F.col("_r0")).alias("_v"))
    weights = {f"_{n}{i}": _keys(F.col(c) - i, slope) for n, c, slope in (("wx", "_u", False), ("dx", "_u", True), ("wy", "_v", False), ("dy", "_v", True)) for i in around}
    p = p.select(*keep, "_cell_x_m", "_cell_y_m", "_z", *[w.alias(n) for n, w in weights.items()])

    def total(x: str, y: str) -> Column:
        rows = []
        for n, j in enumerate(around):
            row = sum((F.coalesce(F.col("_z")[4 * n + m], F.lit(0.0)) * F.col(f"_{x}{i}") for m, i in enumerate(around)), F.lit(0.0))
            rows.append(row * F.col(f"_{y}{j}"))
        return sum(rows[1:], rows[0])

    g = p.select(*keep, "_cell_x_m", "_cell_y_m", total("wx", "wy").alias("elevation_m"), total("dx", "wy").alias("du"), total("wx", "dy").alias("dv"))
    g = g.select(*keep, "elevation_m", "du", "dv", *[(F.col(d) / at_least(F.col(c), 0.001)).alias(n) for d, c, n in (("du", "_cell_x_m", "dz_dx"), ("dv", "_cell_y_m", "dz_dy"))])
    g = g.withColumn("_m", F.hypot("dz_dx", "dz_dy"))
    curvature = (F.col("du") * F.col("du") + F.col("dv") * F.col("dv")) / at_least(F.pow(1 + F.col("_m") * F.col("_m"), F.lit(1.5)), 0.001)
    return g.select(
        *keep, "elevation_m", (F.col("_m") * 100.0).alias("slope_pct"), F.degrees(F.atan("_m")).alias("slope_degrees"), floor_mod(F.degrees(F.atan2(-F.col("dz_dx"), F.col("dz_dy"))), 360.0).alias("aspect_degrees"),
        "dz_dx", "dz_dy", curvature.alias("curvature"),
    )


def sample_raster(points: DataFrame, cells: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """Add ``value``: that of the cell (floor) a point (lon, lat) is in; null outside and where the raster has none."""
    p = points.withColumn("col", F.floor((F.col("lon") - x0) / dx)).withColumn("row_", F.floor((F.col("lat") - y0) / dy))
    return p.join(cells.select("col", "row_", "value"), ["col", "row_"], "left").drop("col", "row_")


def min_max(cells: DataFrame, key: str = "layer") -> DataFrame:
    """Cells with ``normal``: the value between its layer's least and most, 0 where these are equal."""
    e = cells.groupBy(key).agg(F.min("value").alias("_a"), F.max("value").alias("_z"))
    span = F.col("_z") - F.col("_a")
    return cells.join(e, key).withColumn("normal", F.when(span > 0, (F.col("value") - F.col("_a")) / F.when(span > 0, span).otherwise(1.0)).otherwise(F.when(F.col("value").isNotNull(), 0.0))).drop("_a", "_z")


def positions_at(traj: DataFrame, times: DataFrame) -> DataFrame:
    """(id, t, lon, lat, z): places of moving things (id, t, lon, lat, z) at the asked times (id, t), linear between, held at the ends.

    Both sides go through one window by id ordered by time, so no pair of them is ever made.
    """
    fields = ["t", "lon", "lat", "z"]
    known = traj.select("id", F.col("t").alias("t"), F.struct(*fields).alias("p"))
    both = known.unionByName(times.select("id", "t", F.lit(None).cast(known.schema["p"].dataType).alias("p")))
    w = Window.partitionBy("id").orderBy("t")
    before = F.last("p", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("p", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    q = both.select("id", "t", "p", before.alias("a"), after.alias("z")).where("p is null and (a is not null or z is not null)")
    q = q.select("id", "t", F.coalesce("a", "z").alias("a"), F.coalesce("z", "a").alias("z"))
    span = F.col("z.t") - F.col("a.t")
    f = F.when(span > 0, (F.col("t") - F.col("a.t")) / F.when(span > 0, span).otherwise(1.0)).otherwise(0.0)
    return q.select("id", "t", *[(F.col(f"a.{c}") + f * (F.col(f"z.{c}") - F.col(f"a.{c}"))).alias(c) for c in ("lon", "lat", "z")])
