"""Checks of boxes, waypoints and values, as Columns: a row that fails says why instead of stopping the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import finite_or

MOST_WAYPOINTS = 500


def finite_number(c: Column, default: float | None = 0.0) -> Column:
    """The value as a finite double; ``default`` for what is no number."""
    return finite_or(c.try_cast("double"), default)


def value_at(values: Column, i: Column) -> Column:
    """The element at ``i`` from 0; null outside."""
    return F.try_element_at(values, (i + 1).cast("int"))


def normal_box(lon1: Column, lat1: Column, lon2: Column, lat2: Column, least_span: float = 0.005) -> Column:
    """A struct (lon1, lat1, lon2, lat2, problem): sides in order and at least ``least_span`` wide; problem says what can't be mended, else null."""
    span = max(0.0001, least_span)
    four = [finite_or(c, None) for c in (lon1, lat1, lon2, lat2)]
    bad = four[0].isNull() | four[1].isNull() | four[2].isNull() | four[3].isNull()

    def side(a: Column, b: Column) -> tuple[Column, Column]:
        low, high = F.least(a, b), F.greatest(a, b)
        narrow, middle = high - low < span, (low + high) / 2
        return F.when(narrow, middle - span / 2).otherwise(low), F.when(narrow, middle + span / 2).otherwise(high)

    (x1, x2), (y1, y2) = side(four[0], four[2]), side(four[1], four[3])
    problem = (
        F.when(bad, "invalid coordinates")
        .when((F.abs(four[0]) > 180) | (F.abs(four[2]) > 180), "longitude out of range")
        .when((F.abs(four[1]) > 90) | (F.abs(four[3]) > 90), "latitude out of range")
    )
    ok = lambda c: F.when(problem.isNull(), c)
    return F.struct(ok(x1).alias("lon1"), ok(y1).alias("lat1"), ok(x2).alias("lon2"), ok(y2).alias("lat2"), problem.alias("problem"))


def waypoint_problems(waypoints: DataFrame, key: str) -> DataFrame:
    """(key, n, problem) of lists of waypoints (key, seq, lon, lat): the first problem of each list, null for none."""
    lon, lat = finite_or(F.col("lon"), None), finite_or(F.col("lat"), None)
    wrong = F.when(lon.isNull() | lat.isNull(), "invalid coordinates").when((F.abs(lon) > 180) | (F.abs(lat) > 90), "out of range")
    g = waypoints.withColumn("_wrong", wrong).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("_wrong").isNotNull(), F.struct("seq", "_wrong"))).alias("w")
    )
    told = F.format_string("waypoint %s: %s", F.col("w.seq").cast("string"), F.col("w._wrong"))
    return g.select(key, "n", F.when(F.col("n") > MOST_WAYPOINTS, f"over {MOST_WAYPOINTS} waypoints").when(F.col("w").isNotNull(), told).alias("problem"))
