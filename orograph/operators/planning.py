"""Decision weights, tours, straight-line evacuation, air corridors, clearances and landing zones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import at_least, clamp

#: Random consistency indices of 1 to 10 criteria; 1.49 beyond.
RANDOM_INDEX = [0.0, 0.0, 0.58, 0.90, 1.12, 1.24, 1.32, 1.41, 1.45, 1.49]


def ahp(matrix: DataFrame) -> DataFrame:
    """Per decision: weights of criteria from pairwise comparisons (decision, i, j, a), and how consistent they are.

    Comparisons are clamped to 1/9..9; (decision, i, weight, lambda_max, consistency_index, consistency_ratio, is_consistent).
    """
    # Dealt by decision once: all windows and sums below are within a decision.
    m = matrix.repartition("decision").withColumn("a", clamp(F.col("a"), 1 / 9, 9))
    of_row, of_all = Window.partitionBy("decision", "i"), Window.partitionBy("decision")
    m = m.withColumn("share", F.col("a") / F.sum("a").over(Window.partitionBy("decision", "j")))
    m = m.withColumn("weight", F.avg("share").over(of_row)).withColumn("n", F.count(F.lit(1)).over(of_row))
    m = m.withColumn("by_criterion", F.map_from_entries(F.collect_set(F.struct("i", "weight")).over(of_all)))
    w = m.groupBy("decision", "i").agg(F.max("weight").alias("weight"), F.max("n").alias("n"), F.sum(F.col("a") * F.try_element_at("by_criterion", F.col("j"))).alias("aw"))
    lam = w.withColumn("lambda_max", F.avg(F.col("aw") / F.col("weight")).over(of_all)).withColumn("n", F.max("n").over(of_all))
    ci = F.when(F.col("n") > 1, (F.col("lambda_max") - F.col("n")) / at_least(F.col("n") - 1.0, 1.0)).otherwise(0.0)
    ri = F.coalesce(F.try_element_at(F.lit(RANDOM_INDEX), F.col("n").cast("int")), F.lit(1.49))
    lam = lam.withColumn("consistency_index", ci).withColumn("consistency_ratio", F.when(ri > 0, F.col("consistency_index") / F.when(ri > 0, ri).otherwise(1.0)).otherwise(0.0))
    names = ["decision", "i", "weight", "lambda_max", "consistency_index", "consistency_ratio"]
    return lam.select(*names, (F.col("consistency_ratio") <= 0.1).alias("is_consistent"))


#: Pairs of places of a tour that are looked at at once.
_PAIRS = 1 << 16


def tour_order(points: DataFrame) -> DataFrame:
    """(tour_id, seq, position) of each tour's stops (tour_id, seq, lon, lat): nearest neighbour from the first, then 2-opt until no reversal gains over 1 cm.

    Stops at one place follow each other, as there is no way between them, and no reversal that parts them gains; so the places of a tour are ordered, a group, and its stops are
    numbered within them. Its different places are at most some thousands by the rule for waypoints.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        lon, lat = np.radians(pdf["lon"].to_numpy()), np.radians(pdf["lat"].to_numpy())
        n, flip = len(pdf), np.zeros(len(pdf), bool)

        def metres(i, k):
            a = np.sin((lat[i] - lat[k]) / 2) ** 2 + np.cos(lat[i]) * np.cos(lat[k]) * np.sin((lon[i] - lon[k]) / 2) ** 2
            return 2 * 6371008.8 * np.arcsin(np.sqrt(np.clip(a, 0, 1)))

        order, left = [0], np.arange(1, n)
        while len(left):
            k = int(np.argmin(metres(order[-1], left)))
            order.append(int(left[k]))
            left = np.delete(left, k)

        def first_gain(rows: range, low: int, high: int) -> tuple[int, int] | None:
            """Of the reversals i to k that shorten the tour, with i of ``rows`` and k from ``low`` (i + 1 at least) to under ``high``, the one of the least i, then k."""
            at, wide = rows.start, 1
            while at < rows.stop:
                i = np.arange(at, min(rows.stop, at + wide))[:, None]
                k = np.arange(max(low, at + 1), high)[None]
                on = np.where(k + 1 < n, metres(order[i], order[np.minimum(k + 1, n - 1)]), 0.0)
                gains = (step[i - 1] + step[k] - metres(order[i - 1], order[k]) - on > 0.01) & (k > i)
                if gains.any():
                    row = int(gains.any(axis=1).argmax())
                    return at + row, int(k[0, gains[row].argmax()])
                at, wide = at + wide, min(2 * wide, max(1, _PAIRS // max(1, high - low)))
            return None

        # No reversal that begins before ``i`` shortens the tour. After one, those before it can only gain with an end in what was turned or at its edges.
        i, order = 1, np.array(order)
        step = np.append(metres(order[:-1], order[1:]), 0.0)
        while found := first_gain(range(i, n - 1), i + 1, n):
            while found:
                i, k = found
                order[i : k + 1] = order[i : k + 1][::-1]
                flip[order[i : k + 1]] ^= True
                step[i - 1 : min(k + 1, n - 1)] = metres(order[i - 1 : min(k + 1, n - 1)], order[i : k + 2])
                found = first_gain(range(1, i), i - 1, k + 1)
        before = np.empty(n, int)
        before[order] = np.cumsum(pdf["stops"].to_numpy()[order]) - pdf["stops"].to_numpy()[order]
        return pdf[["tour_id", "lon", "lat"]].assign(before=before, flip=flip)

    p = points.select("tour_id", "seq", "lon", "lat")
    places = p.groupBy("tour_id", "lon", "lat").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("stops"))
    sizes = places.groupBy("tour_id").agg(F.sum("stops").alias("all"))
    # The number is given so that few bytes stay many tasks.
    dealt = places.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tour_id")
    found = dealt.groupBy("tour_id").applyInPandas(solve, "tour_id long, lon double, lat double, before long, flip boolean")
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in ("tour_id", "lon", "lat")]
    at = places.join(found, same(places, found)).select(*[places[c].alias(f"_{c}") for c in ("tour_id", "lon", "lat")], "stops", "before", "flip")
    at = at.join(sizes, F.col("_tour_id").eqNullSafe(F.col("tour_id"))).drop("tour_id")
    p = p.withColumn("k", F.row_number().over(Window.partitionBy("tour_id", "lon", "lat").orderBy("seq")) - 1)
    p = p.join(at, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("tour_id", "lon", "lat")])
    long = p.where(F.col("all") > 3).select("tour_id", "seq", (F.col("before") + F.when(F.col("flip"), F.col("stops") - 1 - F.col("k")).otherwise(F.col("k"))).cast("int").alias("position"))
    short = p.where(F.col("all") <= 3).select("tour_id", "seq", (F.row_number().over(Window.partitionBy("tour_id").orderBy("seq")) - 1).alias("position"))
    return long.unionByName(short)


def evacuate(origins: DataFrame, musters: DataFrame, hazards: DataFrame, walk_kmh: float = 4.5, sample_m: float = 100.0) -> DataFrame:
    """Per origin (origin_id, x, y, z, population): the best muster point (muster_id, x, y, z) past the hazards (hx, hy, radius).

    Straight lines are sampled; every line from an origin to a muster is held against every hazard. Of musters at one place the least counts, of hazards the widest, and
    a line is measured once, so pairs are of different places.
    """
    m = musters.groupBy(F.col("x").alias("mx"), F.col("y").alias("my"), F.col("z").alias("mz")).agg(F.min("muster_id").alias("muster_id"))
    hazards = hazards.groupBy("hx", "hy").agg(F.max(F.when(~F.isnan("radius"), F.col("radius"))).alias("radius"))
    p = origins.join(m)
    dx, dy, dz = F.col("mx") - F.col("x"), F.col("my") - F.col("y"), F.col("mz") - F.col("z")
    p = p.withColumn("d", F.sqrt(dx * dx + dy * dy)).withColumn("d3", F.sqrt(dx * dx + dy * dy + dz * dz)).withColumn("gain", at_least(dz, 0.0))
    line = ["x", "y", "mx", "my"]
    # The number is given so that few bytes, which stand for many pairs, stay many tasks.
    tasks = int(origins.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = p.select(*line, "d").repartition(tasks, *line).distinct()
    s = s.withColumn("steps", F.greatest(F.lit(2), F.floor(F.col("d") / sample_m).cast("int"))).select("*", F.explode(F.sequence(F.lit(0), F.col("steps"))).alias("k"))
    f = F.col("k") / F.col("steps")
    s = s.select(*line, (F.col("x") + f * (F.col("mx") - F.col("x"))).alias("sx"), (F.col("y") + f * (F.col("my") - F.col("y"))).alias("sy"))
    c = s.join(hazards).groupBy(*line).agg(F.min(F.hypot(F.col("sx") - F.col("hx"), F.col("sy") - F.col("hy")) - F.col("radius")).alias("clearance"))
    p = p.join(c, line, "left").withColumn("clearance", F.coalesce("clearance", F.lit(9999.0)))
    score = F.col("d3") + F.when(F.col("clearance") < 0, 10000.0).otherwise(1000.0 / at_least(F.col("clearance"), 1.0))
    best = p.withColumn("score", score).groupBy("origin_id").agg(F.min(F.struct("score", "muster_id", "d3", "d", "gain", "clearance")).alias("b"))
    slow = at_least(1.0 - 2.0 * F.col("b.gain") / at_least(F.col("b.d"), 1.0), 0.5)
    return best.select(
        "origin_id", F.col("b.muster_id").alias("muster_id"), F.col("b.d3").alias("distance_m"), F.col("b.gain").alias("gain_m"), (F.col("b.d3") / (walk_kmh / 3.6 * slow) / 60.0).alias("minutes"),
        F.col("b.clearance").alias("clearance_m"), (F.col("b.clearance") > 50.0).alias("is_safe"),
    )


def evacuation_summary(plan: DataFrame, origins: DataFrame) -> DataFrame:
    """One row over ``evacuate``'s plan: population, mean_minutes, max_minutes, and the muster point that takes most people (of ties the least id).

    ``origins`` are (origin_id, population); a missing population is 50. All is added up before the shuffle; no row of the plan is collected.
    """
    people = F.coalesce("population", F.lit(50.0))
    total = origins.agg(F.coalesce(F.sum(people), F.lit(0.0)).alias("population"))
    times = plan.agg(F.coalesce(F.avg("minutes"), F.lit(0.0)).alias("mean_minutes"), F.coalesce(F.max("minutes"), F.lit(0.0)).alias("max_minutes"))
    use = plan.join(origins.select("origin_id", people.alias("n")), "origin_id").groupBy("muster_id").agg(F.sum("n").alias("n"))
    most = use.agg(F.min(F.struct((-F.col("n")).alias("n"), "muster_id")).alias("m")).select("m.muster_id")
    return total.join(times).join(most)


def drone_corridor(flights: DataFrame, buildings: DataFrame, cruise: float = 60.0, max_agl: float = 120.0, clearance: float = 25.0, speed_ms: float = 15.0, range_km: float = 18.0) -> DataFrame:
    """Per flight (flight_id, x0, y0, z0, x1, y1, z1): safe height over the buildings' boxes (bx0, by0, bx1, by1, height) it passes.

    Flights over one line look for buildings once, and of buildings with one box the highest counts.
    """
    h = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    p = flights.withColumn("h", h)
    line, box = ["x0", "y0", "x1", "y1"], ["bx0", "by0", "bx1", "by1"]
    s = flights.select(*line).distinct().withColumn("n", F.greatest(F.lit(5), F.floor(h / 20.0).cast("int"))).select("*", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("k"))
    f = F.col("k") / F.col("n")
    s = s.select(*line, (F.col("x0") + f * (F.col("x1") - F.col("x0"))).alias("sx"), (F.col("y0") + f * (F.col("y1") - F.col("y0"))).alias("sy"))
    size = 100.0
    cell = lambda low, high: F.explode(F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long")))
    b = buildings.groupBy(*box).agg(F.max("height").alias("height")).withColumn("cx", cell(F.col("bx0"), F.col("bx1"))).withColumn("cy", cell(F.col("by0"), F.col("by1")))
    s = s.withColumn("cx", F.floor(F.col("sx") / size).cast("long")).withColumn("cy", F.floor(F.col("sy") / size).cast("long"))
    hit = s.join(b, ["cx", "cy"]).where("sx between bx0 and bx1 and sy between by0 and by1").groupBy(*line).agg(F.max("height").alias("top"))
    p = p.join(hit, line, "left").withColumn("top", F.coalesce("top", F.lit(0.0)))
    z = F.least(F.col("z0") + max_agl, F.greatest(F.col("z0") + cruise, F.when(F.col("top") > 0, F.col("top") + clearance).otherwise(F.col("z0") + cruise)))
    free = F.when(F.col("top") > 0, cruise - F.col("top")).otherwise(cruise)
    d = (z - F.col("z0")) + F.col("h") + (z - F.col("z1"))
    battery = d / 1000.0 / max(1e-4, range_km) * 100.0
    return p.select("flight_id", d.alias("distance_m"), (d / speed_ms / 60.0).alias("minutes"), battery.alias("battery_pct"), free.alias("clearance_m"), ((battery <= 100.0) & (free >= 0)).alias("is_feasible"))


def truck_clearance(points: DataFrame, obstacles: DataFrame, height: float = 4.2, tons: float = 40.0, max_grade: float = 9.0, hazmat: bool = False, reach: float = 30.0) -> DataFrame:
    """Per route: slope violations of its steps, and obstacles (obstacle_id, ox, oy, max_height, max_tons, no_hazmat) it passes within reach.

    Obstacles that are alike and stand at the same places are one kind with a number. Points at one place count the kinds near it once; where a route's points are
    so far apart that no obstacle can be near two of them, its numbers are sums over its points; other routes, and those near a kind that stands at several places, list their kinds.
    """
    from .polylines import pairs

    w = Window.partitionBy("route_id").orderBy("seq")
    p = points.withColumn("last", F.lead("seq").over(w).isNull())
    steps = pairs(points, "x", "y", "z")
    h = F.hypot(F.col("x_next") - F.col("x"), F.col("y_next") - F.col("y"))
    slope = F.abs(F.col("z_next") - F.col("z")) / at_least(h, 1.0) * 100.0
    g = steps.groupBy("route_id").agg((F.sum(h) / 1000.0).alias("distance_km"), F.max(slope).alias("max_slope_pct"), F.count_if(slope > max_grade).alias("slope_violations"))
    cell = lambda c, o: F.floor(F.col(c) / reach).cast("long") + o
    alike, place, names = ["max_height", "max_tons", "no_hazmat"], ["x", "y"], ["height_violations", "weight_violations", "hazmat_violations"]
    kinds = obstacles.groupBy("obstacle_id", *alike).agg(F.array_sort(F.collect_set(F.struct("ox", "oy"))).alias("at")).groupBy(*alike, "at").agg(F.min("obstacle_id").alias("kind"), F.count(F.lit(1)).alias("n"))
    bad = [F.col("max_height") < height, F.col("max_tons") < tons, F.col("no_hazmat") & F.lit(hazmat)]
    kinds = kinds.select("at", (F.size("at") > 1).alias("spread"), F.struct("kind", *alike).alias("kind"), *[F.when(x, F.col("n")).otherwise(0).alias(k) for k, x in zip(names, bad, strict=True)]).where(" or ".join(f"{k} > 0" for k in names))
    near = kinds.select("kind", "spread", *names, F.inline("at")).select("*", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("i")).select("*", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("j"))
    near = near.withColumn("cx", cell("ox", F.col("i"))).withColumn("cy", cell("oy", F.col("j")))
    v = p.where(~F.col("last")).select("route_id", "x", "y")
    at = v.select(*place).distinct().select("*", cell("x", F.lit(0)).alias("cx"), cell("y", F.lit(0)).alias("cy"))
    hits = at.join(near, ["cx", "cy"]).where(F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) < reach).select(*place, "kind", "spread", *names).distinct()
    sums = hits.groupBy(*place).agg(*[F.sum(k).alias(k) for k in names], F.max("spread").alias("spread"))
    gap = F.col("x") - F.lag("x").over(Window.partitionBy("route_id").orderBy("x"))
    o = v.select("*", gap.alias("gap")).join(sums, place, "left").groupBy("route_id").agg(*[F.sum(k).alias(k) for k in names], F.min("gap").alias("gap"), F.max("spread").alias("spread"))
    dense = F.col("spread") | ((F.col("gap") < 2 * reach) & F.col("spread").isNotNull())
    listed = v.join(o.where(dense).select("route_id"), "route_id", "left_semi").join(hits, place).select("route_id", "kind", *names).distinct()
    o = o.where(~F.coalesce(dense, F.lit(False))).select("route_id", *names).unionByName(listed.groupBy("route_id").agg(*[F.sum(k).alias(k) for k in names]))
    out = g.join(o, "route_id", "left").select("*", *[F.coalesce(c, F.lit(0)).alias(f"_{c}") for c in names]).drop(*names).withColumnsRenamed({f"_{c}": c for c in names})
    return out.withColumn("is_feasible", sum(F.col(c) for c in ["slope_violations", *names]) == 0)


def landing_zones(sites: DataFrame, obstacles: DataFrame, ratio: float = 8.0, funnel_deg: float = 15.0, buffer_m: float = 30.0, reach: float = 500.0) -> DataFrame:
    """Per site (site_id, x, y, z): which of 8 approach headings are free of the obstacles (obstacle_id, ox, oy, oz).

    Sites at one place are looked at once, and obstacles that stand at the same places with the same tops are one kind with a number.
    """
    cell = lambda c, o: F.floor(F.col(c) / reach).cast("long") + o
    place = ["x", "y", "z"]
    kinds = obstacles.groupBy("obstacle_id").agg(F.array_sort(F.collect_set(F.struct("ox", "oy", "oz"))).alias("at")).groupBy("at").agg(F.min("obstacle_id").alias("kind"), F.count("obstacle_id").alias("n"))
    near = kinds.select("kind", "n", F.inline("at")).select("*", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("i")).select("*", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("j"))
    near = near.withColumn("cx", cell("ox", F.col("i"))).withColumn("cy", cell("oy", F.col("j"))).drop("i", "j")
    # The number is given so that few bytes, which stand for many pairs, stay many tasks.
    tasks = int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = sites.select(*place).repartition(tasks, *place).distinct().withColumn("cx", cell("x", F.lit(0))).withColumn("cy", cell("y", F.lit(0))).join(near, ["cx", "cy"])
    dx, dy = F.col("ox") - F.col("x"), F.col("oy") - F.col("y")
    p = p.withColumn("dist", F.hypot(dx, dy)).where(F.col("dist") <= reach).select("*", F.explode(F.sequence(F.lit(0), F.lit(315), F.lit(45))).alias("heading"))
    rad = F.radians(F.col("heading").cast("double"))
    dot = (F.sin(rad) * dx + F.cos(rad) * dy) / at_least(F.col("dist"), 1e-4)
    ceiling = F.col("z") + (F.col("dist") - buffer_m) / ratio
    over = F.when(F.col("dist") <= buffer_m, F.when(F.col("oz") > F.col("z") + 0.5, F.col("oz") - F.col("z"))).when(
        (F.degrees(F.acos(clamp(dot, -1, 1))) <= funnel_deg) & (F.col("oz") > ceiling), F.col("oz") - ceiling
    )
    p = p.withColumn("over", over).where("over is not null").groupBy(*place, "kind").agg(F.max("over").alias("over"), F.max("n").alias("n"), F.bit_or(F.expr("shiftleft(1, heading div 45)")).alias("headings"))
    blocked = p.groupBy(*place).agg(F.max("over").alias("max_intrusion_m"), F.sum("n").alias("critical_obstacles"), F.bit_count(F.bit_or("headings")).cast("long").alias("blocked"))
    out = sites.select("site_id", *place).join(blocked, place, "left")
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    out = out.select("site_id", zero("max_intrusion_m", 0.0).alias("max_intrusion_m"), zero("critical_obstacles", 0).alias("critical_obstacles"), (F.lit(8) - zero("blocked", 0)).alias("safe_headings"))
    return out.withColumn("is_safe", (F.col("safe_headings") > 0) & (F.col("max_intrusion_m") == 0))
