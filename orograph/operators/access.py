"""Spatial equity: two-step floating catchments, Lorenz curve, Gini, Theil and Palma figures, and tiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import durable
from ..functions.numbers import at_least, clamp
from .spatial import within


def decay(d: Column, radius: float) -> Column:
    edge = math.exp(-0.5)
    return F.when(d > radius, 0.0).otherwise(at_least((F.exp(-0.5 * F.pow(d / radius, 2)) - edge) / (1 - edge), 0.0))


def catchment_scores(zones: DataFrame, facilities: DataFrame, radius: float = 3000.0, distances: DataFrame | None = None) -> DataFrame:
    """Zones (zone_id, lon, lat, population) with ``score``. ``distances`` (zone_id, facility_id, dist_m) replaces great circles.

    One join of both sides serves both steps.
    """
    if distances is None:
        f = facilities.select("facility_id", F.col("lon").alias("tlon"), F.col("lat").alias("tlat"))
        distances = within(zones.select("zone_id", "lon", "lat"), f, radius).select("zone_id", "facility_id", "dist_m")
    w = distances.where(F.col("dist_m") <= radius).select("zone_id", "facility_id", decay(F.col("dist_m"), radius).alias("w"))
    demand = w.join(zones.select("zone_id", "population"), "zone_id").groupBy("facility_id").agg(F.sum(F.col("population") * F.col("w")).alias("demand"))
    ratio = F.when(F.col("demand") > 0, F.col("capacity") / F.when(F.col("demand") > 0, F.col("demand")).otherwise(1.0)).otherwise(0.0)
    ratios = demand.join(facilities.select("facility_id", "capacity"), "facility_id").select("facility_id", ratio.alias("ratio"))
    scores = w.join(ratios, "facility_id").groupBy("zone_id").agg(F.sum(F.col("ratio") * F.col("w")).alias("score"))
    return zones.join(scores, "zone_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def ranked(scored: DataFrame) -> DataFrame:
    """Zones in order of score (then zone_id) with rank, n, shares so far, percentile and tier.

    Zones are dealt by ranges of the score and written once, so that ranges stay as they are. Ranks and sums run within a range; a table of one row a
    range says what comes before it. Equal scores may span ranges, as zone_id takes part in the order.
    """
    weighted = F.col("population") * F.col("score")
    q = scored.select("zone_id", "population", "score").repartitionByRange("score", "zone_id").withColumn("_range", F.spark_partition_id())
    q = durable(q, "ranges")
    sums = q.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.sum("population").alias("_p"), F.sum(weighted).alias("_a"))
    every = Window.orderBy("_range")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = every.rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("_n", "_p", "_a")]
    sums = sums.select("_range", *before, F.sum("_n").over(whole).alias("n"), *[F.sum(c).over(whole).alias(f"{c}1") for c in ("_p", "_a")])
    w = Window.partitionBy("_range").orderBy("score", "zone_id")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    share = lambda c, of: (F.col(f"{of}0") + F.sum(c).over(run)) / F.when(F.col(f"{of}1") == 0, 1.0).otherwise(F.col(f"{of}1"))
    q = q.join(sums, "_range").select(
        "zone_id", "population", "score", (F.col("_n0") + F.row_number().over(w)).alias("rank"), "n",
        share(F.col("population"), "_p").alias("pop_share"), share(weighted, "_a").alias("acc_share"),
    )
    q = durable(q.withColumn("percentile", F.col("rank") / F.col("n") * 100.0), "ranks")
    middle = q.where(F.col("rank") == F.floor(F.col("n") / 2) + 1).select("score").first()
    median = F.lit(middle[0] if middle else None).cast("double")
    tier = F.when(F.col("score") <= 0.0001, "Transit Desert").when(F.col("score") < median * 0.5, "Underserved").when(F.col("score") < median * 1.5, "Adequate").otherwise("Mobility Oasis")
    return q.withColumn("median", median).withColumn("tier", tier)


def lorenz(r: DataFrame) -> DataFrame:
    """(rank, pop_share, acc_share) samples of the curve, about twenty, with its start at rank 0."""
    every = F.greatest(F.lit(1), F.floor(F.col("n") / 20))
    kept = r.where(((F.col("rank") - 1) % every == 0) | (F.col("rank") == F.col("n"))).select("rank", "pop_share", "acc_share")
    start = r.where("rank = 1").select(F.lit(0).cast("long").alias("rank"), F.lit(0.0).alias("pop_share"), F.lit(0.0).alias("acc_share"))
    return start.unionByName(kept)


def scorecard(r: DataFrame) -> DataFrame:
    """One row: gini, palma, theil, mean and median score, and zones in each tier. No zone: no figures.

    All are sums over zones. A step of the curve is a zone's share of the population, and the curve's height before it is the height
    after it less the zone's own share.
    """
    weighted, score = F.col("population") * F.col("score"), F.col("score")
    tiers = [("Transit Desert", "deserts"), ("Underserved", "underserved"), ("Adequate", "adequate"), ("Mobility Oasis", "oases")]
    s = r.agg(
        F.sum("population").alias("pop"), F.sum(weighted).alias("acc"), F.sum(F.col("population") * F.col("acc_share")).alias("heights"), F.sum(F.col("population") * weighted).alias("steps"),
        F.sum(F.when(score > 0, weighted)).alias("some"), F.sum(F.when(score > 0, weighted * F.ln(score))).alias("logs"),
        F.sum(F.when(F.col("percentile") <= 40, weighted).otherwise(0.0)).alias("low"), F.sum(F.when(F.col("percentile") >= 90, weighted).otherwise(0.0)).alias("high"),
        F.max("median").alias("median_score"), *[F.count_if(F.col("tier") == t).alias(n) for t, n in tiers],
    )
    one = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(F.col(c))
    s = s.withColumn("mean_score", one("acc") / one("pop"))
    mean = F.col("mean_score")
    theil = F.when(mean > 0, (F.coalesce("logs", F.lit(0.0)) - F.coalesce("some", F.lit(0.0)) * F.ln(F.when(mean > 0, mean).otherwise(1.0))) / F.when(mean > 0, mean * one("pop")).otherwise(1.0))
    return s.select(
        clamp(1 - (2 * F.col("heights") - F.col("steps") / one("acc")) / one("pop"), 0, 1).alias("gini"), F.when(F.col("low") > 0, F.col("high") / at_least(F.col("low"), 0.001)).otherwise(1.0).alias("palma"),
        F.when(F.col("pop").isNotNull(), at_least(F.coalesce(theil, F.lit(0.0)), 0.0)).alias("theil"), "mean_score", "median_score", *[n for _, n in tiers],
    )
