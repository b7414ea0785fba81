"""Spoken guidance along polylines: one instruction a vertex, by turn and slope, in three languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import at_least, rounded

#: What is said for each manoeuvre. %s is the approach in metres or the slope in per cent.
PHRASES = {
    "en": {
        "DEPART": "Start your route and proceed straight ahead.",
        "TURN_RIGHT": "In %s meters, turn right.",
        "TURN_LEFT": "In %s meters, turn left.",
        "STEEP_CLIMB": "Steep climb ahead: %s%% incline.",
        "STEEP_DESCENT": "Steep descent ahead: %s%% slope, control speed.",
        "STRAIGHT": "Continue straight.",
        "ARRIVE": "You have arrived at your destination.",
    },
    "de": {
        "DEPART": "Starten Sie Ihre Route und fahren Sie geradeaus.",
        "TURN_RIGHT": "In %s Metern rechts abbiegen.",
        "TURN_LEFT": "In %s Metern links abbiegen.",
        "STEEP_CLIMB": "Steiler Anstieg: %s%% Steigung.",
        "STEEP_DESCENT": "Steiles Gefälle: %s%%, Geschwindigkeit kontrollieren.",
        "STRAIGHT": "Geradeaus weiterfahren.",
        "ARRIVE": "Sie haben Ihr Ziel erreicht.",
    },
    "tr": {
        "DEPART": "Rotaya başlayın ve düz devam edin.",
        "TURN_RIGHT": "%s metre sonra sağa dönün.",
        "TURN_LEFT": "%s metre sonra sola dönün.",
        "STEEP_CLIMB": "Dik yokuş tırmanışı: %%%s eğim.",
        "STEEP_DESCENT": "Dik iniş: %%%s eğim, hızınızı kontrol edin.",
        "STRAIGHT": "Düz devam edin.",
        "ARRIVE": "Hedefinize ulaştınız.",
    },
}


def instructions(points: DataFrame, steep_pct: float = 10.0, turn_deg: float = 45.0) -> DataFrame:
    """(route_id, step, maneuver, distance_to_next_m, slope_percent, elevation_delta_m, text_en, text_de, text_tr) of polylines (route_id, seq, x, y, z) in metres.

    Steps count from 1 in order of seq. A turn is announced with the way to it, a slope with that of the leg after the vertex. Angles are
    compared to 9 decimals, so that right angles halved are no turns by rounding. Polylines of one vertex have no instruction.
    """
    w = Window.partitionBy("route_id").orderBy("seq")
    p = points.select("route_id", "seq", "x", "y", "z", *[F.lead(c).over(w).alias(f"{c}2") for c in "xyz"], *[F.lag(c).over(w).alias(f"{c}0") for c in "xy"], F.row_number().over(w).cast("long").alias("step"))
    p = p.where("x2 is not null or x0 is not null")
    after = F.coalesce(F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")), F.lit(0.0))
    climb = F.coalesce(F.col("z2") - F.col("z"), F.lit(0.0))
    angle = F.degrees(F.atan2(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")) - F.atan2(F.col("x") - F.col("x0"), F.col("y") - F.col("y0")))
    q = p.select(
        "route_id", "step", "x0", "x2", after.alias("distance_to_next_m"), climb.alias("elevation_delta_m"), (climb / at_least(after, 1.0) * 100.0).alias("slope_percent"),
        rounded(F.when(angle > 180, angle - 360).when(angle < -180, angle + 360).otherwise(angle), 9).alias("angle"), F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0")).alias("approach"),
    )
    kind = (
        F.when(F.col("x0").isNull(), "DEPART").when(F.col("x2").isNull(), "ARRIVE").when(F.col("angle") > turn_deg, "TURN_RIGHT").when(F.col("angle") < -turn_deg, "TURN_LEFT")
        .when(F.col("slope_percent") > steep_pct, "STEEP_CLIMB").when(F.col("slope_percent") < -steep_pct, "STEEP_DESCENT").otherwise("STRAIGHT")
    )
    q = q.withColumn("maneuver", kind)
    n = F.floor(F.when(F.col("maneuver").startswith("TURN"), F.col("approach")).otherwise(F.abs("slope_percent"))).cast("string")
    return q.select("route_id", "step", "maneuver", "distance_to_next_m", "slope_percent", "elevation_delta_m", *[_said(t, n).alias(f"text_{k}") for k, t in PHRASES.items()])


def _said(phrases: dict[str, str], number: Column) -> Column:
    out = None
    for kind, text in phrases.items():
        before, mark, rest = text.partition("%s")
        said = F.concat(F.lit(before.replace("%%", "%")), number, F.lit(rest.replace("%%", "%"))) if mark else F.lit(text)
        out = F.when(F.col("maneuver") == kind, said) if out is None else out.when(F.col("maneuver") == kind, said)
    return out
