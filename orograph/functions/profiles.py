"""Mobility profiles, and the cost and time of network edges under them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kinematics
from .numbers import INF, at_least, clamp, finite_or

#: Key, category, km/h, steepest %, stairs allowed, stair penalty, sensitivities to slope and heat, preference for green,
#: smoothness wanted, and the weights of road ranks 1 to 5.
TABLE = """
adult        pedestrian    5.0 25 1 1.2  1.0 .40 .40 .20 2.5 1.8 1.2 1.0 0.9
senior       pedestrian    3.2 10 1 8    2.8 .85 .90 .60 4.0 2.5 1.5 1.0 0.8
child        pedestrian    3.5 12 1 2    1.5 .70 .80 .40 8.0 4.0 1.8 1.0 0.7
stroller     pedestrian    4.0  6 0 100  3.0 .60 .70 .80 3.5 2.0 1.3 1.0 0.9
wheelchair   pedestrian    3.8  5 0 1000 4.0 .60 .60 .90 3.0 1.8 1.2 1.0 0.9
jogger       pedestrian    9.5 20 1 1.5  0.8 .60 .85 .30 6.0 3.0 1.5 1.0 0.7
bicycle      micromobility 18  15 0 50   1.8 .30 .50 .60 10  1.6 1.1 0.9 1.0
mtb          micromobility 16  28 1 5    0.9 .20 .80 .10 15  2.0 1.2 0.9 0.6
scooter      micromobility 20  12 0 100  2.5 .30 .30 .85 10  2.0 1.2 0.9 1.0
car          vehicle       50  25 0 1000 0.5 0   0   .50 0.6 0.8 1.0 1.5 2.5
delivery_van vehicle       42  18 0 1000 0.9 0   0   .60 0.7 0.8 1.0 1.2 2.0
truck        vehicle       40   7 0 1000 3.5 0   0   .70 0.5 0.7 1.2 3.0 10
paramedic    vehicle       65  22 0 1000 0.4 0   0   .40 0.5 0.6 0.8 1.0 1.5
sightseer    pedestrian    4.2 20 1 1    0.5 .40 1.0 .30 8.0 4.0 2.0 1.0 0.6
night_walk   pedestrian    4.8 15 1 3    1.2 0   .20 .70 1.2 1.0 1.0 1.4 4.0
"""
_FIELDS = ["key", "category", "base_kmh", "max_slope_pct", "stairs", "stair_penalty", "slope_w", "heat_w", "green_w", "smooth", "h1", "h2", "h3", "h4", "h5"]


def profiles() -> dict[str, dict]:
    rows = [line.split() for line in TABLE.strip().splitlines()]
    return {r[0]: dict(zip(_FIELDS, [r[0], r[1], *map(float, r[2:])], strict=True)) for r in rows}


def resolve(key: str | dict, strict: bool = True) -> dict:
    """A profile by name, in whatever case; a dict is one already. Unknown names fail, or are ``adult`` where not strict."""
    if isinstance(key, dict):
        return key
    found = profiles().get(key.strip().lower())
    if found is None and strict:
        raise ValueError(f"unknown profile {key!r}; known: {', '.join(profiles())}")
    return found or profiles()["adult"]


#: Names of a profile's values in preset files; hierarchy_weights has those of ranks 1 to 5.
_JSON = {
    "key": "key", "category": "category", "base_speed_kmh": "base_kmh", "max_slope_pct": "max_slope_pct", "stair_penalty": "stair_penalty", "slope_sensitivity": "slope_w", "heat_sensitivity": "heat_w",
    "green_preference": "green_w", "surface_smoothness_req": "smooth",
}


def to_json(profile: str | dict) -> str:
    """A profile as the text of a preset file."""
    p = resolve(profile)
    told = {name: p[own] for name, own in _JSON.items()} | {"stair_allowed": bool(p["stairs"]), "hierarchy_weights": {str(i): p[f"h{i}"] for i in range(1, 6)}}
    return json.dumps(told, indent=2)


def from_json(text: str) -> dict:
    """The profile of a preset file's text, for wherever a profile is asked for. What is missing is as in ``adult``, but for key and category; other entries, as names and icons, are passed over."""
    given = json.loads(text)
    if not isinstance(given, dict) or not {"key", "category"} <= set(given):
        raise ValueError("a preset is an object with key and category at least")
    base = profiles()["adult"]
    out = base | {own: (str if own in ("key", "category") else float)(given[name]) for name, own in _JSON.items() if name in given}
    if "stair_allowed" in given:
        out["stairs"] = float(bool(given["stair_allowed"]))
    return out | {f"h{i}": float(given.get("hierarchy_weights", {}).get(str(i), base[f"h{i}"])) for i in range(1, 6)}


def profile_table(spark: SparkSession) -> DataFrame:
    """All profiles as rows, to join a sweep with."""
    return spark.createDataFrame([tuple(p[f] for f in _FIELDS) for p in profiles().values()], _FIELDS)


def group(name: str) -> list[str]:
    return [k for k, p in profiles().items() if p["category"] == name]


def hierarchy(highway: Column) -> Column:
    """Rank 1 to 5 of a road by its highway tag."""
    h = F.lower(F.trim(highway))
    return (
        F.when(h.isin("motorway", "trunk", "motorway_link", "trunk_link"), 1).when(h == "primary", 2).when(h.isin("secondary", "tertiary"), 3)
        .when(h.isin("residential", "living_street", "unclassified"), 4).otherwise(5)
    )


#: The weights of criteria that routing gives every profile: slope, heat and green of 3.8 in all.
DEFAULT_WEIGHTS = {"slope": 1 / 3.8, "heat": 0.5 / 3.8, "green": 0.5 / 3.8}


def normalised_weights(distance: float = 1.0, slope: float = 1.0, heat: float = 0.5, green: float = 0.5, safety: float = 0.5, solar: float = 0.3) -> dict[str, float]:
    """Six weights as shares of their sum; fixed ones where the sum isn't positive."""
    w = dict(distance=distance, slope=slope, heat=heat, green=green, safety=safety, solar=solar)
    total = sum(w.values())
    return {k: v / total for k, v in w.items()} if total > 0 else dict(distance=0.3, slope=0.2, heat=0.15, green=0.15, safety=0.1, solar=0.1)


def impedance(p: dict, length: Column, slope_pct: Column, steps: Column, surface: Column, rank: Column, lst: Column | None = None, green: Column | None = None, weights: dict | None = None) -> Column:
    """Generalised metres of an edge for a profile, infinite where it can't pass. Missing heat and green leave the cost alone."""
    w = weights if weights is not None else DEFAULT_WEIGHTS
    ws, wh, wg = w.get("slope", p["slope_w"]), w.get("heat", p["heat_w"]), w.get("green", p["green_w"])
    s, top = F.abs(slope_pct), max(1.0, p["max_slope_pct"])
    steep = F.lit(INF) if p["category"] != "pedestrian" else 1.0 + F.pow(s / top, 3) * 20.0 * ws
    by_slope = F.when(s > top, steep).otherwise(1.0 + s / 10.0 * ws * 1.5)
    by_steps = F.when(steps, max(1.0, p["stair_penalty"]) if p["stairs"] else INF).otherwise(1.0)
    quality = F.when(surface == "asphalt", 0.9).otherwise(0.4)
    by_surface = F.when(quality < p["smooth"], 1.0 + (p["smooth"] - quality) * 4.0).otherwise(1.0)
    by_heat = F.lit(1.0)
    if lst is not None or green is not None:
        hot = clamp(finite_or(lst, None), 0, 1) * wh * 1.8 if lst is not None else F.lit(None).cast("double")
        cool = clamp(finite_or(green, None), 0, 1) * wg * 0.4 if green is not None else F.lit(None).cast("double")
        by_heat = F.when(hot.isNull() & cool.isNull(), 1.0).otherwise(at_least(1.0 + F.coalesce(hot, F.lit(0.0)) - F.coalesce(cool, F.lit(0.0)), 0.6))
    by_rank = F.when(rank == 1, p["h1"]).when(rank == 2, p["h2"]).when(rank == 3, p["h3"]).when(rank == 4, p["h4"]).when(rank == 5, p["h5"]).otherwise(1.0)
    return at_least(at_least(length, 0.01) * by_slope * by_steps * by_surface * by_heat * by_rank, 0.01)


def travel_seconds(p: dict, length: Column, slope_pct: Column, rank: Column) -> Column:
    s = slope_pct / 100.0
    if p["category"] == "pedestrian":
        kmh = kinematics.tobler_speed(s, p["base_kmh"])
    elif p["key"] in ("bicycle", "mtb"):
        kmh = kinematics.cyclist_speed(s, p["base_kmh"])
    elif p["key"] == "scooter":
        kmh = kinematics.scooter_speed(s, p["base_kmh"])
    else:
        kmh = kinematics.vehicle_speed(rank, F.lit(2), slope_pct, p["base_kmh"])
    return length / at_least(kmh / 3.6, 0.2)
