"""Speeds, energies and comfort of people and vehicles on slopes, as Column expressions.

Slopes are fractions unless a name says percent; speeds are km/h unless it says m/s. All constants are fixed values of the models.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import at_least, clamp

G = 9.80665
#: Rolling resistance of tyres by surface.
ROLLING = {
    "asphalt": 0.004,
    "concrete": 0.005,
    "paved": 0.006,
    "paving_stones": 0.012,
    "cobblestone": 0.018,
    "gravel": 0.022,
    "compacted": 0.015,
    "dirt": 0.03,
    "ground": 0.035,
    "grass": 0.045,
    "sand": 0.08,
}


def tobler_speed(slope: Column, base: Column | float) -> Column:
    base = base if isinstance(base, Column) else F.lit(float(base))
    s = clamp(slope, -0.6, 0.6)
    return clamp(6.0 * F.exp(-3.5 * F.abs(s + 0.05)) * at_least(base / 5.0, 0.2), 0.5, 8.0)


def minetti_joules(slope: Column, mass: float, metres: Column) -> Column:
    """Energy of walking; the polynomial is in J per kg and metre and at least 0.6."""
    s = clamp(slope, -0.5, 0.5)
    cost = 280.5 * F.pow(s, 5) - 58.7 * F.pow(s, 4) - 76.8 * F.pow(s, 3) + 51.9 * F.pow(s, 2) + 19.6 * s + 2.5
    return at_least(cost, 0.6) * mass * metres


def running_cost(slope: Column) -> Column:
    """J per kg and metre of running, at least 1.8."""
    s = clamp(slope, -0.45, 0.45)
    return at_least(155.4 * F.pow(s, 5) - 30.4 * F.pow(s, 4) - 43.3 * F.pow(s, 3) + 46.3 * F.pow(s, 2) + 19.5 * s + 3.6, 1.8)


def senior_fatigue(metres: Column, climb: Column) -> Column:
    return clamp(F.exp(-0.35 * (0.12 * metres / 1000.0 + 0.25 * climb / 100.0)), 0.45, 1.0)


def drag_power(speed_ms: Column, area: float = 0.55, cd: float = 0.88, rho: float = 1.225) -> Column:
    return 0.5 * rho * cd * area * F.pow(speed_ms, 3)


def rolling_force(slope: Column, mass: float, surface: Column | None = None) -> Column:
    crr = F.lit(0.005)
    if surface is not None:
        crr = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLLING.items() for x in kv]), F.lower(surface)), crr)
    return crr * mass * G * F.cos(F.atan(F.abs(slope)))


def cyclist_speed(slope: Column, base: float | Column, mass: float = 85.0, watts: float = 160.0) -> Column:
    base = base if isinstance(base, Column) else F.lit(float(base))
    s = clamp(slope, -0.25, 0.25)
    force = mass * G * F.sin(F.atan(s)) + rolling_force(s, mass)
    up = clamp(watts / at_least(force, 1.0) * 3.6, F.lit(3.5), base * 1.5)
    return F.when(s < -0.02, F.least(F.lit(45.0), base * (1 + 2.2 * F.abs(s)))).otherwise(up)


def cycling_joules(slope: Column, mass: float, metres: Column, bike: float = 15.0) -> Column:
    """Metabolic energy at 24 % efficiency, at the speed of an 18 km/h rider."""
    s = clamp(slope, -0.3, 0.3)
    v = at_least(cyclist_speed(s, 18.0, mass + bike) / 3.6, 0.1)
    force = (mass + bike) * G * F.sin(F.atan(s)) + rolling_force(s, mass + bike) + drag_power(v) / v
    return at_least(force, 0.0) * metres / 0.24


def scooter_speed(slope: Column, base: float | Column) -> Column:
    base = base if isinstance(base, Column) else F.lit(float(base))
    s = clamp(slope, -0.2, 0.2)
    up = at_least(base * at_least(1 - F.pow(at_least(s, 0.0) / 0.14, 1.5), 0.25), 4.0)
    down = F.least(F.lit(25.0), base * (1 + 0.5 * F.abs(s)))
    return F.when(s > 0.12, 4.0).when(s > 0, up).otherwise(down)


def vehicle_speed(rank: Column, lanes: Column, slope_percent: Column, base: Column | float) -> Column:
    base = base if isinstance(base, Column) else F.lit(float(base))
    free = F.when(rank == 1, 80.0).when(rank == 2, 60.0).when(rank == 3, 45.0).when(rank == 4, 30.0).otherwise(20.0)
    free = free * base / 50.0 + F.least(F.lit(10.0), 4.0 * at_least(lanes - 2.0, 0.0))
    return at_least(free * at_least(1 - 0.85 * F.least(F.lit(35.0), F.abs(slope_percent)) / 100.0, 0.5), 10.0)


def solar_aspect(elevation_deg: Column, azimuth_deg: Column, slope_deg: Column, aspect_deg: Column) -> Column:
    """Share of direct light on a slope."""
    el, sl = F.radians(elevation_deg), F.radians(slope_deg)
    return clamp(F.sin(el) * F.cos(sl) + F.cos(el) * F.sin(sl) * F.cos(F.radians(azimuth_deg - aspect_deg)), 0, 1)


def thermal_stress(air_c: Column, radiant_c: Column, wind_ms: Column) -> Column:
    """Heat load from 0 to 1."""
    return clamp((air_c + 0.33 * (radiant_c - air_c) - 0.7 * F.sqrt(at_least(wind_ms, 0.1)) - 18.0) / 20.0, 0, 1)
