"""Vehicle, terrain and infrastructure models over planar polylines and parameter rows.

Parameters are columns wherever rows have them, else Python numbers, so a sweep is a join. Every model is a projection, a window
over consecutive points with one groupBy, or, where state is clamped from step to step, a fold over a route's steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kinematics
from ..functions.numbers import at_least, clamp, floor_mod
from .polylines import along, planar_steps

#: Battery kWh, mass kg, drag coefficient, frontal area by vehicle.
EV_PRESETS = {"sedan": (75.0, 1950.0, 0.23, 2.3), "suv": (90.0, 2400.0, 0.29, 2.3), "van": (68.0, 2800.0, 0.34, 2.3), "bus": (350.0, 13500.0, 0.65, 7.5)}


def _c(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _lookup(table: dict[str, float], key: Column, default: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def _steps_of(steps: DataFrame, *columns: Column) -> DataFrame:
    """Each route's steps in order, as an array of structs ``s``."""
    return steps.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("seq", *columns))).alias("s"))


def ev_energy(points: DataFrame, preset: str = "sedan", soc: float = 90.0, crr: float = 0.01, drive: float = 0.9, regen: float = 0.75, aux_kw: float = 1.5, regen_kw: float = 60.0) -> DataFrame:
    """Battery energy of each route (speed_kmh at a step's first point): consumed, regenerated, final charge, where it ran out."""
    kwh, mass, cd, area = EV_PRESETS.get(preset.lower(), EV_PRESETS["sedan"])
    p = planar_steps(points).where("d > 1e-4")
    v = at_least(F.col("speed_kmh") / 3.6, 1.0)
    angle = F.atan2(F.col("dz"), at_least(F.col("h"), 1e-4))
    force = crr * mass * kinematics.G * F.cos(angle) + 0.5 * 1.225 * cd * area * v * v + mass * kinematics.G * F.sin(angle)
    p = p.select("route_id", "seq", "d", (F.col("d") / v).alias("t"), (force * v).alias("w"))
    aux = aux_kw * F.col("t") / 3600.0
    drawn = F.col("w") * F.col("t") / 3.6e6 / drive + aux
    recovered = F.least(F.lit(regen_kw), F.abs("w") / 1000.0) * F.col("t") / 3600.0 * regen * drive
    p = p.withColumn("use", F.when(F.col("w") >= 0, drawn).otherwise(aux - recovered))
    rows = _steps_of(p, F.col("d"), F.col("t"), F.col("use"))
    start = F.struct(F.lit(kwh * soc / 100.0).alias("b"), F.lit(0.0).alias("d"), F.lit(None).cast("double").alias("out"))

    def step(a: Column, x: Column) -> Column:
        b, d = clamp(a["b"] - x["use"], 0, kwh), a["d"] + x["d"]
        return F.struct(b.alias("b"), d.alias("d"), F.when(a["out"].isNull() & (b <= 0), d / 1000.0).otherwise(a["out"]).alias("out"))

    total = lambda f: F.aggregate("s", F.lit(0.0), lambda a, x: a + f(x))
    out = rows.select(
        "route_id", F.aggregate("s", start, step).alias("a"), (total(lambda x: x["d"]) / 1000.0).alias("total_distance_km"),
        (total(lambda x: x["t"]) / 60.0).alias("total_duration_min"), total(lambda x: at_least(x["use"], 0.0)).alias("consumed_kwh"),
        total(lambda x: at_least(-x["use"], 0.0)).alias("regenerated_kwh"),
    )
    net = F.col("consumed_kwh") - F.col("regenerated_kwh")
    return out.select(
        "route_id", "total_distance_km", "total_duration_min", "consumed_kwh", "regenerated_kwh", net.alias("net_kwh"),
        (F.col("a.b") / kwh * 100.0).alias("final_soc_percent"), (net * 1000.0 / at_least(F.col("total_distance_km"), 0.01)).alias("wh_per_km"),
        F.col("a.out").isNotNull().alias("is_depleted"), F.col("a.out").alias("depletion_km"),
    )


def co2_emissions(points: DataFrame, mass: float = 1600.0, cd: float = 0.32, area: float = 2.2, crr: float = 0.012, grams_per_litre: float = 2640.0) -> DataFrame:
    p = planar_steps(points)
    v = F.col("speed_kmh") / 3.6
    grade = mass * 9.81 * F.col("dz") / at_least(F.col("d"), 1e-4)
    force = crr * mass * 9.81 + 0.5 * 1.225 * cd * area * v * v + at_least(grade, 0.0)
    p = p.withColumn("work", force * F.col("d")).withColumn("climb", at_least(grade, 0.0) * F.col("d"))
    g = p.groupBy("route_id").agg(F.sum("d").alias("d"), F.sum("work").alias("work"), F.sum("climb").alias("climb"))
    litres = F.col("work") / 0.30 / 36e6
    kg = litres * grams_per_litre / 1000.0
    per_km = kg * 1000.0 / at_least(F.col("d") / 1000.0, 0.01)
    return g.select(
        "route_id", kg.alias("co2_kg"), litres.alias("fuel_litres"), per_km.alias("co2_g_per_km"), (F.col("work") / 3.6e6).alias("energy_kwh"),
        (F.col("climb") / 0.30 / 36e6 * grams_per_litre / 1000.0).alias("gradient_co2_kg"), (per_km < 150.0).alias("is_eco_optimal"),
    )


def brake_fade(drop: Column, speed_kmh: Column, mass: float = 24000.0, brake_mass: float = 120.0, start_c: float = 80.0, max_c: float = 300.0, heat: float = 500.0) -> dict[str, Column]:
    """Of a steep descent: energy, temperature, risk and recommended speed."""
    q = 0.65 * mass * 9.81 * at_least(drop, 0.0)
    rise = q / max(1.0, brake_mass * heat)
    peak = start_c + rise
    risk = F.when(peak <= 180.0, "LOW").when(peak <= max_c, "MODERATE").otherwise("CRITICAL_RUNAWAY")
    speed = F.when(peak <= 180.0, speed_kmh).when(peak <= max_c, F.least(F.lit(40.0), speed_kmh * 0.7)).otherwise(F.least(F.lit(25.0), speed_kmh * 0.4))
    return {"peak_c": peak, "rise_c": rise, "risk": risk, "safe_speed_kmh": speed, "is_safe": peak <= max_c}


def swept_path(points: DataFrame, trailer: float = 48.0, width: float = 3.5, curb_half_width: float = 4.0) -> DataFrame:
    """Off-tracking of a long trailer by each step's Menger curvature: widths, encroachments and the corridor's area."""
    w = along("route_id")
    lead = lambda c, n: F.lead(c, n).over(w)
    p = points.select("route_id", "seq", "x", "y", lead("x", 1).alias("x1"), lead("y", 1).alias("y1"), F.lag("x").over(w).alias("x0"), F.lag("y").over(w).alias("y0"))
    side = lambda ax, ay, bx, by: F.hypot(F.col(bx) - F.col(ax), F.col(by) - F.col(ay))
    a, b, c = side("x0", "y0", "x", "y"), side("x", "y", "x1", "y1"), side("x0", "y0", "x1", "y1")
    s = (a + b + c) / 2.0
    area = F.sqrt(at_least(s * (s - a) * (s - b) * (s - c), 0.0))
    radius = F.when((a * b * c > 1e-4) & (area > 1e-4), a * b * c / (4.0 * F.when(area > 1e-4, area).otherwise(1.0))).otherwise(500.0)
    p = p.withColumn("len", b).withColumn("r", F.coalesce(radius, F.lit(500.0)))
    tight = (F.col("r") > trailer) & (F.col("r") < 500.0)
    off = F.when(tight, F.col("r") - F.sqrt(at_least(F.col("r") * F.col("r") - trailer * trailer, 0.0))).otherwise(trailer * trailer / (2.0 * at_least(F.col("r"), 10.0)))
    p = p.withColumn("w", F.when(F.col("len") >= 1e-4, width + off))
    nx, ny = -(F.col("y1") - F.col("y")) / at_least(F.col("len"), 1e-4), (F.col("x1") - F.col("x")) / at_least(F.col("len"), 1e-4)
    p = p.select("*", *[(F.col(c) + k * n * F.col("w") / 2.0).alias(f"{name}{c}") for name, k in (("o", 1.0), ("i", -1.0)) for c, n in (("x", nx), ("y", ny))])
    rows = p.where("w is not null").groupBy("route_id").agg(
        F.max("w").alias("max_swept_width_m"), F.count_if(F.col("w") / 2.0 > curb_half_width).alias("encroachments"),
        F.array_sort(F.collect_list(F.struct("seq", "ox", "oy", "ix", "iy"))).alias("s"),
    )
    ring = F.concat(F.transform("s", lambda q: F.struct(q["ox"].alias("x"), q["oy"].alias("y"))), F.reverse(F.transform("s", lambda q: F.struct(q["ix"].alias("x"), q["iy"].alias("y")))))
    rows = rows.withColumn("ring", ring)
    cross = F.aggregate(
        F.sequence(F.lit(1), F.size("ring") - 1), F.lit(0.0),
        lambda a, k: a + F.element_at("ring", k)["x"] * F.element_at("ring", k + 1)["y"] - F.element_at("ring", k + 1)["x"] * F.element_at("ring", k)["y"],
    )
    return rows.select("route_id", "max_swept_width_m", "encroachments", (F.abs(cross) / 2.0).alias("corridor_area_m2"), (F.col("encroachments") == 0).alias("is_negotiable"))


def heat_soak(points: DataFrame, mass: float = 38000.0, rated_kw: float = 370.0, coolant_l: float = 45.0, radiator_kw: float = 160.0, ambient: float = 35.0, max_c: float = 105.0) -> DataFrame:
    """Coolant temperature along each route: a recurrence, so a fold over its steps."""
    p = planar_steps(points)
    rows = _steps_of(p, F.col("h"), F.col("dz"), (F.col("speed_kmh") / 3.6).alias("v"))
    start = F.struct(F.lit(max(85.0, ambient + 50.0)).alias("t"), F.lit(0.0).alias("fan"), F.lit(0.0).alias("stress"), F.lit(0.0).alias("peak"))

    def step(a: Column, x: Column) -> Column:
        v = at_least(x["v"], 1.0)
        dt = x["h"] / v
        grade = x["dz"] / at_least(x["h"], 1.0)
        power = F.least(F.lit(rated_kw), (mass * 9.81 * at_least(grade, 0.0) * v + 0.008 * mass * 9.81 * v) / 1000.0)
        hot = a["t"] > 95.0
        cool = radiator_kw * (at_least(a["t"] - ambient, 0.0) / 60.0) * F.sqrt(v / 10.0) * F.when(hot, 1.45).otherwise(1.0)
        t = at_least(a["t"] + (0.65 * power - cool) * dt / (coolant_l * 4.18), 80.0)
        return F.struct(
            t.alias("t"), (a["fan"] + F.when(hot, dt).otherwise(0.0)).alias("fan"),
            (a["stress"] + F.when(t > 100.0, (t - 100.0) * dt / 60.0).otherwise(0.0)).alias("stress"),
            F.greatest(a["peak"], F.floor(t * 10.0 + 0.5) / 10.0).alias("peak"),
        )

    out = rows.select("route_id", F.aggregate("s", start, step).alias("a"))
    return out.select("route_id", F.col("a.peak").alias("peak_coolant_c"), F.col("a.fan").alias("fan_s"), F.col("a.stress").alias("stress_index"), (F.col("a.peak") > max_c).alias("is_overheating"))


ADHESION = {"DRY": 1.0, "WET": 0.72, "LEAF": 0.45, "FROST": 0.5}


def rail_adhesion(grade_pct: Column, condition: Column, speed_kmh: Column | float = 60.0, loco_t: float = 120.0, trailing_t: float = 2400.0, power_kw: float = 6400.0) -> dict[str, Column]:
    v = at_least(_c(speed_kmh), 1.0)
    mu = (7.5 / (v + 44.0) + 0.161) * _lookup(ADHESION, condition, 1.0)
    adhesive = mu * loco_t * 9.81
    effort = F.least(adhesive, power_kw / at_least(v / 3.6, 1.0))
    total = loco_t + trailing_t
    resistance = total * 9.81 * (grade_pct / 100.0 + 0.0025)
    return {
        "mu": mu, "max_effort_kn": effort, "max_grade_pct": (effort / (total * 9.81) - 0.0025) * 100.0, "is_slip_risk": resistance > adhesive,
        "utilization_pct": clamp(resistance * (v / 3.6) / power_kw * 100.0, 0, 100), "braking_margin_m": at_least(1000.0 - v * v / (mu * 9.81), 0.0),
    }


def hydroplaning(speed_kmh: Column, rain_mm_h: Column, path_m: float = 7.5, cross_slope_pct: float = 2.0, texture_mm: float = 1.0, pressure_kpa: float = 220.0, tread_mm: Column | float = 4.0) -> dict[str, Column]:
    texture_in, path_ft = texture_mm / 25.4, path_m * 3.28084
    film_in = at_least(
        0.00338 * F.pow(F.lit(max(1e-4, texture_in)), F.lit(0.11)) * F.pow(F.lit(max(1.0, path_ft)), F.lit(0.43)) * F.pow(at_least(rain_mm_h / 25.4, 0.1), F.lit(0.59))
        * F.pow(F.lit(max(0.005, cross_slope_pct / 100.0)), F.lit(-0.42)) - texture_in, 0.0)
    film = film_in * 25.4
    depth = F.when(film < 1.0, 1.0).otherwise(at_least(1.0 - 0.08 * (film - 1.0), 0.7))
    critical = 6.35 * F.sqrt(F.lit(pressure_kpa)) * clamp(_c(tread_mm) / 8.0, 0.65, 1.0) * depth
    return {"film_mm": film, "critical_kmh": critical, "is_risk": speed_kmh >= critical, "margin_kmh": critical - speed_kmh}


def platooning(trucks: Column, gap_m: Column, km: float = 450.0, l_100km: float = 31.0, usd_per_litre: float = 1.45) -> dict[str, Column]:
    n, g = at_least(trucks, 2.0), at_least(gap_m, 4.0)
    lead, trail = clamp(9.5 * F.exp(-0.035 * g), 2, 10), clamp(20.0 * F.exp(-0.04 * g), 5, 22)
    overall = (lead + (n - 1.0) * trail) / n
    saved = n * km / 100.0 * l_100km * overall / 100.0
    return {"lead_pct": lead, "trailing_pct": trail, "overall_pct": overall, "saved_litres": saved, "co2_kg": saved * 2.68, "usd": saved * usd_per_litre}


def tunnel_smoke(fire_mw: Column, length_m: Column, area: float = 65.0, height: float = 8.5, grade_pct: Column | float = 2.0, ambient_k: float = 293.15, fan_thrust_n: float = 1200.0) -> dict[str, Column]:
    kw = fire_mw * 1000.0
    fire_k = ambient_k + kw / max(1.0, 1.2 * 1.005 * area * 2.5)
    grade = at_least(1.0 + 0.035 * at_least(_c(grade_pct), 0.0), 1.0)
    critical = grade * F.pow(9.81 * height * kw / at_least(1.2 * 1.005 * area * fire_k, 1.0), F.lit(1.0 / 3.0))
    v = at_least(critical * 1.05, 2.5)
    drop = 0.5 * 1.2 * v * v * (1.5 + 0.022 * length_m / height) * area
    return {
        "critical_ms": critical, "air_ms": v, "smoke_c": fire_k - 273.15, "visibility_m": clamp(250.0 / at_least(4.0 * fire_mw, 10.0), 10, 30),
        "jet_fans": F.greatest(F.lit(4), F.ceil(drop / max(1.0, fan_thrust_n)).cast("int")), "is_prevented": v >= critical,
    }


def hyperloop(speed_kmh: Column, pod_m2: Column | float = 3.8, tube_m: Column | float = 4.0, pressure_pa: float = 100.0, gamma: float = 1.4, cd: float = 0.2, kelvin: float = 293.15) -> dict[str, Column]:
    tube = 3.141592653589793 * F.pow(_c(tube_m) / 2.0, F.lit(2.0))
    blockage = clamp(_c(pod_m2) / tube, 0.05, 0.95)
    inner = F.pow(1.0 / (1.0 - blockage), F.lit((gamma - 1.0) / gamma)) - 1.0
    limit = F.when(inner > 0, F.sqrt(2.0 / (gamma - 1.0) * at_least(inner, 0.0))).otherwise(0.5)
    v = speed_kmh / 3.6
    mach = v / (gamma * 287.05 * kelvin) ** 0.5
    rho = pressure_pa / (287.05 * kelvin)
    squeeze = at_least(F.sqrt(at_least(1.0 - F.least(F.lit(0.95), mach * mach), 0.05)), 0.2)
    drag = 0.5 * rho * v * v * cd * _c(pod_m2) / squeeze * F.when(mach > limit, 3.5).otherwise(1.0)
    return {"blockage": blockage, "kantrowitz_mach": limit, "mach": mach, "is_choked": mach > limit, "drag_n": drag, "power_kw": drag * v / 1000.0}


def ski_piste(points: DataFrame) -> DataFrame:
    p = planar_steps(points).withColumn("s", F.when(F.col("h") > 0, F.abs("dz") / at_least(F.col("h"), 1.0) * 100.0).otherwise(0.0))
    g = p.groupBy("route_id").agg(
        F.sum("d").alias("distance_m"), F.sum(F.when(F.col("dz") < 0, -F.col("dz")).otherwise(0.0)).alias("vertical_drop_m"),
        F.sum(F.col("s") * F.col("h")).alias("sh"), F.sum("h").alias("h"), F.max("s").alias("max_slope_pct"), F.bool_or(F.col("dz") > 0.2).alias("has_uphill"),
    )
    m = F.col("max_slope_pct")
    piste = F.when(m <= 15, "GREEN").when(m <= 25, "BLUE").when(m <= 40, "RED").otherwise("BLACK")
    speed = F.when(m <= 15, 7.0).when(m <= 25, 11.0).when(m <= 40, 15.0).otherwise(19.0)
    return g.select("route_id", "distance_m", "vertical_drop_m", F.when(F.col("h") > 0, F.col("sh") / at_least(F.col("h"), 1e-9)).otherwise(0.0).alias("avg_slope_pct"), "max_slope_pct", piste.alias("piste"), (F.col("distance_m") / speed / 60.0).alias("minutes"), "has_uphill")


def hydrofoil(points: DataFrame, displacement: float = 45.0, takeoff_kn: float = 22.0, cruise_kn: float = 38.0, hull_draft: float = 2.8, foil_draft: float = 1.4, lift_drag: float = 12.5) -> DataFrame:
    """Voyages over (lon, lat, depth) points: legs by plane sailing in nautical miles, the shallower end is a leg's depth."""
    w = along("route_id")
    n = lambda c: F.lead(c).over(w)
    p = points.select("route_id", "seq", (n("lat") - F.col("lat")).alias("dlat"), (n("lon") - F.col("lon")).alias("dlon"), ((n("lat") + F.col("lat")) / 2).alias("mid"), F.least(F.col("depth"), n("depth")).alias("depth"), n("lat").isNotNull().alias("ok")).where("ok")
    nm = F.hypot(F.col("dlat") * 60.0, F.col("dlon") * 60.0 * F.cos(F.radians("mid")))
    p = p.withColumn("nm", nm).withColumn("draft", F.when(F.col("nm") > 1.0, foil_draft).otherwise(hull_draft))
    g = p.groupBy("route_id").agg(
        F.sum("nm").alias("nautical_miles"), F.min(F.col("depth") - F.col("draft")).alias("min_under_keel_m"),
        F.bool_or(F.col("depth") / at_least(F.col("draft"), 0.5) < 1.4).alias("squat_risk"),
        F.sum(F.when((F.col("nm") > 0.5) & (F.col("depth") > 4.0), F.col("nm")).otherwise(0.0)).alias("foil"),
    )
    pct = F.when(F.col("nautical_miles") > 0, F.col("foil") / at_least(F.col("nautical_miles"), 1e-9) * 100.0).otherwise(0.0)
    speed = F.when(pct > 50.0, cruise_kn).otherwise(0.8 * takeoff_kn)
    return g.select("route_id", "nautical_miles", (F.col("nautical_miles") / speed).alias("hours"), pct.alias("foilborne_pct"), "min_under_keel_m", "squat_risk", (F.col("nautical_miles") * (displacement / max(1.0, lift_drag)) * 3.8).alias("fuel_litres"))


ROUGHNESS = {"asphalt_smooth": 1.5, "asphalt_rough": 3.8, "paving_tiles": 5.2, "gravel": 8.0, "cobblestone": 12.5}


def micromobility(steps: DataFrame, wheel_inch: float = 10.0) -> DataFrame:
    """Vibration of rows (route_id, length_m, surface, speed_kmh)."""
    iri = _lookup(ROUGHNESS, F.coalesce("surface", F.lit("asphalt_smooth")), 2.5)
    amp = (28.0 / max(5.0, wheel_inch)) ** 0.5
    v = F.col("speed_kmh") / 3.6
    a = 0.08 * iri * F.pow(v / 2.78, F.lit(0.7)) * amp
    vdv = a * F.pow(F.col("length_m") / at_least(v, 0.5), F.lit(0.25))
    risk = F.least(F.lit(1.0), iri / 15.0 * (F.col("speed_kmh") / 25.0) * (amp / 1.8))
    p = steps.select("route_id", "length_m", a.alias("a"), vdv.alias("vdv"), risk.alias("risk"))
    g = p.groupBy("route_id").agg(
        (F.sum("length_m") / 1000.0).alias("distance_km"), F.avg("a").alias("mean_rms"), F.max("vdv").alias("max_vdv"),
        F.count_if(F.col("a") > 0.63).alias("uncomfortable"), F.count_if(F.col("risk") >= 0.6).alias("hotspots"),
    )
    return g.withColumn("bikeability", at_least(100.0 - 45.0 * F.col("mean_rms") - 5.0 * F.col("hotspots"), 0.0))


def wind(points: DataFrame, wind_ms: float = 6.0, wind_from_deg: float = 270.0, cd: float = 0.88, area: float = 0.55, rho: float = 1.225) -> DataFrame:
    """Apparent wind and the power it costs against calm air."""
    p = planar_steps(points)
    v = at_least(F.col("speed_kmh") / 3.6, 0.0)
    heading = F.atan2(F.col("dx"), F.col("dy"))
    rad = F.radians(F.lit(wind_from_deg))
    ax, ay = -wind_ms * F.sin(rad) - v * F.sin(heading), -wind_ms * F.cos(rad) - v * F.cos(heading)
    va = F.hypot(ax, ay)
    yaw = F.abs(floor_mod(F.degrees(F.atan2(-ax, -ay)) - F.degrees(heading) + 180.0, 360.0) - 180.0)
    power = at_least(0.5 * rho * cd * area * va * va * F.cos(F.radians(yaw)) * v, 0.0)
    calm = 0.5 * rho * cd * area * v * v * v
    p = p.select("route_id", "h", va.alias("va"), yaw.alias("yaw"), ((power - calm) * (F.col("h") / at_least(v, 1.0))).alias("joules"))
    d = at_least(F.sum("h"), 1.0)
    return p.groupBy("route_id").agg(
        (F.sum("h") / 1000.0).alias("distance_km"), (F.sum("joules") / 3.6e6).alias("penalty_kwh"), F.avg("va").alias("mean_apparent_ms"),
        (F.sum(F.when(F.col("yaw") > 120.0, F.col("h")).otherwise(0.0)) / d).alias("tailwind_ratio"), (F.sum(F.when(F.col("yaw") < 60.0, F.col("h")).otherwise(0.0)) / d).alias("headwind_ratio"),
    )


def biomechanics(points: DataFrame, base_kmh: float = 8.0, mass: float = 70.0, pack: float = 5.0, age: int = 35, rest: int = 60) -> DataFrame:
    """Trail running: energy, METs, heart rates and their zones, and fatigue from the energy so far."""
    p = planar_steps(points)
    s = F.when(F.col("h") > 0, F.col("dz") / at_least(F.col("h"), 1e-4)).otherwise(0.0)
    speed = at_least(base_kmh * F.exp(-3.5 * F.abs(s + 0.05)), 1.5)
    kcal = kinematics.running_cost(s) * (mass + pack) * F.col("d") / 4184.0
    hours = F.col("d") / 1000.0 / speed
    mets = kcal / mass / at_least(hours, 1e-4)
    top = 220 - age
    hr = F.floor(F.least(F.lit(float(top)), rest + F.least(F.lit(1.0), mets / 14.0) * (top - rest)))
    w = along("route_id")
    p = p.select("route_id", "seq", "d", "dz", kcal.alias("kcal"), mets.alias("mets"), hr.alias("hr"), (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("route_id")).alias("n"))
    p = p.withColumn("cum", F.sum("kcal").over(w)).withColumn("fatigue", F.least(F.lit(1.0), F.col("cum") / 1200.0 + 0.3 * F.col("i") / F.col("n")))
    share = F.col("hr") / float(top)
    zone = lambda low, high: (F.count_if((share >= low) & (share < high)) / F.count(F.lit(1)) * 100.0)
    return p.groupBy("route_id").agg(
        (F.sum("d") / 1000.0).alias("distance_km"), F.sum("kcal").alias("kcal"), F.avg("mets").alias("mean_mets"), F.floor(F.avg("hr")).alias("mean_hr"),
        F.max("hr").alias("peak_hr"), F.max("fatigue").alias("max_fatigue"), zone(-1, 0.6).alias("zone1"), zone(0.6, 0.7).alias("zone2"),
        zone(0.7, 0.8).alias("zone3"), zone(0.8, 0.9).alias("zone4"), zone(0.9, 9).alias("zone5"),
    )


def solar_position(lat: Column, hour: Column, day: Column) -> dict[str, Column]:
    """Sun's elevation and azimuth in degrees, and direct irradiance in W/m2, from latitude, solar hour and day of the year."""
    decl = F.radians(23.45 * F.sin(F.radians(360.0 / 365.0 * (284.0 + day))))
    angle, phi = F.radians(15.0 * (hour - 12.0)), F.radians(lat)
    sin_el = clamp(F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.cos(angle), -1, 1)
    el = F.asin(sin_el)
    cos_az = clamp((F.sin(decl) - sin_el * F.sin(phi)) / at_least(F.cos(el) * F.cos(phi), 1e-6), -1, 1)
    az = F.degrees(F.acos(cos_az))
    return {"elevation_deg": F.degrees(el), "azimuth_deg": F.when(hour > 12.0, 360.0 - az).otherwise(az), "irradiance": F.when(sin_el > 0, 1000.0 * sin_el).otherwise(0.0)}


def shade(points: DataFrame, hour: float = 15.0, day: int = 172, lat: float = 38.4, density: float = 0.6) -> DataFrame:
    """Street-canyon shade along planar routes."""
    p = planar_steps(points)
    sun = solar_position(F.lit(lat), F.lit(hour), F.lit(float(day)))
    el, az = sun["elevation_deg"], sun["azimuth_deg"]
    bearing = floor_mod(F.degrees(F.atan2(F.col("dx"), F.col("dy"))), 360.0)
    across = F.sin(floor_mod(F.radians(bearing - az), 3.141592653589793))
    prob = across * density * F.least(F.lit(1.0), 0.35 / at_least(F.tan(F.radians(el)), 0.1))
    shaded = (el <= 0) | (prob > 0.45)
    g = p.groupBy("route_id").agg(F.sum("h").alias("h"), F.sum(F.when(shaded, F.col("h")).otherwise(0.0)).alias("s"))
    pct = F.col("s") / at_least(F.col("h"), 1e-9) * 100.0
    sunny = 100.0 - pct
    kwh = F.when(el > 0, sun["irradiance"] * sunny / 100.0 * (F.col("h") / 1000.0 * 0.2) / 1000.0).otherwise(0.0)
    return g.select("route_id", pct.alias("shaded_pct"), sunny.alias("direct_sun_pct"), kwh.alias("exposure_kwh"), F.when(pct >= 65, "cool").when(pct >= 35, "mixed").otherwise("exposed").alias("category"))


CONGESTION = {7: 0.75, 8: 0.60, 9: 0.70, 12: 0.85, 13: 0.85, 17: 0.55, 18: 0.50, 19: 0.65}


def congested_rings(departures: DataFrame, cutoffs: list[float], base_kmh: float = 40.0, vertices: int = 36) -> DataFrame:
    """(id, hour, cutoff_min, radius_m, k, px, py): circles that are reached in time at the hour's speed, closed, to 2 places."""
    factor = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CONGESTION.items() for x in kv]), F.col("hour").cast("int")), F.lit(0.95))
    p = departures.select("id", "x", "y", "hour", factor.alias("factor"), F.explode(F.array(*map(F.lit, cutoffs))).alias("cutoff_min"))
    p = p.withColumn("radius_m", base_kmh * F.col("factor") * 1000.0 / 60.0 * F.col("cutoff_min")).select("*", F.explode(F.sequence(F.lit(0), F.lit(vertices))).alias("k"))
    angle = 2 * 3.141592653589793 * F.col("k") / vertices
    two = lambda c: F.floor(c * 100.0 + 0.5) / 100.0
    return p.select("id", "hour", "cutoff_min", "radius_m", "k", two(F.col("x") + F.col("radius_m") * F.cos(angle)).alias("px"), two(F.col("y") + F.col("radius_m") * F.sin(angle)).alias("py"))
