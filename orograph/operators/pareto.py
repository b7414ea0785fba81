"""Trade-offs between travel time, ascent, heat and effort: all routes that no other beats in everything.

Labels (a route so far and its four sums) spread over the network in rounds for all queries at once. In each round the labels of a node meet in one
group and drop those that another one dominates, as do labels that a finished route of their query dominates. Both sets are as large as a
frontier; the rounds end as routes visit no node twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kinematics, profiles
from ..functions.durable import durable, durable_counting, release
from ..functions.numbers import at_least, rounded

SUMS = ("time_s", "ascent_m", "heat_dose", "energy_kcal")
JOULES_A_KCAL = 4184.0


def vectors(edges: DataFrame, nodes: DataFrame, profile: str | dict = "adult", lst: str | None = None) -> DataFrame:
    """(u, v, time_s, ascent_m, heat_dose, energy_kcal) of edges (u, v, length_m, slope_pct) between nodes (id, z); ``lst`` names a column of nodes with surface heat.

    Without heat its sum is 0, as a constant would be another name for length. Motors need no effort. Nodes without a height count as level.
    """
    p = profiles.resolve(profile)
    at = nodes.select(F.col("id"), F.coalesce("z", F.lit(0.0)).alias("z"), (F.col(lst) if lst else F.lit(None).cast("double")).alias("lst"))
    e = edges.join(at.select(F.col("id").alias("u"), F.col("z").alias("zu")), "u").join(at.select(F.col("id").alias("v"), F.col("z").alias("zv"), "lst"), "v")
    slope, length = F.col("slope_pct") / 100.0, F.col("length_m")
    if p["category"] == "pedestrian":
        kmh, joules = kinematics.tobler_speed(slope, p["base_kmh"]), kinematics.minetti_joules(slope, 70.0, length)
    elif p["key"] in ("bicycle", "mtb"):
        kmh, joules = kinematics.cyclist_speed(slope, p["base_kmh"]), kinematics.cycling_joules(slope, 70.0, length)
    else:
        kmh, joules = at_least(p["base_kmh"] * (1.0 - F.abs(F.col("slope_pct")) * 0.02), 5.0), F.lit(0.0)
    return e.select(
        "u", "v", (length / at_least(kmh / 3.6, 0.2)).alias("time_s"), at_least(F.col("zv") - F.col("zu"), 0.0).alias("ascent_m"),
        F.coalesce(F.col("lst") * length / 100.0, F.lit(0.0)).alias("heat_dose"), (joules / JOULES_A_KCAL).alias("energy_kcal"),
    )


def dominates(a: Column, b: Column, epsilon: float) -> Column:
    """Whether sums ``a``, enlarged by ``epsilon``, are no more than ``b`` in everything, and less in something."""
    within, less = F.lit(True), F.lit(False)
    for s in SUMS:
        within, less = within & ((1.0 + epsilon) * a[s] <= b[s]), less | (a[s] < b[s])
    return within & less


def _undominated(labels: DataFrame, epsilon: float, *keys: str) -> DataFrame:
    """The labels of each group that no other of it dominates; of labels with the same sums the one that was there before, then the least path."""
    # Dealt out by group once, for both steps; the first alone would be dealt out by sums too.
    same = labels.repartition(*keys).groupBy(*keys, *SUMS).agg(F.min(F.struct("fresh", "path")).alias("l"))
    every = same.groupBy(*keys).agg(F.collect_list(F.struct(*SUMS, "l.fresh", "l.path")).alias("a"))
    kept = F.filter("a", lambda x: ~F.exists("a", lambda y: dominates(y, x, epsilon)))
    return every.select(*keys, F.inline(kept))


def frontier(edges: DataFrame, queries: DataFrame, epsilon: float = 0.03, max_rounds: int = 10_000) -> DataFrame:
    """(query_id, time_s, ascent_m, heat_dose, energy_kcal, path): the trade-off routes of each query (query_id, src, dst) over ``vectors``.

    ``epsilon`` of 0 gives exactly the routes that no other dominates; a larger one also keeps those that are beaten by less than that share.
    Routes with the same sums, to 6 decimals, are one. A query without a route, or from a node to itself, has none.
    """
    e = durable(edges.groupBy("u", "v", *SUMS).count().drop("count"), "vectors")
    start = queries.where("src <> dst").select("query_id", "dst", F.col("src").alias("node"), *[F.lit(0.0).alias(s) for s in SUMS], F.lit(True).alias("fresh"), F.array("src").alias("path"))
    labels = durable(start.dropDuplicates(["query_id"]), "labels")
    for _ in range(max_rounds):
        step = labels.where("fresh and node <> dst").withColumnRenamed("node", "u")
        grown = step.alias("l").join(e.alias("e"), "u").where(~F.array_contains("l.path", F.col("e.v")))
        new = grown.select("query_id", "dst", F.col("e.v").alias("node"), *[rounded(F.col(f"l.{s}") + F.col(f"e.{s}"), 6).alias(s) for s in SUMS], F.lit(True).alias("fresh"), F.concat("l.path", F.array("e.v")).alias("path"))
        merged = _undominated(labels.withColumn("fresh", F.lit(False)).unionByName(new), epsilon, "query_id", "dst", "node")
        merged = durable(merged, "merged")
        # What a finished route beats cannot become one that it doesn't, but for routes within epsilon of it.
        done = merged.where("node = dst").groupBy("query_id").agg(F.collect_list(F.struct(*SUMS)).alias("done"))
        open_ = merged.join(done, "query_id", "left")
        beaten = F.exists(F.coalesce("done", F.array()), lambda y: dominates(y, F.struct(*SUMS), epsilon))
        last = labels
        labels, left = durable_counting(open_.where((F.col("node") == F.col("dst")) | ~beaten).drop("done"), "fresh and node <> dst", "labels")
        release(last, merged)
        if not left:
            release(e)
            return labels.where("node = dst").select("query_id", *SUMS, "path")
    raise RuntimeError("the frontier did not settle")


def archetypes(solutions: DataFrame) -> DataFrame:
    """(query_id, label, sums, path, utopia_distance): the fastest, flattest, coolest, least-effort and most balanced route of each query.

    A route that is several of them has the first label. Balanced is nearest to the best of everything, in shares of each sum's range.
    """
    floors = dict(zip(SUMS, (1.0, 1.0, 0.1, 1.0), strict=True))
    ends = solutions.groupBy("query_id").agg(*[F.min(s).alias(f"low_{s}") for s in SUMS], *[F.max(s).alias(f"high_{s}") for s in SUMS])
    j = solutions.join(ends, "query_id")
    share = [F.pow((F.col(s) - F.col(f"low_{s}")) / at_least(F.col(f"high_{s}") - F.col(f"low_{s}"), floors[s]), 2) for s in SUMS]
    j = j.withColumn("utopia_distance", F.sqrt(sum(share[1:], share[0])))
    row = F.struct(*SUMS, "path", "utopia_distance")
    names = ["fastest", "flattest", "coolest", "least effort", "balanced"]
    picks = [F.min_by(row, F.struct(c, *SUMS, "path")).alias(n) for n, c in zip(names, [*SUMS, "utopia_distance"], strict=True)]
    g = j.groupBy("query_id").agg(*picks)
    each = g.select("query_id", F.posexplode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(f"`{n}`").alias("r")) for n in names])).alias("k", "p"))
    first = each.groupBy("query_id", "p.r.path").agg(F.min(F.struct("k", "p.label", "p.r")).alias("b"))
    return first.select("query_id", "b.label", *[f"b.r.{s}" for s in SUMS], "path", "b.r.utopia_distance")
