"""Road networks as tables: building, components, least costs from many sources, routes, matrices and reach.

A network is nodes (id, lon, lat, z) and directed edges (u, v, length_m, slope_pct, highway, surface, lanes). Least costs come from rounds of
relaxation over all sources at once: each round joins the frontier with the edges of its nodes and keeps what improves. The
merged state is grouped anew in each round and stored, so no claim about its partitioning survives from one round to the next.
Paths, which may run through the whole network, are searched by blocks of nodes instead (``search``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, profiles
from ..functions.durable import durable, durable_counting, release
from ..functions.numbers import INF, at_least
from .search import least_paths


def build(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of segments (seq, lon1, lat1, z1, lon2, lat2, z2, highway, surface, lanes, is_oneway[, length_m]).

    Ends that agree to 5 places are one node: its number is a hash of them, its coordinates those first seen. Of directed
    duplicates the first segment stays; the way back of a two-way segment is an edge of its own and hides nothing.
    """
    key = lambda lon, lat: (F.floor(F.col(lon) * 1e5 + 0.5).cast("long") * 100_000_000 + F.floor(F.col(lat) * 1e5 + 0.5).cast("long"))
    s = segments.withColumn("u", key("lon1", "lat1")).withColumn("v", key("lon2", "lat2")).where("u <> v")
    ends = s.select("seq", F.lit(0).alias("end"), F.col("u").alias("id"), F.col("lon1").alias("lon"), F.col("lat1").alias("lat"), F.col("z1").alias("z")).unionByName(
        s.select("seq", F.lit(1).alias("end"), F.col("v").alias("id"), F.col("lon2").alias("lon"), F.col("lat2").alias("lat"), F.col("z2").alias("z"))
    )
    first = ends.groupBy("id").agg(F.min(F.struct("seq", "end", "lon", "lat", "z")).alias("f"))
    nodes = first.select("id", "f.lon", "f.lat", F.coalesce("f.z", F.lit(0.0)).alias("z"))
    d = geo.haversine(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))
    given = F.col("length_m") if "length_m" in segments.columns else F.lit(None).cast("double")
    s = s.withColumn("length_m", F.when(given > 0, given).otherwise(at_least(d, 0.1))).withColumn(
        "slope_pct", F.when(d > 0.1, (F.coalesce("z2", F.lit(0.0)) - F.coalesce("z1", F.lit(0.0))) / at_least(d, 0.1) * 100.0).otherwise(0.0)
    )
    rest = ["length_m", "highway", "surface", "lanes"]
    kept = s.groupBy("u", "v").agg(F.min(F.struct("seq", *rest, "slope_pct", "is_oneway")).alias("f")).select("u", "v", "f.*")
    back = kept.where(~F.col("is_oneway")).select(F.col("v").alias("u"), F.col("u").alias("v"), "seq", *rest, (-F.col("slope_pct")).alias("slope_pct"))
    edges = kept.drop("is_oneway").withColumn("ord", F.lit(0)).unionByName(back.withColumn("ord", F.lit(1)))
    return nodes, edges


def edges_of(segments: DataFrame) -> DataFrame:
    """Directed edges of segments that name their nodes (u, v), with the places of both."""
    d = geo.haversine(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))
    ends = [F.col(a).alias(b) for a, b in (("lon1", "ulon"), ("lat1", "ulat"), ("lon2", "vlon"), ("lat2", "vlat"))]
    s = segments.select(F.struct("u", "v", *ends).alias("there"), at_least(d, 0.1).alias("length_m"), ((F.col("z2") - F.col("z1")) / at_least(d, 0.1) * 100.0).alias("slope_pct"), "highway", "surface", "lanes", "is_oneway")
    # Both ways from one row, so that segments are made once.
    turned = F.struct(*[F.col(f"there.{a}").alias(b) for a, b in (("v", "u"), ("u", "v"), ("vlon", "ulon"), ("vlat", "ulat"), ("ulon", "vlon"), ("ulat", "vlat"))], (-F.col("slope_pct")).alias("slope_pct"))
    there = F.struct("there.*", "slope_pct")
    ways = F.when(F.col("is_oneway"), F.array(there)).otherwise(F.array(there, turned))
    return s.select("length_m", "highway", "surface", "lanes", F.inline(ways)).select("u", "v", "length_m", "slope_pct", "highway", "surface", "lanes", "ulon", "ulat", "vlon", "vlat")


def weighted(edges: DataFrame, profile: str | dict = "adult", weights: dict | None = None) -> DataFrame:
    """Edges that the profile can pass, with ``cost`` (generalised metres), ``seconds`` and ``rank``."""
    p = profiles.resolve(profile)
    rank = profiles.hierarchy(F.col("highway"))
    cost = profiles.impedance(p, F.col("length_m"), F.col("slope_pct"), F.col("highway") == "steps", F.col("surface"), rank, weights=weights)
    told = F.struct(cost.alias("cost"), profiles.travel_seconds(p, F.col("length_m"), F.col("slope_pct"), rank).alias("seconds"))
    e = edges.drop("cost", "seconds").withColumn("rank", rank).withColumn("_told", told)
    # A filter would be moved to where edges are made, and work out their lengths and slopes again for each mention.
    return e.select("*", F.inline(F.filter(F.array("_told"), lambda x: x["cost"] < INF))).drop("_told")


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component): the least node that is reachable over edges taken both ways.

    Rounds take the least label of the neighbours and then the label of the label, so long chains halve.
    """
    both = durable(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct(), "both")
    now = durable(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().select("node", F.col("node").alias("component")), "labels")
    for _ in range(max_rounds):
        told = both.join(now.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("component").alias("c"))
        hook = now.join(told.withColumnRenamed("u", "node"), "node", "left")
        hook = durable(hook.select("node", F.col("component").alias("before"), F.least("component", "c").alias("component")), "labels")
        jump = hook.alias("a").join(hook.select(F.col("node").alias("component"), F.col("component").alias("next")), "component", "left")
        after, changed = durable_counting(jump.select("node", "before", F.least("component", "next").alias("component")), "component <> before", "labels")
        release(now, hook)
        now = after.drop("before")
        if not changed:
            return now
    raise RuntimeError("components did not settle")


def least_costs(edges: DataFrame, sources: DataFrame, cost: str = "cost", limit: float | None = None, avoid: DataFrame | None = None, hops_a_round: int = 4, max_rounds: int = 100_000) -> DataFrame:
    """(src, node, cost, parent, hops) of every node within ``limit`` of each source (src, node): the least cost, then the least parent.

    ``avoid`` (src, u, v) shuts edges for single sources. Costs must be positive, so rounds end: a best path's edges divided by
    ``hops_a_round``, which are relaxed in one plan between two stored states.
    """
    e = durable(edges.select(F.col("u").alias("node"), F.col("v").alias("next"), F.col(cost).alias("w")), "edges")
    shut = durable(avoid.select("src", F.col("u").alias("node"), F.col("v").alias("next")).distinct(), "shut") if avoid is not None else None
    row = ["cost", "parent", "hops", "k"]
    best = F.min(F.struct(*row)).alias("b")
    state = sources.select("src", "node", F.lit(0.0).alias("cost"), F.lit(-1).cast("long").alias("parent"), F.lit(0).alias("hops"), F.lit(True).alias("fresh")).distinct()
    state = durable(state, "costs")
    for _ in range(max_rounds):
        front = state.where("fresh")
        both = state.select("src", "node", "cost", "parent", "hops", F.lit(0).alias("k"))
        for k in range(1, hops_a_round + 1):
            step = front.join(e, "node")
            if shut is not None:
                step = step.join(shut, ["src", "node", "next"], "left_anti")
            step = step.select("src", F.col("next").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.col("node").alias("parent"), (F.col("hops") + 1).alias("hops"), F.lit(k).alias("k"))
            if limit is not None:
                step = step.where(F.col("cost") <= limit)
            front = step.groupBy("src", "node").agg(best).select("src", "node", *[f"b.{c}" for c in row])
            both = both.unionByName(front)
        merged = both.groupBy("src", "node").agg(best)
        # What an earlier hop of this round found has been relaxed in it already.
        after = merged.select("src", "node", "b.cost", "b.parent", "b.hops", (F.col("b.k") == hops_a_round).alias("fresh"))
        last = state
        state, left = durable_counting(after, "fresh", "costs")
        release(last)
        if not left:
            release(*(t for t in (e, shut) if t is not None))
            return state.drop("fresh")
    raise RuntimeError("relaxation did not settle")


def isochrones(edges: DataFrame, origins: DataFrame, nodes: DataFrame, minutes: list[float], profile: str | dict = "adult") -> DataFrame:
    """(src, cutoff_min, node_count, area_ha): what each origin (src, node) reaches in time, with the area of the convex hull."""
    b = isochrone_bands(edges, origins, nodes, minutes, profile)
    return b.select("src", "cutoff_min", "node_count", "area_ha")


def isochrone_bands(edges: DataFrame, origins: DataFrame, nodes: DataFrame, minutes: list[float], profile: str | dict = "adult") -> DataFrame:
    """The areas of ``isochrones`` with their outlines: src, cutoff_min, node_count, area_ha and ring, an array of (lon, lat).

    Impassable edges are those of infinite cost; what adds up is travel time.
    """
    cuts = cutoffs(minutes)
    e = weighted(edges, profile)
    costs = least_costs(e, origins, "seconds", 60.0 * max(cuts))
    bands = costs.select("src", "node", "cost", F.explode(F.array(*map(F.lit, cuts))).alias("cutoff_min")).where(F.col("cost") <= F.col("cutoff_min") * 60.0)
    placed = bands.join(nodes.select(F.col("id").alias("node"), "lon", "lat"), "node")
    # The hull of the hulls of strips is the hull, and a strip's points are few.
    strips = placed.groupBy("src", "cutoff_min", F.floor(F.col("lat") / 0.005).alias("strip")).agg(F.count(F.lit(1)).alias("k"), F.array_sort(F.collect_set(F.struct("lon", "lat"))).alias("p"))
    hulls = strips.select("src", "cutoff_min", "k", convex_hull(F.col("p")).alias("p"))
    g = hulls.groupBy("src", "cutoff_min").agg(F.sum("k").alias("node_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("p")))).alias("p"))
    ringed = g.select("src", "cutoff_min", "node_count", convex_hull(F.col("p")).alias("ring"))
    return ringed.select("*", (ring_area_m2(F.col("ring")) / 1e4).alias("area_ha"))


def cutoffs(minutes: list) -> list[float]:
    """Finite positive minutes up to 1440, to 3 places, each once, in order, the first 12."""
    out = set()
    for m in minutes:
        try:
            x = round(float(m), 3)
        except (TypeError, ValueError):
            continue
        if math.isfinite(x) and 0 < x <= 1440:
            out.add(x)
    return sorted(out)[:12]


def convex_hull(points: Column) -> Column:
    """Counter-clockwise hull of a sorted array of different structs (lon, lat), by a fold that keeps a stack for each side."""

    def turns_right(a: Column, b: Column, c: Column) -> Column:
        return (b["lon"] - a["lon"]) * (c["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (c["lon"] - a["lon"]) <= 0

    def chain(p: Column) -> Column:
        empty = F.filter(p, lambda x: F.lit(False))

        def push(stack: Column, x: Column) -> Column:
            # Drop from the end while the last turn is not left: the longest prefix whose last turn with x is left stays.
            keep = F.aggregate(
                F.sequence(F.lit(0), F.size(stack)), F.size(stack),
                lambda n, _: F.when((n >= 2) & turns_right(F.try_element_at(stack, F.greatest(n - 1, F.lit(1))), F.try_element_at(stack, F.greatest(n, F.lit(1))), x), n - 1).otherwise(n),
            )
            return F.concat(F.slice(stack, 1, keep), F.array(x))

        return F.aggregate(p, empty, push)

    low, high = chain(points), chain(F.reverse(points))
    cut = lambda c: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))
    return F.when(F.size(points) < 3, points).otherwise(F.concat(cut(low), cut(high)))


def ring_area_m2(ring: Column, radius: float = 6371000.0) -> Column:
    """Shoelace area of a ring of (lon, lat) on the plane of its mean latitude; 0 under three points."""
    mean = F.aggregate(ring, F.lit(0.0), lambda a, x: a + x["lat"]) / F.greatest(F.size(ring), F.lit(1))
    k = math.pi / 180.0 * radius
    closed = F.concat(ring, F.slice(ring, 1, 1))
    cross = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(ring), F.lit(1))), F.lit(0.0),
        lambda a, i: a + F.try_element_at(closed, i)["lon"] * F.try_element_at(closed, i + 1)["lat"] - F.try_element_at(closed, i + 1)["lon"] * F.try_element_at(closed, i)["lat"],
    )
    return F.when(F.size(ring) < 3, 0.0).otherwise(F.abs(cross) * k * k * F.cos(F.radians(mean)) / 2.0)


def routes(edges: DataFrame, queries: DataFrame, profile: str | dict = "adult", avoid: DataFrame | None = None, limit: float | None = None) -> DataFrame:
    """(query_id, pos, node, cost) of the least-cost path of each query (query_id, src, dst); queries without a path have no rows.

    Sources that several queries share are searched once. ``avoid`` (query_id, u, v) shuts edges for single queries, which are then searched apart.
    """
    return _routes(weighted(edges, profile), queries, avoid, limit)


def _routes(costs: DataFrame, queries: DataFrame, avoid: DataFrame | None = None, limit: float | None = None) -> DataFrame:
    """``routes`` over edges that are weighted already."""
    own = avoid is not None
    search = F.monotonically_increasing_id() if own else F.col("src").cast("long")
    q = durable(queries.select("query_id", search.alias("search"), F.col("src").cast("long").alias("from"), F.col("dst").cast("long").alias("target")), "queries")
    shut = avoid.join(q.select("query_id", "search"), "query_id").select("search", "u", "v") if own else None
    path = least_paths(costs, q.select("search", F.col("from").alias("node"), "target"), "cost", shut, limit)
    return q.join(path, ["search", "target"]).select("query_id", "pos", "node", "cost")


def alternatives(edges: DataFrame, queries: DataFrame, profile: str | dict = "adult") -> DataFrame:
    """The best route of each query that uses no edge of its first route in the direction travelled; kept if it has over two points."""
    first = routes(edges, queries, profile)
    w = Window.partitionBy("query_id").orderBy("pos")
    used = first.select("query_id", F.col("node").alias("u"), F.lead("node").over(w).alias("v")).where("v is not null")
    other = routes(edges, queries, profile, avoid=used)
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return other.withColumn("_n", n).where("_n > 2").drop("_n")


def matrix(edges: DataFrame, origins: DataFrame, destinations: DataFrame, profile: str | dict = "adult") -> DataFrame:
    """(origin_id, destination_id, cost, seconds, length_m) for all pairs with a path, origins (origin_id, node), destinations alike.

    One search from all origins; times and lengths are those of the least-cost path.
    """
    src, target = origins.select(F.col("node").alias("src")).distinct(), destinations.select(F.col("node").alias("target")).distinct()
    sums = measured(edges, src.join(target), profile)
    o = origins.select("origin_id", F.col("node").alias("src"))
    d = destinations.select("destination_id", F.col("node").alias("target"))
    return sums.join(o, "src").join(d, "target").select("origin_id", "destination_id", "cost", "seconds", "length_m")


def measured(edges: DataFrame, pairs: DataFrame, profile: str | dict = "adult") -> DataFrame:
    """(src, target, cost, seconds, length_m) of the least-cost path of each pair (src, target) that has one."""
    e = durable(weighted(edges, profile), "weighted")
    path = durable(least_paths(e, pairs.select(F.col("src").alias("search"), F.col("src").alias("node"), "target")).withColumnRenamed("search", "src"), "paths")
    legs = e.groupBy("u", "v").agg(F.min(F.struct("cost", "seconds", "length_m")).alias("e"))
    w = Window.partitionBy("src", "target").orderBy("pos")
    hop = path.select("src", "target", "node", F.lead("node").over(w).alias("v")).where("v is not null")
    sums = hop.join(legs, (hop["node"] == legs["u"]) & (hop["v"] == legs["v"])).groupBy("src", "target").agg(F.sum("e.cost").alias("cost"), F.sum("e.seconds").alias("seconds"), F.sum("e.length_m").alias("length_m"))
    zero = path.where("src = target").select("src", "target", *[F.lit(0.0).alias(c) for c in ("cost", "seconds", "length_m")])
    return sums.unionByName(zero)


def shared_ends(trips: DataFrame, nodes: DataFrame, membership: DataFrame, radius_m: float = 2500.0) -> DataFrame:
    """(query_id, src, dst, dist_m): the nodes at which each trip (query_id, olon, olat, dlon, dlat) joins the network.

    Of the components (node, component) that have nodes within the radius of both ends, that with the least way to them, then the one with most nodes;
    ``dist_m`` is that way. Without such a component both ends go to the node nearest to each, null where there is none, and ``dist_m`` is null.
    """
    n = nodes.select(F.col("id").alias("node"), F.col("lon").alias("tlon"), F.col("lat").alias("tlat")).join(membership.select("node", "component"), "node")
    sizes = membership.groupBy("component").agg(F.count(F.lit(1)).alias("size"))

    def ends(lon: str, lat: str, name: str) -> DataFrame:
        place = trips.select("query_id", F.col(lon).alias("lon"), F.col(lat).alias("lat"))
        near = _near_components(place, n, radius_m, name)
        near = place.join(near, (F.col("lon") == F.col("_lon")) & (F.col("lat") == F.col("_lat")))
        return durable(near.groupBy("query_id", "component").agg(F.min("best").alias(name)), name)

    a, b = ends("olon", "olat", "a"), ends("dlon", "dlat", "b")
    both = a.join(b, ["query_id", "component"]).join(sizes, "component")
    best = both.groupBy("query_id").agg(F.min(F.struct((F.col("a.dist_m") + F.col("b.dist_m")).alias("d"), (-F.col("size")).alias("size"), F.col("a.node").alias("src"), F.col("b.node").alias("dst"))).alias("s"))
    alone = trips.select("query_id").join(a.groupBy("query_id").agg(F.min("a").alias("a")), "query_id", "left").join(b.groupBy("query_id").agg(F.min("b").alias("b")), "query_id", "left")
    return alone.join(best, "query_id", "left").select("query_id", F.coalesce("s.src", "a.node").alias("src"), F.coalesce("s.dst", "b.node").alias("dst"), F.col("s.d").alias("dist_m"))


def shared_stops(stops: DataFrame, nodes: DataFrame, membership: DataFrame, radius_m: float = 2500.0) -> DataFrame:
    """(route_id, seq, node, component, dist_m): where the stops (route_id, seq, lon, lat) of each route, as many as there are, join the network, so that every leg has a path.

    Of the components (node, component) that have nodes within the radius of all stops of a route, that with the least way to them, then the one with most nodes, then the
    least one; in it each stop takes its nearest node. Without such a component every stop takes the node nearest to it, null where there is none. A stop with
    a null coordinate is near to none. Of stops with one number all count, and repeated ones are one. Other columns are not looked at; an empty table gives an empty result.
    """
    s = durable(stops.select("route_id", "seq", "lon", "lat").distinct(), "stops")
    n = nodes.select(F.col("id").alias("node"), F.col("lon").alias("tlon"), F.col("lat").alias("tlat")).join(membership.select("node", "component"), "node")
    sizes = membership.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    place = ["route_id", "seq", "lon", "lat"]
    met = _near_components(s, n, radius_m, "met")
    near = durable(s.join(met, (F.col("lon") == F.col("_lon")) & (F.col("lat") == F.col("_lat"))).select(*place, "component", "best"), "near")
    ways = near.groupBy("route_id", "component").agg(F.count(F.lit(1)).alias("met"), F.sum("best.dist_m").alias("way"))
    every = s.groupBy("route_id").agg(F.count(F.lit(1)).alias("met"))
    full = ways.join(every, ["route_id", "met"]).join(sizes, "component")
    chosen = full.groupBy("route_id").agg(F.min(F.struct("way", (-F.col("size")).alias("size"), "component")).alias("c")).select("route_id", F.col("c.component").alias("chosen"))
    # A stop's own component if it is the chosen one, else the nearest: one minimum over both.
    told = near.join(chosen, "route_id", "left").where("chosen is null or chosen = component")
    told = told.groupBy(*place).agg(F.min(F.struct("best.dist_m", "best.node", "component")).alias("t"))
    same = [s[c].eqNullSafe(told[c]) for c in place]
    return s.join(told, same[0] & same[1] & same[2] & same[3], "left").select(s["route_id"], s["seq"], "t.node", "t.component", "t.dist_m")


def multi_stop(edges: DataFrame, stops: DataFrame, profile: str | dict = "adult") -> DataFrame:
    """(route_id, leg, pos, node, cost) through each route's stops (route_id, seq, node) in order; a route with a leg that has no path has no rows."""
    w = Window.partitionBy("route_id").orderBy("seq")
    legs = stops.select("route_id", F.row_number().over(w).alias("leg"), F.col("node").alias("src"), F.lead("node").over(w).alias("dst")).where("dst is not null")
    legs = durable(legs.withColumn("query_id", F.struct("route_id", "leg")), "legs")
    found = durable(routes(edges, legs.select("query_id", "src", "dst"), profile), "found")
    lost = legs.join(found.select("query_id").distinct(), "query_id", "left_anti").select("route_id").distinct()
    out = found.select("query_id.route_id", "query_id.leg", "pos", "node", "cost")
    return out.join(lost, "route_id", "left_anti").where("leg = 1 or pos > 0")


def multimodal(edges: DataFrame, trips: DataFrame, hubs: DataFrame, nodes: DataFrame, access: str = "adult", ride: str = "car", egress: str = "adult", penalties: tuple = (2.0, 3.0, 0.0)) -> DataFrame:
    """(trip_id, minutes, length_m, transfers): access to the hub nearest the start, a ride to the nearest other hub of the end, egress.

    Trips are (trip_id, src, dst) and hubs (hub), all nodes. With under two hubs trips are direct. A trip with a leg that has no path is left out.
    """
    place = nodes.select(F.col("id").alias("node"), "lon", "lat")
    h = hubs.select(F.col("hub")).join(place.withColumnRenamed("node", "hub"), "hub").select("hub", F.col("lon").alias("hlon"), F.col("lat").alias("hlat"))
    ends = trips.join(place.select(F.col("node").alias("src"), F.col("lon").alias("slon"), F.col("lat").alias("slat")), "src").join(place.select(F.col("node").alias("dst"), F.col("lon").alias("dlon"), F.col("lat").alias("dlat")), "dst")
    if h.limit(2).count() < 2:
        legs = [(access, ends.select("trip_id", "src", "dst"))]
        penalties = (0.0,)
    else:
        # Hubs are interchanges of one region: paired with trips only after Spark has seen how many there are.
        pairs = ends.join(h)
        near = lambda lon, lat: geo.haversine(F.col(lon), F.col(lat), F.col("hlon"), F.col("hlat"))
        first = pairs.groupBy("trip_id").agg(F.min(F.struct(near("slon", "slat").alias("d"), "hub")).alias("a"))
        second = pairs.join(first, "trip_id").where(F.col("hub") != F.col("a.hub")).groupBy("trip_id").agg(F.min(F.struct(near("dlon", "dlat").alias("d"), "hub")).alias("b"))
        t = durable(ends.join(first, "trip_id").join(second, "trip_id").select("trip_id", "src", "dst", F.col("a.hub").alias("a"), F.col("b.hub").alias("b")), "trips")
        legs = [(access, t.select("trip_id", "src", F.col("a").alias("dst"))), (ride, t.select("trip_id", F.col("a").alias("src"), F.col("b").alias("dst"))), (egress, t.select("trip_id", F.col("b").alias("src"), "dst"))]
    # Legs of one profile are searched at once.
    by_mode: dict = {}
    for (mode, leg), wait in zip(legs, penalties, strict=True):
        one = leg.select("trip_id", "src", "dst", F.lit(float(wait)).alias("wait"))
        key = mode if isinstance(mode, str) else repr(mode)
        by_mode[key] = (mode, by_mode[key][1].unionByName(one) if key in by_mode else one)
    out = None
    for mode, leg in by_mode.values():
        m = measured(edges, leg.select("src", F.col("dst").alias("target")).distinct(), mode).withColumnRenamed("target", "dst")
        one = leg.join(m, ["src", "dst"]).select("trip_id", (F.col("seconds") / 60.0 + F.col("wait")).alias("minutes"), "length_m")
        out = one if out is None else out.unionByName(one)
    g = out.groupBy("trip_id").agg(F.sum("minutes").alias("minutes"), F.sum("length_m").alias("length_m"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") == len(legs)).select("trip_id", "minutes", "length_m", F.lit(len(legs) - 1).alias("transfers"))


def network_evacuation(edges: DataFrame, nodes: DataFrame, origins: DataFrame, musters: DataFrame, hazards: DataFrame, profile: str | dict = "adult", sample_m: float = 10.0) -> DataFrame:
    """(origin_id, muster_id, minutes, risk, clearance_m): of each origin's routes to all musters the one with the least minutes + risk / 60.

    Routes are sampled every ``sample_m``; each sample within a hazard (hlon, hlat, radius_m, severity) adds its depth times the severity.
    """
    from .spatial import within

    e = durable(weighted(edges, profile), "weighted")
    q = origins.select("origin_id", F.col("node").alias("src")).join(musters.select("muster_id", F.col("node").alias("dst")))
    q = durable(q.withColumn("query_id", F.struct("origin_id", "muster_id")), "queries")
    path = _routes(e, q.select("query_id", "src", "dst"))
    w = Window.partitionBy("query_id").orderBy("pos")
    hop = path.select("query_id", "pos", "node", F.lead("node").over(w).alias("v")).where("v is not null")
    legs = e.groupBy("u", "v").agg(F.min(F.struct("cost", "seconds")).alias("e"))
    a = nodes.select(F.col("id").alias("node"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    b = nodes.select(F.col("id").alias("v"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    hop = durable(hop.join(legs, (hop["node"] == legs["u"]) & (hop["v"] == legs["v"])).select("query_id", "pos", "node", hop["v"], "e.seconds").join(a, "node").join(b, "v"), "hops")
    steps = F.greatest(F.lit(1), F.ceil(geo.haversine(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")) / sample_m).cast("int"))
    s = hop.withColumn("n", steps).select("*", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("k")).where("k > 0 or pos = 0")
    f = F.col("k") / F.col("n")
    s = s.select("query_id", (F.col("lon1") + f * (F.col("lon2") - F.col("lon1"))).alias("lon"), (F.col("lat1") + f * (F.col("lat2") - F.col("lat1"))).alias("lat"))
    reach = (hazards.agg(F.max("radius_m")).first()[0] or 0.0) + 1000.0
    near = within(s, hazards.select(F.col("hlon").alias("tlon"), F.col("hlat").alias("tlat"), "radius_m", "severity"), reach)
    clear = F.col("dist_m") - F.col("radius_m")
    r = near.groupBy("query_id").agg(F.sum(F.when(clear < 0, -clear * F.col("severity")).otherwise(0.0)).alias("risk"), F.min(clear).alias("clearance_m"))
    t = hop.groupBy("query_id").agg((F.sum("seconds") / 60.0).alias("minutes")).join(r, "query_id", "left").fillna({"risk": 0.0, "clearance_m": 9999.0})
    best = t.groupBy("query_id.origin_id").agg(F.min(F.struct((F.col("minutes") + F.col("risk") / 60.0).alias("score"), F.col("query_id.muster_id").alias("muster_id"), "minutes", "risk", "clearance_m")).alias("b"))
    return best.select("origin_id", "b.muster_id", "b.minutes", "b.risk", "b.clearance_m")


def _near_components(places: DataFrame, nodes: DataFrame, radius_m: float, name: str) -> DataFrame:
    """(_lon, _lat, component, best): the nearest node (dist_m, node) of each component within the radius of each different place (lon, lat)."""
    from .spatial import within

    near = within(places.select("lon", "lat").where("lon is not null and lat is not null").distinct(), nodes, radius_m)
    best = near.groupBy(F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), "component").agg(F.min(F.struct("dist_m", "node")).alias("best"))
    return durable(best, name)
