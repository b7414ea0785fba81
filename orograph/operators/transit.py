"""Scheduled transit: the earliest arrival with one ride between walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .spatial import within

#: The radius of this module's distances.
EARTH_M = 6371000.0


def seconds_of(time: str):
    """Seconds from a HH:MM[:SS] column; hours may pass 24."""
    p = F.split(F.trim(F.col(time)), ":")
    return p[0].cast("int") * 3600 + F.coalesce(F.try_element_at(p, F.lit(2)).cast("int"), F.lit(0)) * 60 + F.coalesce(F.try_element_at(p, F.lit(3)).cast("int"), F.lit(0))


def clock(seconds):
    """HH:MM:SS of a day from a column of seconds."""
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600) % 24, F.floor(seconds / 60) % 60, seconds % 60)


def earliest_arrival(trips: DataFrame, stops: DataFrame, stop_times: DataFrame, walk_kmh: float = 4.8, max_walk_m: float = 1200.0) -> DataFrame:
    """Per asked trip (query_id, olon, olat, dlon, dlat, depart_s): the earliest arrival, walking or with one ride.

    Of a trip's boardings at a stop the last one that is still before the alighting counts, as a scan along the trip would have it. Of equal
    arrivals walking, then the least (trip, boarding, alighting) wins. Times rise along a trip, so rides that don't beat walking are left out
    before boardings and alightings meet.
    """
    speed = max(0.5, walk_kmh / 3.6)
    stop = stops.select("stop_id", F.col("lon").alias("tlon"), F.col("lat").alias("tlat"))
    walk = F.floor(geo.haversine(F.col("olon"), F.col("olat"), F.col("dlon"), F.col("dlat"), EARTH_M) / speed)
    trips = trips.withColumn("walk_s", walk)

    def reach(lon: str, lat: str, name: str) -> DataFrame:
        p = trips.select("query_id", "depart_s", (F.col("depart_s") + F.col("walk_s")).alias("limit_s"), F.col(lon).alias("lon"), F.col(lat).alias("lat"))
        # Cells are sized by the core radius, a little larger than this one's, so take a slightly wider reach and filter exactly.
        d = geo.haversine(F.col("lon"), F.col("lat"), F.col("tlon"), F.col("tlat"), EARTH_M)
        near = within(p, stop, max_walk_m * 1.001).withColumn("m", d).where(F.col("m") <= max_walk_m)
        return near.select("query_id", "depart_s", "limit_s", F.col("stop_id").alias(f"{name}_stop"), F.floor(F.col("m") / speed).alias(f"{name}_walk_s"))

    board, alight = reach("olon", "olat", "board"), reach("dlon", "dlat", "alight").drop("depart_s")
    on = board.join(stop_times.select("trip_id", F.col("stop_id").alias("board_stop"), F.col("stop_sequence").alias("board_seq"), F.col("departure_s").alias("board_s")), "board_stop")
    on = on.where((F.col("board_s") >= F.col("depart_s") + F.col("board_walk_s")) & (F.col("board_s") < F.col("limit_s"))).drop("limit_s")
    off = alight.join(stop_times.select("trip_id", F.col("stop_id").alias("alight_stop"), F.col("stop_sequence").alias("alight_seq"), F.col("arrival_s").alias("alight_s")), "alight_stop")
    off = off.where(F.col("alight_s") + F.col("alight_walk_s") < F.col("limit_s")).drop("limit_s")
    ride = on.join(off, ["query_id", "trip_id"]).where("board_seq < alight_seq and board_stop <> alight_stop")
    # The scan stops at the first alighting after a boarding, having moved on to the last boarding before it.
    first = Window.partitionBy("query_id", "trip_id", "board_stop", "alight_stop")
    ride = ride.withColumn("_a", F.min("alight_seq").over(first)).where("alight_seq = _a").withColumn("_b", F.max("board_seq").over(first)).where("board_seq = _b")
    ride = ride.withColumn("arrive_s", F.col("alight_s") + F.col("alight_walk_s"))
    best = ride.groupBy("query_id").agg(F.min(F.struct("arrive_s", "trip_id", "board_stop", "alight_stop", "board_s", "alight_s", "board_walk_s", "alight_walk_s")).alias("r"))
    q = trips.join(best, "query_id", "left")
    rides = F.col("r").isNotNull() & (F.col("r.arrive_s") < F.col("depart_s") + F.col("walk_s"))
    pick = lambda c, other: F.when(rides, F.col(f"r.{c}")).otherwise(other)
    return q.select(
        "query_id", F.when(rides, "TRANSIT").otherwise("WALK").alias("mode"), pick("arrive_s", F.col("depart_s") + F.col("walk_s")).alias("arrive_s"),
        pick("trip_id", F.lit(None)).alias("trip_id"), pick("board_stop", F.lit(None)).alias("board_stop"), pick("alight_stop", F.lit(None)).alias("alight_stop"),
        F.when(rides, F.col("r.board_walk_s") + F.col("r.alight_walk_s")).otherwise(F.col("walk_s")).alias("walk_s"),
        F.when(rides, F.col("r.alight_s") - F.col("r.board_s")).otherwise(0).alias("ride_s"),
    )
