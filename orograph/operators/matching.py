"""Map matching of GPS tracks by a hidden Markov model.

Candidates (edges within a radius, the nearest ten of a point) come from a cell join over all points at once. Long tracks are cut where the receiver was silent for
``gap_s``, as what lies before such a gap says nothing about what follows.

The most likely sequence of what is left is found by blocks of points, so that a track of any length is many tasks. A block of points is a matrix: the best score from each candidate of the point
before it to each of its last point. Matrices are multiplied with maximum for sum and sum for product, which is associative, in a tree of groups; on the way down each block learns the scores it begins with, and knows for each
candidate that it may end with the one it must have begun with. These maps are composed in the same tree, from the end, and then each block traces its own points back.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.durable import durable
from .spatial import at_place, near_segments, places_of, within

_OUT = "track_id {kind}, part int, seq long, u long, v long, lon double, lat double, residual_m double"
#: Numbers of points (by seq) that are a block, and blocks or nodes that are a node of the tree; sequences of one block that are walked side by side.
BLOCK, FAN, ABREAST = 256, 256, 64


def _metres(lon1, lat1, lon2, lat2):
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * geo.EARTH_M * np.arctan2(np.sqrt(a), np.sqrt(np.maximum(0, 1 - a)))


def _forward(rows: pd.DataFrame, sigma: float, beta: float, begin: np.ndarray | None, keep: bool = False) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Best scores [beginning, candidate of the last point] over ``rows`` (seq, rank order); the best candidates before each one, for the first beginning; and where each point's rows start.

    ``begin`` are scores [beginning, candidate] of the first point; without them it has its own likelihood.
    """
    starts = np.flatnonzero(np.r_[True, np.diff(rows["seq"].to_numpy()) != 0])
    ends = np.r_[starts[1:], len(rows)]
    emit = -0.5 * (rows["dist_m"].to_numpy() / sigma) ** 2 - math.log(math.sqrt(2 * math.pi) * sigma)
    x, y, lon, lat = (rows[c].to_numpy() for c in ("snap_lon", "snap_lat", "lon", "lat"))
    score, back = emit[None, starts[0] : ends[0]] if begin is None else begin, []
    for a, b, c, d in zip(starts, ends, starts[1:], ends[1:], strict=False):
        straight = _metres(lon[a], lat[a], lon[c], lat[c])
        between = _metres(x[a:b, None], y[a:b, None], x[None, c:d], y[None, c:d])
        total = score[:, :, None] - (np.abs(straight - between) / beta)[None] - math.log(beta)
        if keep:
            back.append(total[0].argmax(axis=0))
        score = total.max(axis=1) + emit[c:d]
    return score, back, starts


def most_likely(rows: pd.DataFrame, sigma: float, beta: float) -> np.ndarray:
    """Positions in ``rows`` (seq, rank order) of the best candidate of each point; of equals the one of the lower rank."""
    score, back, starts = _forward(rows, sigma, beta, None, True)
    return starts + _traced(back, int(score[0].argmax()))


def most_likely_of_many(rows: pd.DataFrame, sequence: np.ndarray, sigma: float, beta: float) -> np.ndarray:
    """``most_likely`` of each of the sequences in ``rows`` (sequence, seq, rank order), all walked at once: one step of all of them is a few operations on arrays."""
    starts = np.flatnonzero(np.r_[True, (np.diff(sequence) != 0) | (np.diff(rows["seq"].to_numpy()) != 0)])
    n = np.diff(np.r_[starts, len(rows)])
    at = np.minimum(starts[:, None] + np.arange(n.max()), len(rows) - 1)  # [point, rank]
    none = np.arange(n.max()) >= n[:, None]
    emit = np.where(none, -np.inf, -0.5 * (rows["dist_m"].to_numpy()[at] / sigma) ** 2 - math.log(math.sqrt(2 * math.pi) * sigma))
    x, y = (rows[c].to_numpy()[at] for c in ("snap_lon", "snap_lat"))
    lon, lat = (rows[c].to_numpy()[starts] for c in ("lon", "lat"))
    first = np.flatnonzero(np.r_[True, np.diff(sequence[starts]) != 0])
    length = np.diff(np.r_[first, len(starts)])
    score, back, best = emit.copy(), np.zeros(at.shape, np.int64), np.empty(len(starts), np.int64)
    for t in range(1, length.max()):
        p = first[length > t] + t
        straight = _metres(lon[p - 1], lat[p - 1], lon[p], lat[p])
        between = _metres(x[p - 1][:, :, None], y[p - 1][:, :, None], x[p][:, None], y[p][:, None])
        total = score[p - 1][:, :, None] - np.abs(straight[:, None, None] - between) / beta - math.log(beta)
        back[p] = total.argmax(axis=1)
        score[p] = total.max(axis=1) + emit[p]
    for t in reversed(range(length.max())):
        p, ends = first[length > t] + t, length[length > t] == t + 1
        best[p[ends]] = score[p[ends]].argmax(axis=1)
        on = p[~ends]
        best[on] = back[on + 1, best[on + 1]]
    return starts + best


def _traced(back: list[np.ndarray], at: int) -> np.ndarray:
    path = [at]
    for step in reversed(back):
        at = int(step[at])
        path.append(at)
    return np.array(path[::-1])


def _times(a: tuple[int, list[float]], b: tuple[int, list[float]]) -> tuple[int, list[float]]:
    """The product of two matrices (rows, values) with maximum for sum and sum for product."""
    m, n = np.array(a[1]).reshape(a[0], -1), np.array(b[1]).reshape(b[0], -1)
    return a[0], (m[:, :, None] + n[None]).max(axis=1).ravel().tolist()


def _then(a: tuple[int, list[float]], b: tuple[int, list[float]]) -> tuple[int, list[float]]:
    """Two maps as one: first ``a``, then ``b``."""
    return a[0], [b[1][int(i)] for i in a[1]]


def _scan(items: DataFrame, begin: DataFrame, combine: Callable, blocks: int, backwards: bool, fan: int, kind: str) -> DataFrame:
    """(track_id, part, idx, v): what each item (track_id, part, idx, n, v) of a sequence begins with, if the sequence begins with ``begin`` (track_id, part, v) and an item makes of that ``combine`` of both.

    Up a tree of groups of ``fan`` items and down again.
    """
    key, schema = ["track_id", "part"], f"track_id {kind}, part int, idx long, n int, v array<double>"

    def ordered(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values("idx", ascending=not backwards, ignore_index=True)

    def up(rows: pd.DataFrame) -> pd.DataFrame:
        rows = ordered(rows)
        n, v = int(rows["n"][0]), list(rows["v"][0])
        for m, w in zip(rows["n"][1:], rows["v"][1:], strict=True):
            n, v = combine((n, v), (int(m), list(w)))
        return pd.DataFrame({"track_id": rows["track_id"][:1], "part": rows["part"][:1], "idx": rows["idx"][:1] // fan, "n": [n], "v": [v]})

    def down(rows: pd.DataFrame) -> pd.DataFrame:
        rows = ordered(rows)
        now, out = list(rows["start"][0]), []
        for m, w in zip(rows["n"], rows["v"], strict=True):
            out.append(now)
            now = combine((1, now), (int(m), list(w)))[1]
        return pd.DataFrame({"track_id": rows["track_id"], "part": rows["part"], "idx": rows["idx"], "n": 1, "v": out})

    node = F.floor(F.col("idx") / fan).cast("long")
    levels = [items]
    while blocks > fan:
        levels.append(durable(levels[-1].groupBy(*key, node.alias("node")).applyInPandas(up, schema), "level"))
        blocks = -(-blocks // fan)
    starts = begin.select(*key, F.lit(0).cast("long").alias("node"), F.col("v").alias("start"))
    for level in reversed(levels):
        met = level.withColumn("node", node).join(starts, [*key, "node"])
        found = durable(met.groupBy(*key, "node").applyInPandas(down, schema), "starts")
        starts = found.select(*key, F.col("idx").alias("node"), F.col("v").alias("start"))
    return found.drop("n")


def _found(best: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"track_id": best["track_id"], "part": best["part"], "seq": best["seq"], "u": best["u"], "v": best["v"], "lon": best["snap_lon"], "lat": best["snap_lat"], "residual_m": best["dist_m"]})


def _paths(every: DataFrame, sigma: float, beta: float, block: int, fan: int, kind: str) -> DataFrame:
    """The best candidate of each point among ``every`` (track_id, part, seq, _k, ...), parts of a single point left out."""
    key = ["track_id", "part"]
    every = durable(every.withColumn("_block", F.floor(F.col("seq") / block)), "candidates")
    w = Window.partitionBy(*key).orderBy("_block")  # a row a block
    told = every.groupBy(*key, "_block").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    told = told.select("*", F.lag("last").over(w).alias("before"), (F.row_number().over(w) - 1).cast("long").alias("idx"), F.lead("first").over(w).isNull().alias("ends"))
    told = durable(told.where("first < last or before is not null or not ends"), "blocks")
    n, blocks, alone = told.agg(F.count(F.lit(1)), F.max("idx"), F.count_if(F.col("ends") & F.col("before").isNull())).first()
    blocks = (blocks or 0) + 1
    # Sequences of one block need no tree.
    single = told.where("ends and before is null").select(*key)
    columns = ["seq", "_k", "lon", "lat", "u", "v", "snap_lon", "snap_lat", "dist_m"]
    groups = -(-max(1, alone) // ABREAST)
    # The number is given so that few bytes, which stand for much work, stay many tasks.
    tasks = max(1, min(groups, int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    bucket = F.pmod(F.xxhash64(*key), F.lit(groups)).alias("_bucket")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*key, "seq", "_k"], kind="stable", ignore_index=True)
        best = rows.iloc[most_likely_of_many(rows, rows.groupby(key, sort=False).ngroup().to_numpy(), sigma, beta)]
        return _found(best)

    whole = every.join(single, key).select(bucket, *key, *columns).repartition(tasks, "_bucket").groupBy("_bucket").applyInPandas(walk, _OUT.format(kind=kind))
    if n == alone:
        return whole
    told = told.join(single, key, "left_anti")
    own = every.join(told.select(*key, "_block", "idx"), [*key, "_block"]).select(*key, "idx", F.lit(False).alias("_entry"), *columns)
    entry = every.join(told.where("before is not null").select(*key, F.col("before").alias("seq"), "idx"), [*key, "seq"]).select(*key, "idx", F.lit(True).alias("_entry"), *columns)
    leaves = durable(own.unionByName(entry), "leaves")

    def ordered(rows: pd.DataFrame) -> tuple[pd.DataFrame, int]:
        rows = rows.sort_values(["seq", "_k"], kind="stable", ignore_index=True)
        return rows, int(rows["_entry"].sum())

    def named(rows: pd.DataFrame, **more: list) -> pd.DataFrame:
        return pd.DataFrame({"track_id": rows["track_id"][:1], "part": rows["part"][:1], "idx": rows["idx"][:1], **more})

    def matrix(rows: pd.DataFrame) -> pd.DataFrame:
        rows, n = ordered(rows)
        same = np.where(np.eye(n, dtype=bool), 0.0, -np.inf) if n else None
        score, _, _ = _forward(rows, sigma, beta, same)
        return named(rows, n=[max(1, n)], v=[score.ravel().tolist()])

    schema = f"track_id {kind}, part int, idx long, n int, v array<double>"
    group = [*key, "idx"]
    matrices = durable(leaves.groupBy(*group).applyInPandas(matrix, schema), "matrices")
    begin = told.select(*key).distinct().withColumn("v", F.array(F.lit(0.0)))
    begun = _scan(matrices, begin, _times, blocks, False, fan, kind).withColumnRenamed("v", "_start")
    ready = durable(leaves.join(begun, group), "begun")

    def before(rows: pd.DataFrame) -> pd.DataFrame:
        """For each candidate of the last point the one of the entry; for the last block's sake also the best of the last point, behind them."""
        rows, n = ordered(rows)
        score, back, _ = _forward(rows, sigma, beta, np.array([rows["_start"][0]]) if n else None, True)
        at = np.arange(score.shape[1])
        for step in reversed(back):
            at = step[at]
        return named(rows, n=[1], v=[[*at.astype(float).tolist(), float(score[0].argmax())]])

    maps = durable(ready.groupBy(*group).applyInPandas(before, schema), "maps")
    last = maps.join(told.where("ends").select(*group), group).select(*key, F.slice("v", -1, 1).alias("v"))
    ended = _scan(maps, last, _then, blocks, True, fan, kind).select(*group, F.col("v")[0].cast("int").alias("_end"))

    def path(rows: pd.DataFrame) -> pd.DataFrame:
        rows, n = ordered(rows)
        _, back, starts = _forward(rows, sigma, beta, np.array([rows["_start"][0]]) if n else None, True)
        best = rows.iloc[(starts + _traced(back, int(rows["_end"][0])))[1 if n else 0 :]]
        return _found(best)

    return whole.unionByName(ready.join(ended, group).groupBy(*group).applyInPandas(path, _OUT.format(kind=kind)))


def match_tracks(
    points: DataFrame, edges: DataFrame, nodes: DataFrame, radius_m: float = 35.0, sigma: float = 4.07, beta: float = 3.0, candidates: int = 10, gap_s: float | None = 1800.0,
    block: int = BLOCK, fan: int = FAN,
) -> DataFrame:
    """(track_id, part, seq, u, v, lon, lat, residual_m): each point of a track (track_id, seq, lon, lat[, ts]) on the edge it most likely ran on.

    Candidates are directed edges (u, v, lon1, lat1, lon2, lat2). A point without one in the radius takes the nearest node within a hundred radii, as both ends
    of an edge; without that it is left out. Points with a bad place, and parts of a single point, are left out. Parts are numbered
    from 0 where ``ts`` is given; without it a track is one part. Points without a track_id are left out. Blocks are ``block`` values of seq, which counts the points of a track.
    """
    p = points.where("abs(lon) <= 180 and abs(lat) <= 90")
    w = Window.partitionBy("track_id").orderBy("seq")
    if gap_s is not None and "ts" in points.columns:
        silent = F.coalesce(F.col("ts").cast("timestamp").cast("double") - F.lag(F.col("ts").cast("timestamp").cast("double")).over(w) > gap_s, F.lit(False)).cast("int")
        p = p.withColumn("_gap", silent).withColumn("part", F.sum("_gap").over(w).cast("int"))
    else:
        p = p.withColumn("part", F.lit(0))
    p = durable(p.select("track_id", "part", "seq", "lon", "lat"), "points")
    # Points at one place have the same candidates in the same order.
    columns = ["_lon", "_lat", "lon", "lat", "u", "v", "snap_lon", "snap_lat", "dist_m", "_k"]
    places = durable(places_of(p), "places")
    rank = F.row_number().over(Window.partitionBy("_lon", "_lat").orderBy("dist_m", "u", "v"))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = durable(near_segments(places, edges, radius_m, tasks).withColumn("_k", rank).where(F.col("_k") <= candidates).select(*columns), "near")
    lost = places.join(near.select("_lon", "_lat").distinct(), ["_lon", "_lat"], "left_anti")
    n = nodes.select(F.col("id").alias("u"), F.col("lon").alias("tlon"), F.col("lat").alias("tlat"))
    nearest = F.row_number().over(Window.partitionBy("_lon", "_lat").orderBy("dist_m", "u"))
    other = within(lost, n, 100 * radius_m).withColumn("_k", nearest).where("_k = 1").withColumns({"v": F.col("u"), "snap_lon": F.col("tlon"), "snap_lat": F.col("tlat")})
    every = at_place(p, durable(near.unionByName(other.select(*columns)), "found"))

    return _paths(every, max(1e-4, sigma), max(1e-4, beta), block, fan, points.schema["track_id"].dataType.simpleString())


def track_summary(matched: DataFrame) -> DataFrame:
    """(track_id, points, mean_error_m, distance_m) of matched tracks; distances are between snapped places of one part."""
    w = Window.partitionBy("track_id", "part").orderBy("seq")
    step = geo.haversine(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    return matched.withColumn("_d", F.coalesce(step, F.lit(0.0))).groupBy("track_id").agg(F.count(F.lit(1)).alias("points"), F.avg("residual_m").alias("mean_error_m"), F.sum("_d").alias("distance_m"))
