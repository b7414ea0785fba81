"""Heights that were asked of a service, kept as a table that grows: what is wanted and not there yet is fetched in chunks and published as one more part.

A part is written under a hidden name and renamed when it is whole, so readers see all of it or nothing, a writer that is killed leaves nothing to be read, and two writers that meet
publish a part each. A place that has several values has that of the last part by name, and names begin with the time.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durable import durable
from ..functions.numbers import finite_or

#: Places are one if they agree in so many decimals; a request has so many of them.
PLACES, CHUNK = 5, 150
_SCHEMA = "x long, y long, value double"

Fetch = Callable[[Sequence[tuple[float, float]]], Sequence[float | None]]


def _key(c: Column) -> Column:
    """The coordinate in units of the last decimal, half to even; null for what is no number."""
    return F.rint(finite_or(c.cast("double"), None) * float(10**PLACES)).cast("long")


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def parts(spark: SparkSession, path: str) -> list[str]:
    """The published parts, oldest first."""
    system, place = _folder(spark, path)
    if not system.exists(place(path)):
        return []
    return sorted(s.getPath().toString() for s in system.listStatus(place(path)) if s.getPath().getName().startswith("part-"))


def publish(values: DataFrame, path: str) -> int:
    """Adds (x, y, value) as a part; gives the number of its rows, and publishes none if there are none."""
    spark = values.sparkSession
    system, place = _folder(spark, path)
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    hidden = f"{path}/_part-{name}"
    values.select("x", "y", "value").write.parquet(hidden)
    n = spark.read.schema(_SCHEMA).parquet(hidden).count()
    if n:
        if not system.rename(place(hidden), place(f"{path}/part-{name}")):
            raise OSError(f"{hidden} could not be published")
    else:
        system.delete(place(hidden), True)
    return n


def known(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, value) of every place that has a height, one row each."""
    there = parts(spark, path)
    if not there:
        return spark.createDataFrame([], _SCHEMA)
    rows = spark.read.schema(_SCHEMA).parquet(*there).select("x", "y", F.struct(F.element_at(F.split(F.input_file_name(), "/part-"), 2).alias("part"), "value").alias("v"))
    return rows.groupBy("x", "y").agg(F.max("v").alias("v")).select("x", "y", "v.value")


def seed(samples: DataFrame, path: str) -> int:
    """Publishes known heights (lon, lat, value); what isn't finite is left out."""
    s = samples.select(_key(F.col("lon")).alias("x"), _key(F.col("lat")).alias("y"), finite_or(F.col("value").cast("double"), None).alias("value"))
    return publish(s.where("x is not null and y is not null and value is not null").groupBy("x", "y").agg(F.max("value").alias("value")), path)


def prefetch(points: DataFrame, path: str, fetch: Fetch, chunk: int = CHUNK) -> tuple[int, int]:
    """Fetches the heights of points (lon, lat) that the store doesn't have: how many places it got, and how many it didn't.

    ``fetch`` takes at most ``chunk`` places and gives as many heights, in tasks. A chunk counts as a whole or not at all: one whose request fails, gives another number of heights or one that is no number stays wanted, and
    is asked for again the next time. Places that points share are asked for once.
    """
    spark = points.sparkSession
    want = points.select(_key(F.col("lon")).alias("x"), _key(F.col("lat")).alias("y")).where("x is not null and y is not null").distinct()
    want = durable(want.join(known(spark, path), ["x", "y"], "left_anti"), "wanted")
    scale = float(10**PLACES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, chunk):
                part = b.slice(i, chunk)
                places = [(x / scale, y / scale) for x, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                try:
                    found = [float(v) for v in fetch(places)]
                except Exception:  # whatever a service does, the chunk is asked for again
                    continue
                if len(found) == len(places) and all(map(math.isfinite, found)):
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], ["x", "y", "value"])

    got = publish(want.mapInArrow(run, _SCHEMA), path)
    return got, want.count() - got


def heights(points: DataFrame, path: str, *key: str) -> DataFrame:
    """(key..., value) of points (key..., lon, lat): null where the store has none, never 0 instead."""
    p = points.select(*key, _key(F.col("lon")).alias("x"), _key(F.col("lat")).alias("y"))
    return p.join(known(points.sparkSession, path), ["x", "y"], "left").select(*key, "value")
