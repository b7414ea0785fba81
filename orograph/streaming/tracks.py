"""Tracks as streams: windowed figures with a watermark, and running figures of each track in keyed state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.durable import shared_folder


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours", time: str = "ts", value: str = "value") -> DataFrame:
    """(begin, n, total, most): events in windows of their own time. As a stream, events over ``late`` behind the newest are dropped and closed windows leave the state."""
    e = events.withColumn("_ts", F.col(time).cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("_ts", late)
    g = e.groupBy(F.window("_ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"))
    return g.select(F.col("w.start").alias("begin"), "n", "total", "most")


def running(events: DataFrame, key: str = "user_id", value: str = "value") -> DataFrame:
    """(key, n, total) after each micro-batch for the keys that it has: the state of a key is two numbers, however many events it had."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for p in parts:
            n, total = n + len(p), total + float(p[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that its source has, and return what it wrote: the last result in mode complete, all batches' rows otherwise.

    A batch that is run again after a failure replaces its own folder, so its rows count once.
    """
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/{'batch=all' if mode == 'complete' else f'batch={number}'}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch string").parquet(f"{at}/out")
