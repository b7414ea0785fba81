"""Helpers shared by the text operators: durable intermediate tables and connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durable import release, stored
from ..functions.durable import shared_folder as shared_dir

__all__ = ["SPACE", "WORD", "components", "fresh", "keyed", "looked_up", "release", "shared_dir", "slices", "stored", "text_of"]

#: The white space of every word and normalisation rule in this subpackage.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def keyed(df: DataFrame, file: str, place: str) -> DataFrame:
    """``df`` with two number columns that tell its rows apart, whatever they hold, and are the same each time it is read.

    A row of a file is known by a hash of the file's path and its place in it, which don't depend on how a scan is split. What is not
    as it stands in files is written first; call this once and go on with its result.
    """
    try:
        at = df.metadataColumn("_metadata")
        return df.select("*", F.xxhash64(at["file_path"]).alias(file), at["row_index"].alias(place))
    except AnalysisException:
        return keyed(stored(df, "rows"), file, place)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows``, so that a task holds Python objects of few texts at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column with null as the empty string."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def looked_up(df: DataFrame, lookup: DataFrame, key: str, how: str = "inner", most: int = 20_000, salts: int = 64) -> DataFrame:
    """Each row of ``df`` with the other columns of ``lookup``, which has one row a key; null keys are alike. Rows whose key it doesn't have go, or with ``how`` left have nulls there.

    A lookup of at most ``most`` rows, which are counted, is broadcast. A larger one is repeated ``salts`` times, so that a hot key is as many tasks.
    """
    own = lookup.withColumnRenamed(key, "_key")
    if own.count() <= most:
        return df.join(F.broadcast(own), df[key].eqNullSafe(own["_key"]), how).drop("_key")
    own = own.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    return salted.join(own, salted[key].eqNullSafe(own["_key"]) & (salted["_salt"] == own["_salt2"]), how).drop("_key", "_salt", "_salt2")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``: component is the smallest node reachable.

    Alternates large-star and small-star steps. Minima come from groupBy, which combines before the
    shuffle, and return by a join, which AQE can split, so a node with very many edges is no single task.
    Each round is stored. Edges may repeat, run either way or be loops.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        joined = both.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
                least.select(F.col("u").alias("a"), F.col("m").alias("b"))
            )
        return out.where("a <> b").distinct()

    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    sign = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).alias("s")
    before = now.agg(sign).first()[0]
    for _ in range(max_rounds):
        last = now
        now = stored(star(star(now, True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False), "edges")
        release(last)
        after = now.agg(sign).first()[0]
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
