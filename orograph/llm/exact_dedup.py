"""Exact duplicate removal over an extendible-hash index in shared files, in DataFrame operations only.

The directory is a table of key prefixes (slots). It starts with as many as the different keys need on average and is doubled until no slot has
more keys than a bucket's capacity; slots that fit into one bucket share it, which has the shortest prefix that suffices. Every row finds its
bucket by looking its key's slot up. Texts are compared by their bytes within their bucket: copies are combined before that
shuffle, so a text that a third of all rows share crosses it once per task. Owner tasks then take ranges of buckets, chain the entries of equal
keys and write them, each with the row that stays, into the index; rows look their entry up in their bucket's chain.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, fresh, keyed, stored, text_of

#: Bits by which a bucket's prefix can be shorter than a slot's.
SPAN = 8


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+", "")


def slot(key: Column, depth: int) -> Column:
    """The first ``depth`` bits of a signed 64-bit key, as a number from 0."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(_slot, bucket, bucket_depth) for each slot in use, and the depth: how many bits of a key its slot is.

    Doubles while a slot is overfull; as the keys are different, that ends. Nothing but totals comes to the driver.
    """
    keys = stored(keys.select("_key").distinct(), "dedup-keys")
    depth = max(0, ceil(log2(max(1, keys.count()) / capacity)))
    while True:
        counts = stored(keys.groupBy(slot(F.col("_key"), depth).alias("_slot")).agg(F.count(F.lit(1)).alias("n")), "dedup-slots")
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= capacity:
            break
        depth += max(1, int(log2(most / capacity)))
    span = min(depth, SPAN)
    # At most 2 ** SPAN slots are under one prefix.
    under = lambda k: Window.partitionBy(F.shiftright("_slot", span), F.shiftright("_slot", k))
    fits = [F.when(F.sum("n").over(under(k)) <= capacity, F.lit(k)) for k in range(span, 0, -1)]
    shorter = F.coalesce(*fits, F.lit(0))
    slots = counts.select("_slot", shorter.alias("k")).select(
        "_slot", F.expr("shiftleft(shiftright(_slot, k), k)").alias("bucket"), (F.lit(depth) - F.col("k")).alias("bucket_depth")
    )
    return stored(slots, "dedup-directory"), depth


def _index(texts: DataFrame, rows: DataFrame, row: list[str], capacity: int) -> tuple[DataFrame, DataFrame]:
    """The index of ``texts(_norm)``, whose ``rows`` have keys, digests and lengths; and ``rows`` with their buckets.

    Spark joins the directory by broadcast while its file is under the broadcast threshold, else by its slots.
    """
    slots, depth = directory(rows, capacity)

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("_slot", slot(F.col("_key"), depth)).join(slots, "_slot").drop("_slot")

    place = ["bucket", "bucket_depth", "_key"]
    entries = placed(texts.withColumn("_key", F.xxhash64("_norm"))).groupBy(*place, "_norm").agg(F.count(F.lit(1)).alias("group_size"))
    entries = entries.select(*place, F.sha2("_norm", 256).alias("text_sha256"), "group_size")
    rows = placed(rows)
    order = F.struct(-F.col("_points"), F.col("doc_id").isNull(), F.col("doc_id").alias("id"), *row)
    best = rows.groupBy("bucket", "_key", "text_sha256").agg(F.min(order).alias("_best"))
    owned = entries.join(best, ["bucket", "_key", "text_sha256"]).repartitionByRange("bucket", "_key")
    chain = Window.partitionBy("bucket", "_key").orderBy("text_sha256")
    clash = F.raise_error(F.lit("two different texts have the same SHA-256")).cast("int")
    again = F.lag("text_sha256").over(chain) == F.col("text_sha256")
    index = owned.withColumn("chain", F.when(again, clash).otherwise(F.row_number().over(chain)))
    return stored(index, "dedup-index"), rows


def build_index(documents: DataFrame, capacity: int = 50_000) -> DataFrame:
    """The chained index: bucket (first slot of its range), bucket_depth, _key, text_sha256, group_size, chain, _best (the row that stays).

    chain numbers the different texts of one key from 1. Fails if two different texts share a SHA-256. Empty for an empty table.
    """
    return _found(*_numbered(documents), capacity)[0]


def _numbered(documents: DataFrame) -> tuple[DataFrame, list[str]]:
    row = [fresh(documents, "_file"), fresh(documents, "_place")]
    return keyed(documents, *row), row


def _found(documents: DataFrame, row: list[str], capacity: int) -> tuple[DataFrame, DataFrame]:
    text = text_of(documents)
    norm = normalised(text)
    own = [F.col(c).alias(n) for c, n in zip(row, ("_file", "_place"), strict=True)]
    rows = documents.select(F.col("doc_id").alias("doc_id"), *own, F.length(text).cast("long").alias("_points"), norm.alias("_norm"))
    rows = stored(rows.select("doc_id", "_file", "_place", "_points", F.xxhash64("_norm").alias("_key"), F.sha2("_norm", 256).alias("text_sha256")), "dedup-rows")
    return _index(documents.select(norm.alias("_norm")), rows, ["_file", "_place"], capacity)


def _looked_up(index: DataFrame, rows: DataFrame) -> DataFrame:
    kept = (F.col("_file") == F.col("_best._file")) & (F.col("_place") == F.col("_best._place"))
    return rows.join(index.drop("bucket_depth"), ["bucket", "_key", "text_sha256"]).select(
        "doc_id", F.col("_best.id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", "bucket", "bucket_depth", "chain", "_file", "_place"
    )


def exact_duplicates(documents: DataFrame, capacity: int = 50_000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket, bucket_depth, chain.

    Texts are equal when their bytes are equal after white space is deleted; null counts as empty, and empty texts are
    equal to each other. The row with the most code points in its original text stays, then the smallest
    doc_id (null last); of rows equal in all that, one stays. Rows may share a doc_id. Other columns are not looked at. An empty table
    gives an empty result.
    """
    return _looked_up(*_found(*_numbered(documents), capacity)).drop("_file", "_place")


def without_duplicates(documents: DataFrame, capacity: int = 50_000) -> DataFrame:
    """The documents, all columns, that stay: one row of each group of equal texts, by the rules of ``exact_duplicates``.

    Rows are known by their place in the files, not by doc_id, so ids may repeat or be null; null and empty texts are one group. An empty
    table stays empty.
    """
    numbered, row = _numbered(documents)
    gone = _looked_up(*_found(numbered, row, capacity)).where("not kept").select(F.col("_file").alias(row[0]), F.col("_place").alias(row[1]))
    return numbered.join(gone, row, "left_anti").select(*documents.columns)


ORACLE = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
     g AS (SELECT text_sha256, count(*) AS group_size,
                  min_by(doc_id, struct_pack(a := -points, b := doc_id)) AS keep_id FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
