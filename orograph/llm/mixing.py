"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is how often each of its documents should be taken. The whole part is taken as it is; the fraction left is
the probability of one copy more. Two documents of a source meet: words of probability go from one to the other, at random in which
direction but so that neither changes on average, until one is surely taken or surely left; the other goes on to meet the next. So
the words of the mix stay what the fractions promised, up to the one document left at the end.

- Documents of a source meet in blocks of some thousand that follow from their ids and sizes, largest first. Where sizes halve, the large document
  left over meets all smaller ones of its block at once, which share one fraction. What a block leaves is thus one of its small documents.
- What blocks leave meets in a reduction tree, a group of nodes a task, level by level; the root's last one is decided by its probability.

Rows that agree in source, id and size are one unit with a count from the first shuffle on, so copies are no hot group, and a source has as many
blocks as it needs. Results depend on the rows and the seed only, not on files, tasks or their order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, looked_up, release, stored, text_of

#: Sources by code point, null last, weigh so, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix over words of all documents, and the most that a source's target may be over its size.
SHARE, MOST = 1.5, 2.0
#: Units that meet in a block, and nodes that meet in a node of the next level.
BLOCK, FAN = 4096, 256
#: Copies of a unit that a row is made into at once.
PIECE = 1000
_NEAR = 1e-12


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, source, size): words of each row's whole text, none in a null."""
    return docs.select("doc_id", docs["source"].cast("string").alias("source"), F.regexp_count(text_of(docs, text), F.lit(WORD)).cast("long").alias("size"))


def _numbered(df: DataFrame, by: Column) -> DataFrame:
    """``df`` with ``number``, its rows' places from 0 in the order of ``by``: sorted by ranges, which are then counted."""
    at = F.monotonically_increasing_id()
    placed = stored(df.repartitionByRange(by).sortWithinPartitions(by).select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "numbered")
    # One row a partition.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", before.alias("_before"))
    return placed.join(parts, "_part").withColumn("number", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` (source, source_size, ...) with ``number`` and ``target``.

    All sizes times ``share`` are dealt out by weight. What is over ``most`` times a source's size is dealt out again to those below by weight, until no target
    is above. The level at which that ends rises from round to round, so a round is one aggregate over the sources.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    weighed = stored(_numbered(sources, F.col("source").asc_nulls_last()).select("*", weight.alias("_w"), (F.col("source_size") * most).alias("_cap")), "weighed")
    whole = (weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        full = F.col("_cap") < F.lit(level) * F.col("_w")
        taken, below = weighed.agg(F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("_w"))), F.lit(0.0))).first()
        left = max(0.0, whole - taken)
        higher = left / below if below else float("inf")
        if higher <= level or not below:
            break
        level = higher
    # With the set of full sources that the last round saw.
    target = F.when(full, F.col("_cap")).otherwise(F.lit(left) * F.col("_w") / F.lit(below or 1.0))
    return weighed.withColumn("target", target).drop("_w", "_cap")


def meet(a: tuple[float, float], b: tuple[float, float], luck: float) -> tuple[float, float]:
    """New probabilities of two documents (size, probability): one is 0 or 1 then, the words promised are the same, and so is each on average."""
    (s, p), (t, q) = a, b
    up, down = min(s * (1 - p), t * q), min(s * p, t * (1 - q))
    x = up if luck * (up + down) < down else -down
    return tuple(0.0 if v < _NEAR else 1.0 if v > 1 - _NEAR else v for v in (p + x / s, q - x / t))


def settle(size: np.ndarray, p: np.ndarray, single: np.ndarray, luck: np.ndarray) -> np.ndarray:
    """Probabilities after all of a block met, largest size first: 0 or 1 but for at most one.

    ``single`` rows start with one and the same probability. Where sizes halve, the one left over meets all singles yet to come as one.
    """
    out = p.copy()
    step = np.floor(np.log2(size))
    ahead = np.concatenate([np.cumsum((size * single)[::-1])[::-1], [0.0]])
    shift, left, draws = 0.0, -1, iter(luck)
    for i in range(len(size)):
        if left >= 0 and step[i] < step[i - 1] and ahead[i]:
            common = float(out[i + np.argmax(single[i:])]) + shift
            out[left], new = meet((size[left], out[left]), (ahead[i], min(1.0, max(0.0, common))), next(draws)) if 0 < common < 1 else (out[left], common)
            shift += new - common
            left = left if 0 < out[left] < 1 else -1
        if single[i]:
            v = out[i] + shift
            out[i] = 0.0 if v < _NEAR else 1.0 if v > 1 - _NEAR else v
        if 0 < out[i] < 1:
            if left >= 0:
                out[left], out[i] = meet((size[left], out[left]), (size[i], out[i]), next(draws))
                left = left if 0 < out[left] < 1 else i if 0 < out[i] < 1 else -1
            else:
                left = i
    return out


def _block(seed: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("size", "descending"), ("_h", "ascending"), ("doc_id", "ascending")])
        size, many, part = (rows[c].to_numpy(zero_copy_only=False) for c in ("size", "many", "_part"))
        promised = np.where(size > 0, many * part, 0.0)
        sure = np.floor(promised)
        p, single = promised - sure, many == 1
        live = np.flatnonzero((p > 0) & (size > 0))
        rng = np.random.default_rng((seed, int(rows["number"][0].as_py()), int(rows["_block"][0].as_py())))
        after = settle(size[live].astype(float), p[live], single[live], rng.random(2 * len(live) + 2)) if len(live) else p[live]
        extra, undecided = sure.astype("int64"), np.full(len(size), np.nan)
        extra[live] += after == 1
        undecided[live] = np.where((after > 0) & (after < 1), after, np.nan)
        return rows.drop_columns(["_h", "_part"]).append_column("extra", pa.array(extra)).append_column("open", pa.array(undecided, from_pandas=True))

    return run


def _node(seed: int, level: int, root: bool) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("size", "descending"), ("_block", "ascending")])
        size, p = (rows[c].to_numpy(zero_copy_only=False) for c in ("size", "open"))
        rng = np.random.default_rng((seed, int(rows["number"][0].as_py()), int(rows["node"][0].as_py()), level))
        after = settle(size.astype(float), p.astype(float), np.zeros(len(p), bool), rng.random(len(p) + 1))
        if root:
            after = np.where((after > 0) & (after < 1), rng.random() < after, after)
        undecided = np.where((after > 0) & (after < 1), after, np.nan)
        rows = rows.drop_columns(["open"]).append_column("open", pa.array(undecided, from_pandas=True))
        return rows.append_column("up", pa.array((after == 1).astype("int64")))

    return run


def reduced(left: DataFrame, nodes: int, seed: int, fan: int = FAN) -> DataFrame:
    """(number, _block, up): what becomes of the one undecided unit (number, _block, size, open) of each block, of at most ``nodes`` a source.

    Each level's nodes are ``fan`` times fewer; a node is a group of at most ``fan`` rows.
    """
    decided, level = None, 0
    now = left.withColumn("node", F.col("_block"))
    while True:
        root = nodes <= fan
        met = now.withColumn("node", F.floor(F.col("node") / fan).cast("long")).select("number", "_block", "size", "node", "open")
        met = stored(met.groupBy("number", "node").applyInArrow(_node(seed, level, root), "number long, _block long, size long, node long, open double, up long"), "node")
        here = met.where("open is null").select("number", "_block", "up")
        decided = here if decided is None else decided.unionByName(here)
        if root:
            return decided
        now, nodes, level = met.where("open is not null").drop("up"), -(-nodes // fan), level + 1


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11, block: int = BLOCK, fan: int = FAN, text: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of ``docs`` (doc_id, source, text).

    ``copies`` is the number of times that the mix takes the row, ``taken`` its words in all copies. Copies are the whole part of target over source_size, or one
    more. A source's taken words miss its target by less than the words of one document, as a rule a small one of the source.

    A null text has no words; rows without words get copies too, which take no words: the whole part only. A null source is a source, the last one. Rows
    that share an id stay rows of their own, equal rows are told apart by nothing, so which of them gets the copy more is left open; their counts are not. Texts of any
    length are counted whole. Extra columns play no part, whatever their names. An empty table gives no row.
    """
    units = stored(sized(docs, text).groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("many")), "units")
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("many")).alias("source_size"), F.count(F.lit(1)).alias("_units"))
    aimed = stored(targets(sources, weights, share, most), "sources")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aimed = aimed.select("*", F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("_part"), F.ceil(F.col("_units") / block).cast("long").alias("_blocks"))
    nodes = aimed.agg(F.max("_blocks")).first()[0] or 1
    placed = looked_up(units, aimed, "source").withColumn("_h", F.xxhash64("doc_id", "size"))
    placed = placed.withColumn("_block", F.pmod("_h", "_blocks")).drop("_blocks", "_units")
    kept = [f for f in placed.schema if f.name not in ("_h", "_part")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", extra long, open double"
    order = [f.name for f in kept] + ["_h", "_part"]
    met = stored(placed.select(*order).groupBy("number", "_block").applyInArrow(_block(seed), schema), "blocks")
    ups = reduced(met.where("open is not null").select("number", "_block", "size", "open"), nodes, seed, fan)
    late = met.where("open is not null").join(ups, ["number", "_block"]).withColumn("extra", F.col("extra") + F.col("up")).drop("up")
    done = met.where("open is null").unionByName(late)
    one = done.where("many = 1").withColumn("_row", F.lit(0).cast("long"))
    # Rows of a unit, PIECE at a time, dealt out in between.
    pieces = done.where("many > 1").withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("many") - 1) / PIECE)))).repartition("number", "doc_id", "_piece")
    first = F.col("_piece") * PIECE
    more = pieces.withColumn("_row", F.explode(F.sequence(first, F.least(first + PIECE, F.col("many")) - 1))).drop("_piece")
    copies = F.col("whole") + F.when(F.col("_row") < F.col("extra"), 1).otherwise(0)
    out = one.unionByName(more).withColumn("copies", copies.cast("long"))
    release(units)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
