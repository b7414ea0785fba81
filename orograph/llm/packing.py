"""Packing token sequences by linear grouping, a configuration program and best fit.

Lengths are whole numbers up to the capacity, so all that the plan needs of the corpus is how many pieces have
each length: as many counts as the capacity, however large the corpus. The driver plans on them:

1. Lengths over a share of the capacity are sorted and cut into groups of equal cardinality; each is rounded up
   to the largest of its group.
2. The configuration program over these few sizes is solved by column generation (a knapsack prices new
   configurations); each configuration is used as often as the solution's whole part says.
3. The actual pieces, longest of a group first, take the slots of their size. What remains of the long ones is packed by
   best fit, longest first.
4. Short pieces go by best fit into the space that the actual lengths leave.

This is done for a few shares and numbers of groups, and the one that needs the fewest sequences counts.

The plan is a list of runs: pieces of one length, with ranks from ``first`` to ``end``, go to consecutive sequences at one
offset. Tasks give every piece its rank and look its run up. No sequence, list of pieces or text passes the driver.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from bisect import bisect_left, insort
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import SpaceMemo
from .common import slices, stored, text_of


def grouped(counts: dict[int, int], over: int, groups: int) -> dict[int, int]:
    """Linear grouping: the size that each length above ``over`` is rounded up to."""
    lengths = sorted((n for n in counts if n > over), reverse=True)
    each = max(1, -(-sum(counts[n] for n in lengths) // groups))
    size_of, filled, size = {}, each, 0
    for n in lengths:
        if filled >= each:
            size, filled = n, 0
        size_of[n] = size
        filled += counts[n]
    return size_of


def configurations(demand: dict[int, int], capacity: int, rounds: int = 400) -> list[tuple[float, dict[int, int]]]:
    """Column generation for the configuration program: (times, {size: how many}) of a basic solution.

    The basis starts with one configuration per size; each round prices configurations by an unbounded knapsack over
    the dual values and pivots the best one in.
    """
    sizes = np.array(sorted(demand))
    if not len(sizes):
        return []
    need = np.array([float(demand[n]) for n in sizes])
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        duals = np.ones(len(sizes)) @ inverse
        value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for at in range(int(sizes[0]), capacity + 1):
            fits = sizes[: np.searchsorted(sizes, at, "right")]
            gain = value[at - fits] + duals[: len(fits)]
            k = int(gain.argmax())
            if gain[k] > value[at - 1]:
                value[at], choice[at] = gain[k], k
            else:
                value[at] = value[at - 1]
        if value[capacity] <= 1 + 1e-7:
            break
        column, at = np.zeros(len(sizes)), capacity
        while at > 0:
            if choice[at] < 0:
                at -= 1
            else:
                column[choice[at]] += 1
                at -= int(sizes[choice[at]])
        times, direction = inverse @ need, inverse @ column
        ratio = np.where(direction > 1e-9, times / np.where(direction > 1e-9, direction, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    times = np.linalg.inv(basis) @ need
    return [
        (float(x), {int(n): int(k) for n, k in zip(sizes, col, strict=True) if k})
        for x, col in zip(times, basis.T, strict=True)
        if x > 1e-9
    ]


class _Plan:
    """Runs so far, and classes of sequences with equal free space: a heap of (first sequence, how many) each."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left, self.taken, self.capacity = dict(counts), dict.fromkeys(counts, 0), capacity
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.free: dict[int, list[tuple[int, int]]] = {}
        self.spaces: list[int] = []
        self.sequences = 0

    def put(self, length: int, n: int, sequence: int, offset: int) -> None:
        first = self.taken[length]
        self.runs.append((length, first, first + n, sequence, offset))
        self.taken[length] += n
        self.left[length] -= n

    def open(self, sequence: int, n: int, space: int) -> None:
        if space and space not in self.free:
            insort(self.spaces, space)
        if space:
            heapq.heappush(self.free.setdefault(space, []), (sequence, n))

    def best_fit(self, length: int) -> None:
        """Pack what is left of a length: each into the fullest sequence that has room, or into new ones."""
        while (n := self.left[length]) > 0:
            k = bisect_left(self.spaces, length)
            if k == len(self.spaces):
                each = self.capacity // length
                fresh = -(-n // each)
                self.open(self.sequences, fresh, self.capacity)
                self.sequences += fresh
                continue
            space = self.spaces[k]
            sequence, there = heapq.heappop(self.free[space])
            if not self.free[space]:
                del self.free[space], self.spaces[k]
            deep = min(space // length, -(-n // there))
            n = min(n, there)
            if deep > 1 and self.left[length] >= deep * there:
                for i in range(deep):
                    self.put(length, there, sequence, self.capacity - space + i * length)
                self.open(sequence, there, space - deep * length)
                continue
            self.put(length, n, sequence, self.capacity - space)
            self.open(sequence, n, space - length)
            if there > n:
                self.open(sequence + n, there - n, space)

    def fill(self, config: dict[int, int], times: int, members: dict[int, list[int]]) -> None:
        """``times`` sequences of one configuration, each slot taken by the longest pieces left of its group."""
        parts = [(self.sequences, times, 0)]
        self.sequences += times
        for size, slots in sorted(config.items(), reverse=True):
            for _ in range(slots):
                after = []
                for sequence, n, used in parts:
                    while n:
                        length = next((x for x in members[size] if self.left[x]), None)
                        if length is None:
                            after.append((sequence, n, used))
                            break
                        k = min(n, self.left[length])
                        self.put(length, k, sequence, used)
                        after.append((sequence, k, used + length))
                        sequence, n = sequence + k, n - k
                parts = after
        for sequence, n, used in parts:
            self.open(sequence, n, self.capacity - used)


#: What share of the capacity is still short, and into how many groups longer ones go. Which does best depends on the lengths.
SETTINGS = ((0.12, 48), (0.25, 48), (0.33, 48), (0.45, 96), (0.5, 48))


def plan(counts: dict[int, int], capacity: int, settings: tuple = SETTINGS) -> list[tuple[int, int, int, int, int]]:
    """The runs of the setting that needs the fewest sequences, the first of equals."""
    return min((grouping_plan(counts, capacity, *s) for s in settings), key=lambda p: p.sequences).runs


def grouping_plan(counts: dict[int, int], capacity: int, small: float, groups: int) -> _Plan:
    """Runs (length, first rank, end rank, first sequence, offset) that pack counts[length] pieces of every length."""
    p = _Plan({n: k for n, k in counts.items() if 0 < n <= capacity and k}, capacity)
    size_of = grouped(p.left, int(small * capacity), groups)
    members: dict[int, list[int]] = {}
    demand: dict[int, int] = {}
    for n, size in size_of.items():
        members.setdefault(size, []).append(n)
        demand[size] = demand.get(size, 0) + p.left[n]
    for times, config in sorted(configurations(demand, capacity), key=lambda x: (-max(x[1]), -x[0])):
        if int(times + 1e-9):
            p.fill(config, int(times + 1e-9), members)
    for n in sorted(p.left, reverse=True):
        p.best_fit(n)
    return p


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that no packing can do without: by total length, and by pieces over half the capacity."""
    return max(-(-sum(n * k for n, k in counts.items()) // capacity), sum(k for n, k in counts.items() if 2 * n > capacity))


@cache
def _tokens(path: str) -> SpaceMemo:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def whole(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    # In this vocabulary each character of a token stands for one byte.
    size = tokenizer.get_vocab_size()
    length = np.array([len(tokenizer.id_to_token(i) or "") for i in range(size)])

    def each(chunks: list[str]) -> list[bytes]:
        """All chunks in one call, as one text: its ids fall to the chunks by how many bytes they stand for."""
        ids = np.array(tokenizer.encode_batch_fast(["".join(chunks)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum([len(c.encode()) for c in chunks])
        cuts = ((np.searchsorted(np.cumsum(length[ids]), ends) + 1) * 4).tolist()
        data = ids.tobytes()
        return [data[a:z] for a, z in zip([0, *cuts], cuts, strict=False)]

    def told(chunks: list[str]) -> list[bytes]:
        plain = [c for c in chunks if c[0] == " " and len(c) > 1 and not c[-1].isspace() and not c[1].isspace()]
        done = dict(zip(plain, each(plain), strict=True)) if plain else {}
        return [done[c] if c in done else whole(c) for c in chunks]

    special = "".join("|" + re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values())
    return SpaceMemo(told, whole, special)


def pieces(documents: DataFrame, path: str, capacity: int, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and ``end``, cut where it is over the capacity.

    The remainder comes first, so that all later pieces fill a sequence each.
    """

    def run(batches):
        packed, stop = _tokens(path), np.array([end], "<u4").tobytes()
        for b in slices(batches):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = memoryview(packed(text) + stop)
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for i, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for column, value in zip(rows, (doc, i, a, z - a, zlib.crc32(ids[4 * a : 4 * z])), strict=True):
                        column.append(value)
            kinds = (b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", text_of(documents).alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def place(cut: DataFrame, capacity: int, settings: tuple = SETTINGS, shards: int = 1024) -> DataFrame:
    """Add sequence_id and offset to stored pieces with a ``length`` from 1 to ``capacity``.

    A piece's rank among those of its length is the count of such pieces in earlier shards plus its place in
    its own; shards come from a hash of the row, so a length that a third of all pieces share is many groups.
    """
    shard = F.pmod(F.xxhash64(*[c for c in cut.columns if c != "length"]), F.lit(shards)).cast("int")
    numbered = cut.withColumn("_shard", shard)
    each = numbered.groupBy("length", "_shard").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = each.select("length", "_shard", F.coalesce(before, F.lit(0)).alias("_before"))
    counts = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    runs = sorted(plan(counts, capacity, settings))
    table = np.array(runs, np.int64).reshape(-1, 5)
    shared = cut.sparkSession.sparkContext.broadcast(table)  # a few runs for each length up to the capacity

    own = F.row_number().over(Window.partitionBy("length", "_shard").orderBy(*[c for c in cut.columns if c != "length"]))
    ranked = numbered.withColumn("_own", own - 1).join(starts, ["length", "_shard"])
    ranked = ranked.select(*cut.columns, (F.col("_before") + F.col("_own")).alias("_rank"))
    columns = cut.columns
    at = columns.index("length")

    def run(batches):
        runs = shared.value
        key = runs[:, 0] << 40 | runs[:, 1]
        for b in batches:
            length = b.column(at).to_numpy().astype(np.int64)
            rank = b.column(b.num_columns - 1).to_numpy().astype(np.int64)
            k = np.searchsorted(key, length << 40 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(runs[k, 3] + rank - runs[k, 1]), pa.array(runs[k, 4])],
                [*columns, "sequence_id", "offset"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack(documents: DataFrame, path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """Pack every document's tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty: one piece that holds only ``end``. Rows that repeat are packed each; ids may be null; other
    columns are not looked at. An empty table gives an empty result. Sequences are gapless from offset 0.
    """
    return place(stored(pieces(documents, path, capacity, end), "pieces"), capacity)
