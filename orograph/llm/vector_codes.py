"""Vectors as codes of eight bytes: each of eight parts is named by its nearest entry of a small codebook, which is learned from all vectors in whole numbers.

Each round is one pass over the table: a task finds the nearest entry of each part and adds up parts by entry, so the shuffle and the driver see as many rows as
there are entries, whatever the table's size. Sums are of integers, so they are the same in any order.

Nearest entries are found in a vantage-point tree over the entries of a part position. A node holds an entry, and the rest in a near and a far half, each with the
least and the greatest distance of its entries from the node's. A half is visited unless the triangle inequality rules it out: distances of parts from
the node's entry and bounds are floating-point numbers, rounded outwards, and a half that might hold an equal distance is visited. Whether an entry is nearer is
decided by integer squared distances alone, of equals for the lower index. A batch of parts goes down the tree together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, stored

PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: A component x is floor(SCALE * x).
SCALE = 4096
#: Scaled components are less than this from zero: squared distances of parts of up to 2 ** 18 components stay within a long.
LIMIT = 1 << 21
#: Entries that a leaf of the tree holds.
LEAF = 3
#: Vectors that a worker codes at once.
SLICE = 8192
_WIDER = 1e-9


@dataclass
class Node:
    """An entry (or a leaf's entries), the halves of the others, and the bounds of their distances from it."""

    entries: list[int]
    halves: list[Node]
    bounds: list[tuple[float, float]]


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def tree(entries: np.ndarray, among: list[int] | None = None) -> Node:
    """A vantage-point tree over rows of ``entries``; its halves part at the median distance, equal distances in either."""
    among = list(range(len(entries))) if among is None else among
    if len(among) <= LEAF:
        return Node(among, [], [])
    # The entry farthest from the first one spreads the others best.
    first = _square(entries[among], entries[among[0]])
    own = among[int(np.argmax(first))]
    rest = [i for i in among if i != own]
    away = _square(entries[rest], entries[own])
    order = np.argsort(away, kind="stable")
    half = len(rest) // 2
    halves, bounds = [], []
    for part in (order[:half], order[half:]):
        d = np.sqrt(away[part].astype(float))
        halves.append(tree(entries, [rest[i] for i in part]))
        bounds.append((float(d.min()) * (1 - _WIDER), float(d.max()) * (1 + _WIDER)))
    return Node([own], halves, bounds)


def nearest(node: Node, entries: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry nearest to each of ``parts``, the lower index of equals."""
    at = np.full(len(parts), len(entries), "int64")
    best = np.full(len(parts), np.iinfo("int64").max, "int64")

    def visit(node: Node, rows: np.ndarray) -> None:
        for e in node.entries:
            d = _square(parts[rows], entries[e])
            better = (d < best[rows]) | ((d == best[rows]) & (e < at[rows]))
            best[rows[better]], at[rows[better]] = d[better], e
        if not node.halves:
            return
        away = np.sqrt(d.astype(float))
        near = away <= node.bounds[0][1]
        # Where a part lies among the near half that one comes first, so that the best distance is small when the other is judged.
        for order in (0, 1):
            for side in (near, ~near):
                which = order if side is near else 1 - order
                low, high = node.bounds[which]
                reach = np.sqrt(best[rows].astype(float)) * (1 + _WIDER)
                may = side & (away * (1 - _WIDER) - reach <= high) & (away * (1 + _WIDER) + reach >= low)
                if may.any():
                    visit(node.halves[which], rows[may])

    if len(parts):
        visit(node, np.arange(len(parts)))
    return at, best


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("int64").reshape(-1, width)


def whole(vectors: DataFrame, vector: str = "embedding", limit: int = LIMIT) -> DataFrame:
    """(vec_id, label, v): scaled components of the rows whose vector is there and holds numbers only."""
    x = vectors[vector].cast("array<double>")
    kept = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    label = vectors["label"] if "label" in vectors.columns else F.lit(None).cast("string").alias("label")
    scaled = F.transform(x, lambda c: F.when(F.abs(c) * SCALE < limit, F.floor(c * SCALE)).otherwise(F.raise_error(F.lit(f"a component is {limit // SCALE} or more"))).cast("int"))
    return vectors.select("vec_id", label, F.when(kept, scaled).alias("v")).where("v is not null")


def _sums(books: list[np.ndarray], width: int) -> object:
    """Rows (part, entry, n, sums) of a task: how many parts are nearest to an entry, and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [tree(b) for b in books]
        k, w = len(books[0]), width // len(books)
        n, total = np.zeros((len(books), k), "int64"), np.zeros((len(books), k, w), "int64")
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                m = _matrix(batch.column(0).slice(i, SLICE), width)
                for p, (t, b) in enumerate(zip(trees, books, strict=True)):
                    own = m[:, p * w : (p + 1) * w]
                    at, _ = nearest(t, b, own)
                    n[p] += np.bincount(at, minlength=k)
                    np.add.at(total[p], at, own)
        used = [(p, e) for p in range(len(books)) for e in range(k) if n[p, e]]
        if used:
            yield pa.RecordBatch.from_arrays([
                pa.array([p for p, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()), pa.array([int(n[u]) for u in used], pa.int64()),
                pa.array([total[u].tolist() for u in used], pa.list_(pa.int64())),
            ], ["part", "entry", "n", "sums"])

    return run


def learn(v: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """Codebooks, and the vectors' length. ``v`` (vec_id, v) is read once a round.

    A position's first entries are that part of the rows of the smallest ids (null last), of equal ids the smaller vectors; of fewer rows, as many. Each round replaces an
    entry by the mean of its parts, rounded down, and leaves one without parts as it is.
    """
    seeds = [r["v"] for r in v.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    if not seeds:
        return [], 0
    lengths = v.agg(F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("z")).first()
    width = len(seeds[0])
    if lengths["a"] != lengths["z"] or width % parts:
        raise ValueError(f"vectors have {lengths['a']} to {lengths['z']} components; they need one length that is a multiple of {parts}")
    w = width // parts
    books = [np.array(seeds, "int64")[:, p * w : (p + 1) * w] for p in range(parts)]
    for _ in range(rounds):
        met = v.select("v").mapInArrow(_sums(books, width), "part int, entry int, n long, sums array<long>")
        flat = met.select("part", "entry", "n", F.posexplode("sums").alias("c", "s"))
        # As many rows as the codebooks have components.
        for r in flat.groupBy("part", "entry", "c").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
            books[r["part"]][r["entry"], r["c"]] = r["s"] // r["n"]
    return books, width


def _codes(books: list[np.ndarray], width: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [tree(b) for b in books]
        w = width // len(books)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                some = batch.slice(i, SLICE)
                m = _matrix(some.column(2), width)
                found = [nearest(t, b, m[:, p * w : (p + 1) * w]) for p, (t, b) in enumerate(zip(trees, books, strict=True))]
                code = np.stack([at for at, _ in found], 1).astype("uint8")
                error = np.sum([d for _, d in found], 0)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) for each row with a vector of numbers.

    ``code`` names the nearest entries, two hexadecimal digits a part; ``error`` is the sum of their squared distances, ``label_error`` that of all rows of the label. Rows whose vector is
    null or holds a null, a NaN or an infinity go; so does nothing else. A null label is a label, a null id is an id. Repeated rows and ids count each. With ``entries`` rows or fewer all vectors are entries; an empty
    table gives no row. Vectors of different lengths, of a length that ``parts`` doesn't divide, and components of 512 or more are errors. Other columns play no part. At most 256 entries.
    """
    v = stored(whole(vectors, vector), "vectors")
    books, width = learn(v, parts, entries, rounds)
    kinds = {f.name: f.dataType.simpleString() for f in v.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    if not books:
        return v.sparkSession.createDataFrame([], f"{schema}, label_error long, codebooks_sha256 string")
    coded = stored(v.select("vec_id", "label", "v").mapInArrow(_codes(books, width), schema), "codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return looked_up(coded, by_label, "label").withColumn("codebooks_sha256", F.lit(digest(books)))


def _oracle() -> str:
    """The same in SQL: a table of assignments and one of entries for each round, with every part compared to every entry."""
    parts = ", ".join(f"({p})" for p in range(PARTS))
    sql = f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id) AS place FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
split AS MATERIALIZED (
  SELECT vec_id, label, place, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS w FROM kept CROSS JOIN (VALUES {parts}) q(p)),
book0 AS MATERIALIZED (SELECT p, place - 1 AS e, w AS entry FROM split WHERE place <= {ENTRIES})"""
    for r in range(ROUNDS + 1):
        sql += f""",
near{r} AS MATERIALIZED (
  SELECT place, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT s.place, s.p, b.e, list_sum(list_transform(generate_series(1, len(s.w)), lambda i: (s.w[i] - b.entry[i]) * (s.w[i] - b.entry[i]))) AS d
    FROM split s JOIN book{r} b ON b.p = s.p) x GROUP BY place, p)"""
        if r < ROUNDS:
            sql += f""",
mean{r} AS MATERIALIZED (
  SELECT p, e, list(m ORDER BY i) AS entry FROM (
    SELECT s.p, n.e, i, CAST(floor(sum(s.w[i]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS m
    FROM split s JOIN near{r} n ON n.place = s.place AND n.p = s.p CROSS JOIN LATERAL (SELECT unnest(generate_series(1, len(s.w))) AS i) c GROUP BY s.p, n.e, i) x GROUP BY p, e),
book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.entry, b.entry) AS entry FROM book{r} b LEFT JOIN mean{r} m ON m.p = b.p AND m.e = b.e)"""
    return (
        sql
        + f""",
coded AS MATERIALIZED (
  SELECT k.vec_id, k.label, string_agg(lpad(lower(hex(CAST(n.e AS BIGINT))), 2, '0'), '' ORDER BY n.p) AS code, CAST(sum(n.d) AS BIGINT) AS error
  FROM kept k JOIN near{ROUNDS} n ON n.place = k.place GROUP BY k.place, k.vec_id, k.label),
told AS (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) AS h FROM book{ROUNDS})
SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded CROSS JOIN told"""
    )


ORACLE = _oracle()
