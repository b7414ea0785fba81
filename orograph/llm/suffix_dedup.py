"""Repeated passages through sparse suffix arrays over words.

Of each document's suffixes only those at minimisers are retained: among the grams of ``gram`` words inside any window of
``window`` words, the one with the least hash (the leftmost of equals). Which one that is depends on the window's words alone,
so two copies of a passage of ``window`` words retain a common suffix wherever they stand. A suffix's block is all windows whose minimiser it is.

Suffixes whose gram two documents have are hits. Blocks are known by 128 bits of XXH3 of their bytes; copies of one block count as one, and
where a gram has a single block that block repeats as a whole. The other blocks' suffixes are sorted twice by their words: to the right
from the minimiser, and to the left from it. In each order every suffix is compared, word by word, with its neighbour before it, which gives the length of
their match; suffixes within a run of neighbours whose matches have n words or more share n words. A window of ``window`` words with o of them left of its
minimiser is the same text in two blocks exactly if they are in one run for o words in the left order and in one run for the other words
in the right order. Extending over runs, not only to the next suffix, loses no passage that shares less to the right with its neighbour
than with a third suffix.

Orders are range-partitioned by gram and words, so that a gram with very many surroundings is many tasks; a run over a task's border
goes on by the border's two suffixes, of which there are two a task.

A passage is a run of words, in exact spelling, of at least ``window`` words that stands in two documents or more; white space between the
words doesn't matter. Its first document (least doc_id) keeps it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, keyed, release, slices, stored, text_of

_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
#: An odd multiplier for hashes of word sequences, and its inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A place in a text: the first word of a block, the words from there to its minimiser, and how many windows follow the first one.
_LOW, _OFF = 1 << 12, 1 << 6
#: Rows of one record batch.
SLICE = 4096
#: A key is hot that has more than one row in so many; at most so many are.
HOT = 1000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of the multiplier and of its inverse, as many as any text so far has needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            steps = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)])
            self.up, self.down = steps(_BASE), steps(_INVERSE)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_SPACES).split()


def gram_hashes(words: list[bytes], gram: int) -> np.ndarray:
    """A hash of each run of ``gram`` words; equal runs have equal hashes."""
    n = len(words)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    up, down = _powers(n)
    sums = np.r_[np.uint64(0), np.cumsum(hashes * up)]
    start = np.arange(n - gram + 1)
    return _mixed((sums[start + gram] - sums[start]) * down[start])


def anchors(text: str, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The retained suffixes: gram hash, 128 bits of the block in two columns, and place (see _LOW), in the order of the text."""
    words = words_of(text)
    if len(words) < window:
        return np.empty(0, np.uint64), np.empty((0, 2), np.int64), np.empty(0, np.int64)
    grams = gram_hashes(words, gram)
    each = window - gram + 1
    least = np.lib.stride_tricks.sliding_window_view(grams, each).argmin(axis=1) + np.arange(len(words) - window + 1)
    low = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    more = np.diff(np.r_[low, len(least)]) - 1
    at = least[low]
    place = low * _LOW + (at - low) * _OFF + more
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends[low] - 1 - np.fromiter(map(len, (words[i] for i in low.tolist())), np.int64, len(low))).tolist()
    # Where the minimiser stands in its block tells blocks apart that have the same words.
    shapes = (place % _LOW).tolist()
    digest = xxhash.xxh3_128_digest
    blocks = b"".join([digest(joined[a:z], s) for a, z, s in zip(starts, (ends[low + more + window - 1] - 1).tolist(), shapes, strict=True)])
    return grams[at], np.frombuffer(blocks, ">i8").reshape(-1, 2).astype(np.int64), place


_BLOCK = ["gram", "b0", "b1"]


def suffixes(documents: DataFrame, row: list[str], window: int, gram: int) -> DataFrame:
    """(doc, _file, _place, gram, b0, b1, at): every retained suffix, ``at`` as in ``anchors``."""
    names = ["doc", "_file", "_place", *_BLOCK, "at"]

    def run(batches):
        for b in slices(batches):
            docs, cols = [], []
            for i, text in enumerate(b.column(3).to_pylist()):
                found = anchors(text, window, gram)
                if len(found[0]):
                    docs.append(np.full(len(found[0]), i))
                    cols.append(found)
            if not docs:
                continue
            g, k, at = map(np.concatenate, zip(*cols, strict=True))
            own = [c.take(pa.array(np.concatenate(docs))) for c in b.columns[:3]]
            parts = [g.view(np.int64), np.ascontiguousarray(k[:, 0]), np.ascontiguousarray(k[:, 1]), at]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, parts)], names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    given = documents.where("doc_id is not null").select("doc_id", *row, text_of(documents).alias("_text"))
    return given.mapInArrow(run, f"doc {kind}, _file long, _place long, gram long, b0 long, b1 long, at long")


def _matched(rows: DataFrame, table: DataFrame, on: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``. The keys in ``hot``, at most HOT, are joined by broadcast, so that no task has to take all rows of one."""
    hot = F.broadcast(hot)
    often = rows.join(F.broadcast(table.join(hot, on, "left_semi")), on, how)
    return often.unionByName(rows.join(hot, on, "left_anti").join(table.join(hot, on, "left_anti"), on, how))


def _contexts(documents: DataFrame, row: list[str], reps: DataFrame, window: int) -> DataFrame:
    """(gram, b0, b1, at, first, last, to_right, to_left): of each representative block the words from its minimiser on and those before it, nearest first.

    Each word is followed by a space, so the order of the strings is one of the words.
    """
    asked = reps.groupBy("_file", "_place").agg(F.collect_list(F.struct(*_BLOCK, "at", "first", "last")).alias("asked"))
    texts = documents.where("doc_id is not null").select(F.col(row[0]).alias("_file"), F.col(row[1]).alias("_place"), text_of(documents).alias("_text"))
    joined = texts.join(asked, ["_file", "_place"]).select("_text", "asked")
    names = [*_BLOCK, "at", "first", "last"]

    def run(batches):
        for b in slices(batches):
            flat = b.column(1).flatten()
            places, ends = flat.field(3).to_pylist(), np.cumsum(b.column(1).value_lengths().to_numpy()).tolist()
            right, left = [], []
            for text, start, end in zip(b.column(0).to_pylist(), [0, *ends], ends, strict=False):
                words = words_of(text)
                for place in places[start:end]:
                    low, off, more = place // _LOW, place % _LOW // _OFF, place % _OFF
                    right.append(b" ".join([*words[low + off : low + more + window], b""]).decode("utf-8", "surrogatepass"))
                    left.append(b" ".join([*reversed(words[low : low + off]), b""]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([*(flat.field(k) for k in range(6)), pa.array(right, pa.string()), pa.array(left, pa.string())], [*names, "to_right", "to_left"])

    kind = reps.schema["first"].dataType.simpleString()
    return joined.mapInArrow(run, f"gram long, b0 long, b1 long, at long, first {kind}, last {kind}, to_right string, to_left string")


def match(a: list[str], b: list[str]) -> int:
    """How many words two suffixes share from their start."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _runs(contexts: DataFrame, side: str, least: int, most: int) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """(gram, b0, b1, runs) in the order of ``side``: for each length from least to most the number of the run that the suffix is in; and for runs that
    began in an earlier task: (number, length) -> the number that it has there.

    A run is numbered by its first suffix. Every task hands on its first and its last suffix, so what comes to the driver is bounded by tasks.
    """
    ordered = contexts.select(*_BLOCK, F.col(side).alias("words"))
    ordered = ordered.repartitionByRange("gram", "words", "b0", "b1").sortWithinPartitions("gram", "words", "b0", "b1")
    sizes = most - least + 1

    def run(batches):
        base, n = TaskContext.get().partitionId() << 40, 0
        gram, words, held, runs = None, [], None, []

        def batch(rows):
            g, x, y, at, run_of, edge = zip(*rows, strict=True)
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((g, x, y, at, run_of, edge), kinds, strict=True)], [*_BLOCK, "place", "runs", "edge"])

        for b in batches:
            out = []
            for g, x, y, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                now = text.split(" ")[:-1]
                same = match(words, now) if g == gram else 0
                keep = min(max(same - least + 1, 0), sizes) if g == gram else 0
                runs = runs[:keep] + [base + n] * (sizes - keep)
                if held:
                    out.append(held)
                held = (g, x, y, base + n, runs, None if n else text)
                gram, words, n = g, now, n + 1
            for i in range(0, len(out), SLICE):
                yield batch(out[i : i + SLICE])
        if held:
            yield batch([(*held[:5], " ".join([*words, ""]))])

    found = stored(ordered.mapInArrow(run, "gram long, b0 long, b1 long, place long, runs array<long>, edge string"), f"suffix-{side}")
    edges = sorted((r["place"], r["gram"], r["edge"].split(" ")[:-1], r["runs"]) for r in found.where("edge is not null").select("place", "gram", "edge", "runs").collect())
    begun: dict[tuple[int, int], int] = {}
    for (place, gram, words, runs), (after, gram_after, words_after, _) in zip(edges, edges[1:], strict=False):
        if place >> 40 != after >> 40 and gram == gram_after:
            for length in range(least, min(match(words, words_after), most) + 1):
                own = runs[length - least]
                begun[after, length] = begun.get((own, length), own)
    return found.select(*_BLOCK, "runs"), begun


def _renamed(flat: DataFrame, run: str, length, begun: dict[tuple[int, int], int]) -> DataFrame:
    """``flat`` with runs that began in an earlier task under the number that they have there. The table is broadcast: one row a task and length at most."""
    if not begun:
        return flat
    table = flat.sparkSession.createDataFrame([(a, n, z) for (a, n), z in begun.items()], "_own long, _length int, _begun long")
    joined = flat.join(F.broadcast(table), (F.col(run) == F.col("_own")) & (length == F.col("_length")), "left")
    return joined.withColumn(run, F.coalesce("_begun", run)).drop("_own", "_length", "_begun")


def repeated_windows(documents: DataFrame, row: list[str], window: int = 50) -> DataFrame:
    """(doc, _file, _place, low, mask, keeper): windows low + i for each bit i of mask also stand in the document ``keeper``, the first that has them."""
    gram = window // 2
    if not 2 <= gram <= 31:
        raise ValueError("window must be from 4 to 63 words")
    found = stored(suffixes(documents, row, window, gram), "suffixes")
    shared = found.groupBy("gram").agg(F.min("doc").alias("a"), F.max("doc").alias("z"), F.count(F.lit(1)).alias("n")).where("a <> z")
    shared = stored(shared.select("gram", "n"), "suffix-grams")
    hot = shared.where(F.col("n") * HOT > found.count()).select("gram")
    hits = stored(_matched(found, shared.select("gram"), ["gram"], hot, "left_semi"), "suffix-hits")
    release(found, shared)

    of = [F.min("doc").alias("first"), F.max("doc").alias("last"), F.max(F.expr(f"at % {_OFF}")).alias("more"), F.count(F.lit(1)).alias("n")]
    blocks = stored(hits.groupBy(*_BLOCK).agg(*of), "suffix-blocks")
    several = blocks.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    whole = blocks.join(several, "gram", "left_anti").select(*_BLOCK, F.col("first").alias("keeper"), F.expr("shiftleft(2L, cast(more as int)) - 1").alias("mask"))
    unlike = blocks.join(several, "gram", "left_semi").select(*_BLOCK, "first", "last")
    rep = F.min(F.struct("_file", "_place", "at")).alias("rep")
    reps = hits.join(unlike, _BLOCK).where("doc = first").groupBy(*_BLOCK, "first", "last").agg(rep).select(*_BLOCK, "first", "last", "rep.*")
    contexts = stored(_contexts(documents, row, reps, window), "suffix-contexts")
    right, right_begun = _runs(contexts, "to_right", gram, window)
    left, left_begun = _runs(contexts, "to_left", 0, window - gram)

    joined = contexts.drop("to_right", "to_left").join(right.withColumnRenamed("runs", "rights"), _BLOCK).join(left.withColumnRenamed("runs", "lefts"), _BLOCK)
    # Window low + i has o = off - i words left of its minimiser.
    flat = joined.withColumn("i", F.explode(F.expr(f"sequence(0, cast(at % {_OFF} as int))"))).withColumn("o", F.expr(f"cast(at % {_LOW} div {_OFF} as int) - i"))
    flat = flat.select(*_BLOCK, "first", "last", "i", "o", F.expr(f"rights[{window - gram} - o]").alias("r"), F.expr("lefts[o]").alias("l"))
    flat = _renamed(_renamed(flat, "r", window - F.col("o"), right_begun), "l", F.col("o"), left_begun)
    flat = stored(flat, "suffix-windows")
    repeats = flat.groupBy("o", "r", "l").agg(F.min("first").alias("keeper"), F.max("last").alias("z")).where("keeper <> z")
    bits = flat.select(*_BLOCK, "i", "o", "r", "l").join(repeats.drop("z"), ["o", "r", "l"])
    partial = bits.groupBy(*_BLOCK, "keeper").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))
    masks = whole.select(*_BLOCK, "keeper", "mask").unionByName(partial.select(*_BLOCK, "keeper", "mask"))
    hot = blocks.where(F.col("n") * HOT > hits.count()).select(*_BLOCK)
    masks = stored(masks, "suffix-masks")
    release(flat, contexts, right, left)
    told = _matched(hits, masks, _BLOCK, hot).where("keeper <> doc")
    return told.select("doc", "_file", "_place", F.expr(f"cast(at div {_LOW} as int)").alias("low"), "mask", "keeper")


def _numbered(documents: DataFrame) -> tuple[DataFrame, list[str]]:
    row = [fresh(documents, "_file"), fresh(documents, "_place")]
    return keyed(documents, *row), row


def repeats(documents: DataFrame, window: int = 50) -> DataFrame:
    """Per repeated passage, where it is not the one that stays: doc_id, start_word, end_word, n_words, first_doc_id.

    Words are numbered from 0; end_word is after the last. Passages that touch or overlap are one row, with the least
    of their first documents. Repetition inside one document, or between rows with
    one id, doesn't count, though each of such rows has its own passages; rows without an id take no part. Null and empty texts have no words. Other columns are
    not looked at. Without repeats, as for an empty table, the result is empty.
    """
    return _passages(*_numbered(documents), window).drop("_file", "_place")


def _passages(documents: DataFrame, row: list[str], window: int) -> DataFrame:
    per = repeated_windows(documents, row, window).groupBy("doc", "_file", "_place").agg(F.collect_list(F.struct("low", "mask", "keeper")).alias("hits"))

    def run(batches):
        for b in batches:
            docs, start, end, first = [], [], [], []
            for i, hits in enumerate(b.column(3).to_pylist()):
                for at, keeper in sorted((h["low"] + k, h["keeper"]) for h in hits for k in range(window) if h["mask"] >> k & 1):
                    if docs and docs[-1] == i and at <= end[-1]:
                        end[-1] = at + window
                        first[-1] = min(first[-1], keeper)
                    else:
                        docs.append(i)
                        start.append(at)
                        end.append(at + window)
                        first.append(keeper)
            spans = [pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array([z - a for a, z in zip(start, end, strict=True)], pa.int32())]
            own = [c.take(pa.array(docs, pa.int64())) for c in b.columns[:3]]
            yield pa.RecordBatch.from_arrays([own[0], *spans, pa.array(first, b.schema.field(0).type), *own[1:]], ["doc_id", "start_word", "end_word", "n_words", "first_doc_id", "_file", "_place"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return per.mapInArrow(run, f"doc_id {kind}, start_word int, end_word int, n_words int, first_doc_id {kind}, _file long, _place long")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space after each of them."""
    starts = [m.start() for m in re.finditer(WORD, text)] + [len(text)]
    out, at = [], 0
    for a, z in sorted(spans):
        a, z = min(a, len(starts) - 1), min(z, len(starts) - 1)
        out.append(text[at : starts[a]])
        at = max(at, starts[z])
    return "".join([*out, text[at:]])


def cut_repeats(documents: DataFrame, window: int = 50) -> DataFrame:
    """The documents, all columns, without their repeated passages; n_chars (where there is one) follows the text.

    Each row loses the passages that ``repeats`` finds in that row, whatever other rows share its doc_id. Documents of which every word stands in an earlier
    one go; those that had no word stay, as do rows without an id, null and empty texts. An empty table stays empty.
    """
    numbered, row = _numbered(documents)
    cut = fresh(numbered, "_spans")
    found = _passages(numbered, row, window).groupBy("_file", "_place").agg(F.collect_list(F.struct("start_word", "end_word")).alias(cut))
    found = found.withColumnsRenamed({"_file": row[0], "_place": row[1]})
    joined = numbered.join(found, row, "left").select(*documents.columns, cut)
    names, at = documents.columns, documents.columns.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)

    def run(batches):
        for b in slices(batches):
            texts = b.column(at).to_pylist()
            spans = b.column(b.num_columns - 1).to_pylist()
            keep = []
            for i, s in enumerate(spans):
                if s:
                    texts[i] = without(texts[i] or "", [(x["start_word"], x["end_word"]) for x in s])
                keep.append(not s or bool(texts[i].strip(" \t\n\v\f\r")))
            columns = list(b.columns[:-1])
            columns[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    out = joined.mapInArrow(run, fields)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out
