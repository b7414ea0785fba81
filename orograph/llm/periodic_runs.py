"""Stretches of text that repeat themselves with a period, found by bit-parallel comparison of a text with itself.

A text's words get ids, and each bit of the ids is a plane: a big integer with one bit a word. A plane XORed with itself shifted by q words has ones where words q
apart differ in that bit; the OR over planes has ones where they differ at all. A run of period q is a stretch of zeros there. Stretches of at least k
zeros are isolated by ANDing the complement with its own shifts by 1, 2, 4 and so on, about log2(k) steps.

Comparing all n / 3 lags of a whole text takes time of the square of its length, so lags from ``SMALL`` on are found first, Q lags at a time (Q, a power of two, to 2Q - 1). A run of such a
period has equal words over at least 2Q places, so it holds a place divisible by 2Q - 8 whose next eight words recur. For each such place eight ANDs over slices
of the planes tell for all Q lags at once whether they do. No run is lost, a text of n words takes some n log n bit operations, and lags so found are compared in full around the place
only.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: A run has so many words and so many periods at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Smaller lags are compared over the whole text.
SMALL = 32
#: Words that must recur at a place for a lag to be compared around it.
PROBE = 8

Run = tuple[int, int, int]


class Planes:
    """The ids of a text's words, a plane of bits for each bit of the ids."""

    def __init__(self, words: list[bytes]):
        seen: dict[bytes, int] = {}
        self.ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), "int64", len(words))
        self.n = len(words)
        self.bits = max(1, (len(seen) - 1).bit_length())
        self.bytes = [np.packbits((self.ids >> b & 1).astype(bool), bitorder="little").tobytes() for b in range(self.bits)]

    def slice(self, plane: int, start: int, stop: int) -> int:
        """Bits start to stop of a plane, read from its bytes: the cost is that of the slice."""
        whole = int.from_bytes(self.bytes[plane][start >> 3 : (stop + 7) >> 3], "little")
        return (whole >> (start & 7)) & ((1 << (stop - start)) - 1)

    def equal(self, lag: int, start: int, stop: int) -> int:
        """A bit for each place from start to stop: whether its word is that ``lag`` words on."""
        differ, ones = 0, (1 << (stop - start)) - 1
        for b in range(self.bits):
            differ |= self.slice(b, start, stop) ^ self.slice(b, start + lag, stop + lag)
            if differ == ones:
                break
        return differ ^ ones

    def recurring(self, place: int, low: int, count: int) -> int:
        """A bit for each lag from ``low``: whether the PROBE words at the place are those so many words on."""
        found = (1 << count) - 1
        for i in range(place, place + PROBE):
            word = int(self.ids[i])
            for b in range(self.bits):
                bits = self.slice(b, i + low, i + low + count)
                found &= bits if word >> b & 1 else ~bits
                if not found:
                    return 0
        return found


def stretches(ones: int, least: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of each stretch of at least ``least`` ones that zeros or the ends bound."""
    have, left = 1, ones
    while have < least and left:
        step = min(have, least - have)
        left &= left >> step
        have += step
    starts = left & ~(left << 1)
    stops = left & ~(left >> 1)
    while starts:
        a, z = starts & -starts, stops & -stops
        yield a.bit_length() - 1, z.bit_length() - 1 + least
        starts ^= a
        stops ^= z


def _around(planes: Planes, lag: int, place: int) -> tuple[int, int]:
    """The stretch of places around ``place`` whose words are those ``lag`` on, by slices that double until they find its ends."""
    size, low, high = 4 * lag, place, place + 1
    while low > 0:
        first = max(0, low - size)
        differ = planes.equal(lag, first, low) ^ ((1 << (low - first)) - 1)
        if differ:
            low = first + differ.bit_length()
            break
        low, size = first, 2 * size
    size, last = 4 * lag, planes.n - lag
    while high < last:
        stop = min(last, high + size)
        differ = planes.equal(lag, high, stop) ^ ((1 << (stop - high)) - 1)
        if differ:
            high += (differ & -differ).bit_length() - 1
            break
        high, size = stop, 2 * size
    return low, high


def runs(words: list[bytes]) -> list[Run]:
    """(start, length, period) of every run, by start, then period.

    A run is a stretch of words with smallest period q, at least max(24, 3 q) long, that no neighbouring word extends. A stretch of one lag that has a
    smaller period too is, as a whole, the run of that period, so lags go up and a stretch that is known stays out.
    """
    n = len(words)
    if n < LEAST_WORDS:
        return []
    planes = Planes(words)
    found: dict[tuple[int, int], int] = {}
    for lag in range(1, min(SMALL, n // LEAST_PERIODS + 1)):
        least = max(LEAST_WORDS, LEAST_PERIODS * lag) - lag
        for a, z in stretches(planes.equal(lag, 0, n - lag), least):
            found.setdefault((a, z + lag), lag)
    low = SMALL
    while LEAST_PERIODS * low <= n:
        top = min(2 * low, n // LEAST_PERIODS + 1)
        # Runs known so far, by start: those of one period don't overlap in as many words as a lag of this class.
        known = sorted((a, z, q) for (a, z), q in found.items() if z - a >= 2 * low)
        begins = [a for a, _, _ in known]
        reach = np.maximum.accumulate([z for _, z, _ in known]).tolist() if known else []
        here: dict[tuple[int, int], int] = {}
        until: dict[int, int] = {}  # end of the last stretch of a lag: places within it tell nothing new
        for place in range(0, n - low - PROBE + 1, 2 * low - PROBE):
            lags = planes.recurring(place, low, min(top, n - place - PROBE + 1) - low)
            i = bisect_right(begins, place) - 1
            while lags and i >= 0 and reach[i] > place:
                a, z, q = known[i]
                if z >= place + PROBE + low:
                    # Multiples of the period whose words recur within the run are lags of the same stretch.
                    for m in range(-(-low // q) * q, min(top, z - place - PROBE + 1), q):
                        lags &= ~(1 << (m - low))
                i -= 1
            while lags:
                bit = lags & -lags
                lags ^= bit
                lag = low + bit.bit_length() - 1
                if place < until.get(lag, 0):
                    continue
                a, z = _around(planes, lag, place)
                until[lag] = z
                if z - a >= (LEAST_PERIODS - 1) * lag:
                    span = (a, z + lag)
                    if span not in found:
                        here[span] = min(lag, here.get(span, lag))
        found |= here
        low *= 2
    return sorted((a, z - a, q) for (a, z), q in found.items())


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words without those that any run contains after its first period."""
    drop = np.zeros(len(words) + 1, "int64")
    for start, length, period in found:
        drop[start + period] += 1
        drop[start + length] -= 1
    inside = np.cumsum(drop)[:-1]
    return [w for w, d in zip(words, inside.tolist(), strict=True) if not d]


def strongest(found: list[Run]) -> Run | None:
    """The run of most periods, exactly; of equals the first, then that of the smaller period."""
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the period that the contract of op12 gives to a tenth of the documents, by the checksum of their id; none without an id."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
    ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string()),
])
_DDL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_FULL = _DDL + ", runs array<struct<start: long, length: long, period: long>>, collapsed string"


def detect(docs: DataFrame, text: str = "text", plant: bool = False, full: bool = True) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text): its runs, the strongest of them, and the text without repetitions.

    ``full`` adds ``runs`` and ``collapsed`` to the digests. ``plant`` first puts the periods of ``planted`` into the words. Words are what ASCII white space separates. Each row is judged
    alone, in one pass without a shuffle, so repeated rows and ids are no matter; a null or empty text has no run and an empty collapsed text; ties
    among strongest runs go to the smaller start, then period. Very long texts are taken whole, in some n log n steps. Of the columns only these two are read.
    An empty table gives no row.
    """
    fields = [f.name for f in _OUT][: None if full else 8]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (body or b"").split()  # bytes.split() takes just the six ASCII white spaces
                if plant:
                    words = planted(doc, words)
                found = runs(words)
                best, kept = strongest(found), b" ".join(collapsed(words, found))
                listed = "".join(f"{a},{n},{q}\n" for a, n, q in found)
                row = [doc, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None]
                row += [hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()]
                rows.append(row + [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found], kept.decode("utf-8", "replace")] if full else row)
            yield pa.RecordBatch.from_pydict({f: [r[i] for r in rows] for i, f in enumerate(fields)}, schema=pa.schema([_OUT.field(f) for f in fields]))

    return docs.select(F.col("doc_id").cast("long"), docs[text].cast("string").cast("binary")).mapInArrow(run, _FULL if full else _DDL)
