"""SimHash near-duplicates through an inverted index of fingerprint bytes at positions, with count filtering.

Documents with one fingerprint are one class, so copies never meet each other. Two fingerprints that differ in at most two bits share
at least six of their eight bytes at equal positions. A posting list for a single byte would hold 1/256 of the corpus, so a list is for four
bytes at four positions: the 14 sets of positions (the blocks of the Steiner system S(3,4,8), whose positions' exclusive or is 0). Each three positions are
in just one set, from which follows in how many lists two fingerprints meet: 14 if no byte differs, 7 if one does, 3 if two do, and at most 1
beyond. So the tally of shared postings of a pair tells the number of shared positional bytes; pairs that reach the guaranteed minimum are
retained and verified on all bits.

A list over ``long_list`` fingerprints would make too many pairs. It is linked exactly another way: within it only the
other four bytes differ, so each fingerprint is joined to itself with each one of their bits turned; fingerprints
at distance one or two meet at such a neighbour. That is linear in the list's length. A pair in no long list is tallied in full.

Few bits miss most pairs whose shingle sets are merely alike, as a Jaccard similarity of 0.8 is some ten bits of 64, and bytes guarantee
nothing there. Those pairs are found without fingerprints and without loss (``alike``): sets that are alike share one of their first hashes in
any order that is the same for all. The order puts hashes of frequent shingles last, so few lists are long. Each list of a hash is linked to the member
with the fewest rare shingles first, and only what that leaves apart is compared in pairs, if sizes and places in the order allow it.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, fresh, keyed, release, slices, stored, text_of

#: The sets of four byte positions that a posting list is for; each three of the eight positions are in one of them.
PLACES = [p for p in combinations(range(8), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0]
#: In how many lists fingerprints meet at least that differ in so many bits.
GUARANTEED = {1: 7, 2: 3}
#: Shingles that at least so many texts have count as frequent, but no more of them than MOST_FREQUENT; on which do, only the order of hashes depends.
FREQUENT = 8
MOST_FREQUENT = 1 << 18
#: Hashes that a task counts at once, and the ratio of the sizes of a band.
CHUNK = 1 << 22
BAND = 1.03

#: ASCII letters only, as A-Z alone are lower-cased.
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def shingle_hashes(text: str, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of words in turn; a text of fewer words is one shingle, one without a word has none."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).translate(_SPACES).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    hashes = xxhash.xxh64_intdigest
    return np.array([hashes(joined[a:z], seed) for a, z in zip(starts, ends[len(words) - n :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The signed 64-bit SimHash of a text: a bit is set if it is in over half of its shingles' XXH64; 0 without a word."""
    h = shingle_hashes(text, shingle, seed)
    n = len(h)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view('>i8')[0])


def fingerprints(documents: DataFrame, carried: list[str], shingle: int = 3, seed: int = 42) -> DataFrame:
    """The ``carried`` columns and _fp: null text counts as empty, fingerprint 0."""
    given = documents.select(*carried, text_of(documents).alias("_text"))

    def run(batches):
        for b in slices(batches):
            found = [fingerprint(t, shingle, seed) for t in b.column(len(carried)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.int64())], [*carried, "_fp"])

    return given.mapInArrow(run, f"{_fields(given, carried)}, _fp long")


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 56 - 8 * i).bitwiseAND(0xFF)


def links(classes: DataFrame, bits: int = 2, long_list: int = 24) -> DataFrame:
    """Edges (a, b) between different fingerprints ``_fp``; two are connected if a chain of links of at most ``bits`` bits joins them.

    Through long lists an edge may lead by a neighbour that no document has; such nodes connect only what is linked.
    """
    if bits not in GUARANTEED:
        raise ValueError("bits must be 1 or 2: the lists guarantee no shared posting beyond that")
    fp = F.col("_fp")
    key = lambda p: sum((F.shiftleft(_byte(fp, i), 8 * (3 - k)) for k, i in enumerate(p)), F.lit(0).cast("long"))
    lists = F.array(*[F.struct(F.lit(k).alias("list"), key(p).alias("key")) for k, p in enumerate(PLACES)])
    posts = classes.select("_fp", F.explode(lists).alias("p")).select("_fp", "p.list", "p.key")
    sizes = posts.groupBy("list", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    posts = stored(posts.join(sizes, ["list", "key"]), "postings")
    short = posts.where(F.col("n") <= long_list)
    met = short.alias("x").join(short.alias("y"), ["list", "key"]).where("x._fp < y._fp")
    tally = met.groupBy(F.col("x._fp").alias("a"), F.col("y._fp").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    near = tally.where(F.col("shared") >= GUARANTEED[bits]).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    near = near.select("a", "b")

    masks = F.lit([[_signed(1 << (63 - 8 * i - t)) for i in range(8) if i not in p for t in range(8)] for p in PLACES])
    turned = F.explode(F.element_at(masks, F.col("list") + 1))
    star = posts.where(F.col("n") > long_list).select(F.col("_fp").alias("a"), turned.alias("m"))
    # A turned fingerprint joins those at distance two through it; for one bit only real ones count.
    star = star.select("a", F.col("a").bitwiseXOR(F.col("m")).alias("b")).distinct()
    if bits == 1:
        star = star.join(classes.select(F.col("_fp").alias("b")), "b", "left_semi").select("a", "b")
    else:
        met = star.groupBy("b").agg(F.min("a").alias("least"), F.max("a").alias("most"))
        real = classes.select(F.col("_fp").alias("b"), F.lit(True).alias("real"))
        met = met.join(real, "b", "left").where("least <> most or real")
        star = star.join(met, "b").select("a", F.when(F.col("real"), F.col("b")).otherwise(F.col("least")).alias("b"))
    return near.unionByName(star.where("a <> b").distinct())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def frequent(documents: DataFrame, wide: int, seed: int) -> np.ndarray:
    """The sorted hashes of frequent shingles, at most MOST_FREQUENT: those with the largest counts, by powers of two.

    All texts are counted, CHUNK hashes at a time; what is once in a chunk isn't handed on, so counts are low estimates.
    """

    def counted(parts):
        keys, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys[n > 1]), pa.array(n[n > 1].astype(np.int64))], ["key", "n"])

    def run(batches):
        parts, size = [np.empty(0, np.int64)], 0
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                parts.append(np.unique(shingle_hashes(t, wide, seed).view(np.int64)))
                size += len(parts[-1])
                if size > CHUNK:
                    yield counted(parts)
                    parts, size = [np.empty(0, np.int64)], 0
        yield counted(parts)

    counts = documents.select(text_of(documents).alias("_text")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = stored(counts.where(F.col("n") >= FREQUENT), "frequent")
    total, least = 0, None
    for power, n in sorted(counts.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count(F.lit(1))).collect(), reverse=True):
        total += n
        if total > MOST_FREQUENT:
            break
        least = 1 << power
    found = counts.where(F.col("n") >= least).select("key").collect() if least else []
    release(counts)
    return np.array(sorted(r["key"] for r in found), np.int64)


def _sketches(documents: DataFrame, carried: list[str], least: float, wide: int, shingle: int, seed: int) -> DataFrame:
    """The ``carried`` columns, _text, _fp, n, rare, prefix, mask: per document a hash of its text, its fingerprint, and of its set of ``wide``-word
    shingles the number, the share of rare ones, the first hashes (one of which every set at ``least`` shares) and, per bit, if an odd number of hashes fall on it.

    Hashes are ordered by whether they are frequent, then as signed numbers.
    """
    often = documents.sparkSession.sparkContext.broadcast(frequent(documents, wide, seed))  # MOST_FREQUENT numbers
    given = documents.select(*carried, F.xxhash64(text_of(documents)).alias("_hash"), text_of(documents).alias("_text"))

    def run(batches):
        common = often.value
        for b in slices(batches):
            fps, sizes, shares, prefixes, masks = [], [], [], [], []
            for t in b.column(len(carried) + 1).to_pylist():
                fps.append(fingerprint(t, shingle, seed))
                h = np.unique(shingle_hashes(t, wide, seed).view(np.int64))
                known = np.zeros(len(h), bool)
                if len(common):
                    known = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
                sizes.append(len(h))
                shares.append(1 - float(known.mean()) if len(h) else 0.0)
                prefixes.append(np.concatenate([h[~known], h[known]])[: len(h) - ceil(least * len(h) - 1e-9) + 1])
                odd = np.bincount(h & 255, minlength=256) % 2 == 1
                masks.append(np.packbits(odd).view(">i8").astype(np.int64))
            lists = pa.list_(pa.int64())
            found = [pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(shares, pa.float64()), pa.array(prefixes, lists), pa.array(masks, lists)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *found], [*carried, "_text", "_fp", "n", "rare", "prefix", "mask"])

    return given.mapInArrow(run, f"{_fields(given, carried)}, _text long, _fp long, n long, rare double, prefix array<long>, mask array<long>")


def _sets(documents: DataFrame, wanted: DataFrame, wide: int, seed: int) -> DataFrame:
    """(_text, hashes) of the texts in ``wanted``."""

    def run(batches):
        for b in slices(batches):
            found = [np.unique(shingle_hashes(t, wide, seed)).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["_text", "hashes"])

    given = documents.select(F.xxhash64(text_of(documents)).alias("_text"), text_of(documents).alias("text"))
    given = given.join(wanted, "_text", "left_semi").dropDuplicates(["_text"])
    return given.mapInArrow(run, "_text long, hashes array<long>")


def _verified(documents: DataFrame, pairs: DataFrame, least: float, wide: int, seed: int) -> DataFrame:
    """The pairs (a, b) of texts whose shingle sets have at least the similarity."""
    pairs = stored(pairs.select("a", "b").distinct(), "candidates")
    wanted = pairs.select(F.col("a").alias("_text")).union(pairs.select("b")).distinct()
    sets = stored(_sets(documents, wanted, wide, seed), "sets")
    x, y = sets.toDF("a", "ha"), sets.toDF("b", "hb")
    both = F.size(F.array_intersect("ha", "hb"))
    kept = pairs.join(x, "a").join(y, "b").where(both >= least * (F.size("ha") + F.size("hb") - both) - 1e-9)
    kept = stored(kept.select("a", "b"), "alike")
    release(pairs, sets)
    return kept


def alike(documents: DataFrame, sketches: DataFrame, least: float, wide: int, seed: int = 42) -> DataFrame:
    """Edges (a, b) of fingerprints that join all texts whose sets of ``wide``-word shingles have a Jaccard similarity of ``least``.

    Sets of n hashes that are alike share at least least * n of them, so one of the first n - ceil(least * n) + 1 of each. In a list of
    the texts with such a hash all are first compared with the one that has the smallest share of rare shingles; then pairs that this doesn't connect are. A
    pair is not looked at if its sizes, or the bits in which the masks differ (no more than the hashes in one set only), rule it out. Nor is it if the
    hash is so far from the start of one set that fewer than the shared hashes they need are left; a pair that is alike passes at the first hash that it shares.
    """
    info = stored(sketches.where("n > 0").select("_text", "_fp", "n", "rare", "prefix", "mask").dropDuplicates(["_text"]), "texts")
    posts = info.select("_text", "n", "rare", F.posexplode("prefix").alias("place", "key"))
    hubs = posts.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("rare", "_text"))["_text"].alias("hub")).where("many > 1").drop("many")
    posts = stored(posts.drop("rare").join(hubs, "key"), "prefixes")
    info = info.drop("rare", "prefix")

    def possible(x: str, y: str) -> Column:
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        apart = sum(F.bit_count(F.col(f"{x}.mask")[i].bitwiseXOR(F.col(f"{y}.mask")[i])) for i in range(4))
        near = (n >= least * m - 1e-9) & (m >= least * n - 1e-9)
        return near & (apart <= (n + m) * ((1 - least) / (1 + least)) + 1e-9)

    firsts = posts.where("_text <> hub").select(F.col("hub").alias("a"), F.col("_text").alias("b")).distinct().alias("p")
    firsts = firsts.join(info.alias("x"), F.col("p.a") == F.col("x._text")).join(info.alias("y"), F.col("p.b") == F.col("y._text"))
    linked = _verified(documents, firsts.where(possible("x", "y")).select("p.a", "p.b"), least, wide, seed)

    groups = components(linked).withColumnRenamed("node", "_text")
    members = posts.join(groups, "_text", "left").withColumn("group", F.coalesce("component", "_text")).drop("component", "hub")
    members = stored(members, "members")
    release(posts)
    apart = members.groupBy("key").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least <> most").select("key")
    rest = stored(members.join(apart, "key").join(info.select("_text", "mask"), "_text"), "apart")
    release(members)
    # Of a pair x has no more hashes than y. What x needs to share with a set of its own size bounds its place; y is listed for
    # the bands of sizes that its place leaves to x. Two sets of n and m hashes need (n + m) * need shared ones.
    need = least / (1 + least)
    band = lambda n: F.floor(F.log(n) / log(BAND) + 1e-9).cast("int")
    small = rest.where(F.col("place") <= F.col("n") * (1 - 2 * need) + 1e-9).withColumn("band", band(F.col("n").cast("double")))
    most = F.least(F.col("n").cast("double"), (F.col("n") - F.col("place")) / need - F.col("n") + 1e-6)
    large = rest.withColumn("fewest", F.greatest(F.lit(1.0), least * F.col("n") - 1e-6)).withColumn("most", most).where("most >= fewest")
    large = large.withColumn("band", F.explode(F.sequence(band(F.col("fewest")), band(F.col("most"))))).drop("fewest", "most")
    x, y = small.alias("x"), large.alias("y")
    ordered = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x._text") < F.col("y._text")))
    left = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) >= (F.col("x.n") + F.col("y.n")) * need - 1e-6
    fits = ordered & left & (F.col("x.group") != F.col("y.group")) & possible("x", "y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.band") == F.col("y.band")) & fits)
    pairs = pairs.select(F.col("x._text").alias("a"), F.col("y._text").alias("b"))
    found = linked.unionByName(_verified(documents, pairs, least, wide, seed))
    fps = info.select("_text", "_fp")
    release(rest)
    return found.join(fps.toDF("a", "fa"), "a").join(fps.toDF("b", "fb"), "b").where("fa <> fb").select(F.col("fa").alias("a"), F.col("fb").alias("b"))


def _named(documents: DataFrame, row: list[str], shingle: int, seed: int, bits: int, long_list: int, least: float | None, wide: int) -> DataFrame:
    """doc_id, the ``row`` columns, _fp and, of the row's component, ``first``: the flag of a null id, the least id and that row's place."""
    carried = ["doc_id", *row]
    if least is None:
        rows = stored(fingerprints(documents, carried, shingle, seed), "fingerprints")
    else:
        rows = stored(_sketches(documents, carried, least, wide, shingle, seed), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), *row)
    classes = stored(rows.groupBy("_fp").agg(F.min(order).alias("first")), "classes")
    edges = links(classes.select("_fp"), bits, long_list)
    if least is not None:
        edges = edges.unionByName(alike(documents, rows, least, wide, seed))
    joined = components(edges)
    found = classes.join(joined, F.col("_fp") == F.col("node"), "left").select("_fp", "first", F.coalesce("component", "_fp").alias("component"))
    firsts = found.groupBy("component").agg(F.min("first").alias("first"))
    labels = stored(found.drop("first").join(firsts, "component").select("_fp", "first"), "labels")
    return rows.join(labels, "_fp").select(*carried, "_fp", "first")


def near_duplicates(documents: DataFrame, shingle: int = 3, seed: int = 42, bits: int = 2, long_list: int = 24, least: float | None = None, wide: int = 5) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Fingerprints link at ``bits`` or fewer differing bits; with ``least`` also texts whose sets of ``wide``-word shingles have at least that
    Jaccard similarity, at whatever distance their fingerprints are. Texts without a word have fingerprint zero and link like any
    other. Rows may repeat; rows without doc_id count as links but name no component (one of only such rows has a null
    component_id). Other columns are not looked at. An empty table gives an empty result.
    """
    return _named(documents, [], shingle, seed, bits, long_list, least, wide).select(
        "doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id")
    )


def without_near_duplicates(documents: DataFrame, shingle: int = 3, seed: int = 42, bits: int = 2, long_list: int = 24, least: float | None = None, wide: int = 5) -> DataFrame:
    """The documents, all columns, of which one of each component of ``near_duplicates`` stays: that with the least doc_id, null last.

    Rows are known by their place in the files, so rows that share an id or have none are apart unless their texts are linked; of rows with the
    least id one stays. Texts without a word are one component. An empty table stays empty.
    """
    row = [fresh(documents, "_file"), fresh(documents, "_place")]
    numbered = keyed(documents, *row)
    found = _named(numbered, row, shingle, seed, bits, long_list, least, wide)
    first = F.struct(*[F.col(f"first.{c}") for c in row])
    gone = found.where(F.struct(*row) != first).select(*row)
    return numbered.join(gone, row, "left_anti").select(*documents.columns)
