"""Mixing, periodic runs and vector codes against plain Python, and over odd rows."""

import hashlib
import math
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orograph.llm import mixing, periodic_runs, queries, vector_codes

BIG = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, size string, `_part` int, many int"


# Mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets as the rule is told: deal out by weight, cap, deal out the excess again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, Fraction(0)), Fraction(share) * sum(sizes.values()), set(order)
    while left > 0 and open_:
        whole = sum(weight[s] for s in open_)
        given_ = {s: left * weight[s] / whole for s in open_}
        left = Fraction(0)
        for s, g in given_.items():
            target[s] += g
            if target[s] > most * sizes[s]:
                left += target[s] - Fraction(most) * sizes[s]
                target[s] = Fraction(most) * sizes[s]
                open_.discard(s)
    return target


def check_mix(rows, docs):
    """Sizes, targets, caps and closeness of a mix of (doc_id, text, source) rows."""
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(WORDS.findall(text or ""))
    want = plain_targets(sizes)
    took, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        s = r["source"]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], want[s], rel_tol=1e-12, abs_tol=1e-9)
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        ratio = float(want[s]) / sizes[s] if sizes[s] else 0.0
        assert math.floor(ratio) <= r["copies"] <= math.ceil(ratio)
        took[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(took[s] - float(want[s])) <= max(1, largest[s]) for s in sizes)
    return took, want


def test_mix_of_whole_table(spark):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()]
    df = spark.read.parquet(f"{BIG}/documents.parquet")
    got = mixing.mix(df).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, _, _ in docs)
    size = {d: len(WORDS.findall(t or "")) for d, t, _ in docs}
    assert all(r["size"] == size[r["doc_id"]] for r in got)
    took, want = check_mix(got, docs)
    # A source's last document is one of its small ones.
    assert sum(abs(took[s] - float(want[s])) for s in took) < 0.02 * sum(took.values())
    # Not the files or tasks, but rows and seed decide.
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert sorted(map(tuple, got)) != sorted(map(tuple, mixing.mix(df, seed=12).collect()))


def test_mix_of_odd_rows_over_many_nodes(spark):
    docs = [(i % 37 if i % 3 else None, "w " * (i * i % 90), "hot" if i % 2 else f"s{i % 5}") for i in range(900)]
    docs += [(1, "same words", "b")] * 700 + [(2, None, None), (3, "", None), (None, None, None), (4, "a b c", None)]
    df = spark.createDataFrame([(*d, "x", 1, 1) for d in docs], DOCS)
    got = mixing.mix(df, block=8, fan=3).collect()
    assert len(got) == len(docs)
    check_mix(got, docs)
    for text in ("", None):
        flat = spark.createDataFrame([(1, text, "a", "x", 1, 1), (2, None, None, "x", 1, 1)], DOCS)
        assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix(flat).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.mix(spark.createDataFrame([], DOCS)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 5000), st.booleans(), st.floats(0.001, 0.999)), min_size=1, max_size=60), st.floats(0.01, 0.99), st.integers(0, 10**6))
def test_settling_leaves_one_document_at_most_and_keeps_the_words(rows, common, seed):
    rows = sorted(rows, reverse=True)
    size = np.array([r[0] for r in rows], float)
    single = np.array([r[1] for r in rows])
    p = np.where(single, common, [r[2] for r in rows])
    after = mixing.settle(size, p, single, np.random.default_rng(seed).random(2 * len(p) + 2))
    assert ((after >= 0) & (after <= 1)).all() and ((after > 0) & (after < 1)).sum() <= 1
    assert math.isclose(size @ after, size @ p, rel_tol=1e-6, abs_tol=1e-3)


def test_settling_is_fair():
    size, rng = np.array([900.0, 400, 30, 30, 20, 3, 2, 1]), np.random.default_rng(5)
    single = np.array([True] * 6 + [False] * 2)
    p = np.where(single, 0.3, 0.6)
    mean = np.mean([mixing.settle(size, p, single, rng.random(20)) for _ in range(20_000)], 0)
    assert np.abs(mean - p).max() < 0.02


def test_targets_of_sources_over_many_ranges(spark):
    sizes = {f"s{i:03d}": (i * 7919) % 1000 for i in range(400)} | {None: 50, "é": 3, "\U0001f600": 8}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = plain_targets(sizes)
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in sizes)


# Periodic runs


def plain_runs(w):
    """Every stretch of every lag, by comparing words; of one stretch the smallest lag."""
    n, out = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, z - a, q) for (a, z), q in out.items())


PIECES = st.lists(st.tuples(st.integers(1, 90), st.integers(0, 6), st.integers(0, 89), st.integers(1, 3)), max_size=6)


@settings(max_examples=300, deadline=None)
@given(PIECES, st.integers(0, 10**6))
def test_runs_of_words_put_together(pieces, seed):
    rng, words = np.random.default_rng(seed), []
    for period, times, rest, kinds in pieces:
        base = [b"%d" % v for v in rng.integers(0, kinds, period)]
        words += base * times + base[: rest % (period + 1)]
    assert periodic_runs.runs(words) == plain_runs(words)


@pytest.mark.parametrize("period", [1, 7, 8, 9, 31, 32, 33, 63, 64, 65, 200])
def test_runs_just_long_enough(period):
    base, least = [b"p%d" % i for i in range(period)], max(24, 3 * period)
    for length in (least - 1, least, least + 1):
        words = [b"a"] + (base * (least // period + 2))[:length] + [b"z"]
        assert periodic_runs.runs(words) == ([(1, length, period)] if length >= least else [])


def test_long_repetitive_texts_take_no_square_of_their_length():
    base = [b"w%d" % i for i in range(40)]
    assert periodic_runs.runs(base * 5000) == [(0, 200_000, 40)]
    assert periodic_runs.runs([b"a"] * 100_000) == [(0, 100_000, 1)]
    assert periodic_runs.runs([b"w%d" % i for i in range(200_000)]) == []


def plain_row(doc, text):
    """The contract's columns by the plain way."""
    words = WORDS.findall(text or "")
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {i for a, n, q in found for i in range(a + q, a + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in found)
    return (doc, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_runs_of_whole_table(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in queries.op12_periodic_runs(spark, BIG).collect()}
    assert len(got) == len(docs) and sum(r[1] > 0 for r in got.values()) > 50
    for d in docs:
        if len(d["text"] or "") < 6000:
            assert got[d["doc_id"]] == plain_row(d["doc_id"], d["text"])


def test_runs_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a " * 30), (4, "é\x1c  " * 40), (4, "é\x1c  " * 40), (5, "x y " * 50_000)]
    df = spark.createDataFrame([(*r, None, "x", 1, 1) for r in rows], DOCS)
    got = periodic_runs.detect(df).collect()
    full = sorted(((r["doc_id"] or 0, r["n_runs"], r["start"], r["length"], r["period"], r["collapsed"]) for r in got), key=repr)
    assert full == sorted([(1, 0, None, None, None, ""), (2, 0, None, None, None, ""), (3, 0, None, None, None, ""), (0, 1, 0, 30, 1, "a"), (4, 1, 0, 40, 1, "é\x1c "), (4, 1, 0, 40, 1, "é\x1c "), (5, 1, 0, 100_000, 2, "x y")], key=repr)
    assert periodic_runs.detect(spark.createDataFrame([], DOCS)).collect() == []


# Vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """(code, error) by row place and the last codebooks, in whole numbers and one by one."""
    vs = [[math.floor(4096 * x) for x in v] for _, v in rows]
    w = len(vs[0]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0], vs[i]))[:entries]
    books = [[cut(vs[i], p) for i in first] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        met = [[[cut(v, p) for v in vs if near(v, p)[1] == i] for i in range(len(books[p]))] for p in range(parts)]
        books = [[[sum(c) // len(own) for c in zip(*own, strict=True)] if own else e for own, e in zip(met[p], books[p], strict=True)] for p in range(parts)]
    found = [[near(v, p) for p in range(parts)] for v in vs]
    return [("".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f)) for f in found], books


def test_codes_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.integers(-3, 4, 16).astype(float).tolist() if i % 4 else [0.5] * 16, [None, "a", "b"][i % 3]) for i in range(120)]
    bad = [(-1, None, "a"), (-2, [None] + [0.0] * 15, "a"), (-3, [float("nan")] * 16, None), (-4, [0.0] * 15 + [float("-inf")], "a")]
    df = spark.createDataFrame([(*r, "x", 1) for r in bad + good], "vec_id long, embedding array<double>, label string, V string, `Error` int").repartition(5)
    got = {r["vec_id"]: r for r in vector_codes.encode(df).collect()}
    want, books = plain_codes([g[:2] for g in good])
    assert sorted(got) == list(range(120))
    assert [(got[i]["code"], got[i]["error"]) for i in range(120)] == want
    told = ",".join(str(x) for b in books for e in b for x in e)
    assert {r["codebooks_sha256"] for r in got.values()} == {hashlib.sha256(told.encode()).hexdigest()}
    for label in (None, "a", "b"):
        assert {r["label_error"] for r in got.values() if r["label"] == label} == {sum(r["error"] for r in got.values() if r["label"] == label)}


def test_codes_of_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = vector_codes.encode(spark.createDataFrame([(2, [1.0] * 8), (1, [2.0] * 8), (1, [2.0] * 8), (None, [9.0] * 8)], schema)).collect()
    assert sorted(((r["vec_id"] or 0, r["code"], r["error"]) for r in few)) == [(0, "03" * 8, 0), (1, "00" * 8, 0), (1, "00" * 8, 0), (2, "02" * 8, 0)]
    assert vector_codes.encode(spark.createDataFrame([], schema)).collect() == vector_codes.encode(spark.createDataFrame([(1, None)], schema)).collect() == []
    with pytest.raises(ValueError, match="multiple of 8"):
        vector_codes.encode(spark.createDataFrame([(2, [1.0] * 8), (1, [2.0] * 16)], schema))
    with pytest.raises(Exception, match="512 or more"):
        vector_codes.encode(spark.createDataFrame([(2, [1e30] * 8)], schema))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 200), st.integers(1, 6), st.integers(1, 400), st.integers(0, 10**6), st.sampled_from([2, 5, 1000, 2**20]))
def test_the_tree_finds_the_first_of_the_nearest(k, width, n, seed, span):
    rng = np.random.default_rng(seed)
    entries, parts = rng.integers(-span, span, (k, width)), rng.integers(-span, span, (n, width))
    at, d = vector_codes.nearest(vector_codes.tree(entries), entries, parts)
    all_ = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (at == all_.argmin(1)).all() and (d == all_.min(1)).all()
