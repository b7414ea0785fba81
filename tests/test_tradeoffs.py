"""Trade-off routes against all simple paths, and nearest targets against all pairs."""

import math

import numpy as np
import pytest

from orograph.operators import pareto, spatial

E = "u long, v long, time_s double, ascent_m double, heat_dose double, energy_kcal double"


def network(seed, n=8, degree=3):
    rng = np.random.default_rng(seed)
    return [(u, int(v), *(round(float(x), 2) for x in rng.uniform(1, 10, 4))) for u in range(n) for v in rng.choice([x for x in range(n) if x != u], degree, replace=False)]


def all_paths(edges, src, dst):
    out, stack = [], [((src,), (0.0,) * 4)]
    while stack:
        path, sums = stack.pop()
        if path[-1] == dst:
            out.append((tuple(round(s, 6) for s in sums), path))
            continue
        stack += [((*path, v), tuple(a + b for a, b in zip(sums, w, strict=True))) for u, v, *w in edges if u == path[-1] and v not in path]
    return out


def beats(a, b):
    return a != b and all(x <= y for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_frontier_like_all_simple_paths(spark, seed):
    edges = network(seed)
    q = spark.createDataFrame([(1, 0, 5), (2, 3, 7), (3, 4, 4), (4, 2, 99)], "query_id long, src long, dst long")
    got = pareto.frontier(spark.createDataFrame(edges, E), q, epsilon=0.0).collect()
    for k, src, dst in ((1, 0, 5), (2, 3, 7)):
        vectors = {s for s, _ in all_paths(edges, src, dst)}
        want = {a for a in vectors if not any(beats(b, a) for b in vectors)}
        assert {tuple(round(r[s], 5) for s in pareto.SUMS) for r in got if r["query_id"] == k} == {tuple(round(x, 5) for x in a) for a in want}
    assert {r["query_id"] for r in got} == {k for k, src, dst in ((1, 0, 5), (2, 3, 7)) if all_paths(edges, src, dst)}


def test_archetypes_are_the_least_of_each(spark):
    edges = network(3)
    q = spark.createDataFrame([(1, 0, 5)], "query_id long, src long, dst long")
    rows = pareto.archetypes(pareto.frontier(spark.createDataFrame(edges, E), q)).collect()
    paths = {p: s for s, p in all_paths(edges, 0, 5)}
    by = {r["label"]: r for r in rows}
    least = [min(s[i] for s in paths.values()) for i in range(4)]
    assert by["fastest"]["time_s"] == pytest.approx(least[0])
    for i, s in enumerate(pareto.SUMS):
        assert min(r[s] for r in rows) == pytest.approx(least[i])
    for r in rows:
        assert paths[tuple(r["path"])] == pytest.approx([r[s] for s in pareto.SUMS])


def test_nearest_in_widening_circles_like_all_pairs(spark):
    rng = np.random.default_rng(5)
    points = [(i, *map(float, rng.uniform(0, 0.2, 2))) for i in range(60)] + [(99, 3.0, 3.0)]
    targets = [(i, *map(float, rng.uniform(0, 0.2, 2))) for i in range(15)] + [(15, points[0][1], points[0][2]), (16, points[0][1], points[0][2])]
    got = spatial.nearest(spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame(targets, "t long, tlon double, tlat double"), 20_000.0, "id", "t")

    def metres(a, b):
        p, q = math.radians(a[2]), math.radians(b[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(h))

    want = {p[0]: min((round(metres(p, t), 6), t[0]) for t in targets)[1] for p in points if p[0] != 99}
    assert {r["id"]: r["t"] for r in got.collect()} == want
