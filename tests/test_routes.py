"""Route paths, alternatives and stops against a shortest-path search in plain Python on the smallest grid."""

import heapq

import pytest
from pyspark.sql import functions as F

from orograph.operators import graph
from orograph.sources.fixtures import load


@pytest.fixture(scope="module")
def edges(spark, sf_dir):
    return graph.edges_of(load(spark, sf_dir, "segments")).cache()


@pytest.fixture(scope="module")
def costs(edges):
    out = {}
    for r in graph.weighted(edges).select("u", "v", "cost").collect():
        out[r["u"], r["v"]] = min(r["cost"], out.get((r["u"], r["v"]), float("inf")))
    return out


def search(costs, src, dst, shut=()):
    near, best, queue = {}, {src: 0.0}, [(0.0, src)]
    for (u, v), c in costs.items():
        if (u, v) not in shut:
            near.setdefault(u, []).append((v, c))
    while queue:
        d, u = heapq.heappop(queue)
        if u == dst:
            return d
        for v, c in near.get(u, ()):
            if d <= best[u] and d + c < best.get(v, float("inf")):
                best[v] = d + c
                heapq.heappush(queue, (d + c, v))
    return None


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["pos"]):
        out.setdefault(r["query_id"], []).append((r["node"], r["cost"]))
    return out


QUERIES = [(1, 5, 140), (2, 140, 5), (3, 77, 78), (4, 20, 99)]


def test_routes_and_alternatives_cost_the_least(spark, edges, costs):
    q = spark.createDataFrame(QUERIES, "query_id long, src long, dst long")
    first = by_query(graph.routes(edges, q).collect())
    for k, src, dst in QUERIES:
        want = search(costs, src, dst)
        assert (k in first) == (want is not None)
        if want is not None:
            path = [n for n, _ in first[k]]
            assert (path[0], path[-1]) == (src, dst)
            assert sum(costs[e] for e in zip(path, path[1:], strict=False)) == pytest.approx(want)
            assert first[k][-1][1] == pytest.approx(want)
    other = by_query(graph.alternatives(edges, q).collect())
    for k, src, dst in QUERIES:
        used = set(zip([n for n, _ in first.get(k, [])], [n for n, _ in first.get(k, [])][1:], strict=False))
        want = search(costs, src, dst, used)
        if k in other:
            path = [n for n, _ in other[k]]
            assert not used & set(zip(path, path[1:], strict=False)) and len(path) > 2
            assert other[k][-1][1] == pytest.approx(want)
        else:
            assert want is None


def test_stops_in_order_and_routes_with_a_lost_leg(spark, edges, costs):
    stops = [(1, 0, 5), (1, 1, 60), (1, 2, 140), (2, 0, 5), (2, 1, 10**9)]
    got = graph.multi_stop(edges, spark.createDataFrame(stops, "route_id long, seq long, node long")).orderBy("route_id", "leg", "pos").collect()
    assert {r["route_id"] for r in got} == {1}
    path = [r["node"] for r in got]
    assert path[0] == 5 and path[-1] == 140 and 60 in path
    assert sum(costs[e] for e in zip(path, path[1:], strict=False)) == pytest.approx(search(costs, 5, 60) + search(costs, 60, 140))


def test_matrix_of_unreachable_and_equal_places(spark, edges):
    one = spark.createDataFrame([(1, 5), (2, 10**9)], "origin_id long, node long")
    two = spark.createDataFrame([(1, 5), (2, 10**9)], "destination_id long, node long")
    got = graph.matrix(edges, one, two).where(F.col("origin_id") == 1).collect()
    assert [(r["destination_id"], r["cost"]) for r in got] == [(1, 0.0)]
