import itertools
import random

import pytest

from siftwork import queries
from siftwork.operators import graph, structure


def test_distances_cover_pairs_that_only_the_larger_vertex_chose(spark, monkeypatch):
    star = graph.undirected(spark.createDataFrame([(v, 41) for v in range(1, 41)], "src int, dst int"))
    monkeypatch.setattr(queries, "trade", lambda spark, d: star)
    chosen = {(r.v, r.u) for r in structure.candidates(star).collect()}
    assert any(v > u and (u, v) not in chosen for v, u in chosen)
    got = {(r.v, r.u) for r in queries.structural_distances(spark, "").collect()}
    assert got == {(min(p), max(p)) for p in chosen} and any(41 in p for p in got)


def full(x, y):
    """Warping over all cells, by its definition."""
    cost = lambda a, b: ((max(a[0], b[0]) + 0.5) / (min(a[0], b[0]) + 0.5) - 1) * max(a[1], b[1])
    total = {(-1, -1): 0.0}
    for i, j in itertools.product(range(len(x)), range(len(y))):
        total[i, j] = cost(x[i], y[j]) + min(total.get(p, float("inf")) for p in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
    return total[len(x) - 1, len(y) - 1]


def test_fast_warping_is_exact_where_its_radius_covers_all_and_near_elsewhere():
    draw = random.Random(3)
    for n, m in itertools.product((1, 2, 3, 4, 7, 20, 33), repeat=2):
        x, y = (sorted((draw.randint(1, 30), draw.randint(1, 4)) for _ in range(k)) for k in (n, m))
        exact = full(x, y)
        for radius in (None, 40):
            assert structure.fast_warp(x, y, radius)[0] == pytest.approx(exact)
        found, cells = structure.fast_warp(x, y, 1)
        assert found >= exact - 1e-9 and cells[0] == (n - 1, m - 1) and cells[-1] == (0, 0)
        assert all((a - c, b - d) in ((1, 0), (0, 1), (1, 1)) for (a, b), (c, d) in zip(cells, cells[1:]))
        if min(n, m) < 3:
            assert found == pytest.approx(exact)


def test_compact_rings_weigh_by_the_greater_frequency(spark):
    ring = spark.createDataFrame([(1, 0, [(2, 3)]), (2, 0, [(5, 2)]), (2, 1, [(1, 1)])], "v int, layer int, pairs array<struct<degree:long,freq:long>>")
    got = structure.layer_distances(ring, spark.createDataFrame([(1, 2)], "v int, u int")).collect()
    assert [(r.layer, r.distance) for r in got] == [(0, pytest.approx(3 * (5.5 / 2.5 - 1)))]


def test_candidates_in_many_parts_are_of_the_closest_degrees(spark, monkeypatch):
    monkeypatch.setattr(structure, "PART", 4)
    ring = graph.undirected(spark.createDataFrame([(v, (v + 1) % 40) for v in range(40)] + [(0, v) for v in range(2, 39)], "src int, dst int"))
    degree = {r.v: r.degree for r in graph.degrees(ring).collect()}
    got = structure.candidates(ring).collect()
    assert len({(r.v, r.u) for r in got}) == len(got) and {r.v for r in got} == set(range(40))
    assert all(degree[r.u] == degree[r.v] for r in got if r.v not in (0, 1, 39))
