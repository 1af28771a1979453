import threading
import tracemalloc
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest

from siftwork import queries
from siftwork.operators import cluster
from siftwork.plans.together import gathering


@pytest.mark.parametrize("name", ["affinity", "mean_shift"])
def test_all_vectors_are_clustered_together(spark, monkeypatch, name):
    rows = [(i, [float(i % 3) * 10 + i * 0.001, float(i % 3) * 7]) for i in range(24)]
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    monkeypatch.setattr(queries, "vectors", lambda spark, d: v)
    got = {r.id: r.cluster for r in queries.QUERIES[name](spark, "").collect()}
    assert got == {i: i % 3 for i, _ in rows}


@pytest.mark.parametrize("cosine", [False, True])
def test_affinity_holds_the_matrices_by_rows(cosine):
    x = np.random.default_rng(5).standard_normal((41, 6))
    whole = cluster._affinity_rows(x, 0, 41, None, cosine, 0.5, 60, lambda v: [v])
    square = lambda v: -((v[:, None] - v[None]) ** 2).sum(axis=2)
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    s = square(unit @ unit.T if cosine else x)
    assert cluster._middle(np.abs(s), 41, 41 * 40, lambda v: [v]) == pytest.approx(-np.median(s[~np.eye(41, dtype=bool)]), rel=1e-12)
    meet, told = threading.Barrier(3), [None] * 3

    def part(k):
        def gather(v):
            told[k] = v
            meet.wait(30)
            out = list(told)
            meet.wait(30)
            return out

        return cluster._affinity_rows(x, 41 * k // 3, 41 * (k + 1) // 3, None, cosine, 0.5, 60, gather)

    with ThreadPoolExecutor(3) as pool:
        for of in pool.map(part, range(3)):
            assert (of == whole).all() and 1 < len(set(of)) < 41


def test_tasks_of_a_barrier_gather(spark):
    def run(numbers):
        with gathering() as gather:
            (k,) = numbers
            for i in range(50):
                got = gather(np.full(3 + k, k * 100.0 + i))
            return [[float(v[0]) for v in got] + [len(v) for v in got]]

    got = spark.sparkContext.parallelize(range(3), 3).barrier().mapPartitions(run).collect()
    assert got == [[49.0, 149.0, 249.0, 3, 4, 5]] * 3


def test_mean_shift_climbs_in_several_tasks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((300, 3)) + rng.integers(0, 3, (300, 1)) * 6).round(3)
    modes, weight = cluster._climb(x, x, 2.0, 300)
    of = ((x[:, None] - modes[cluster._centres(modes, weight, 2.0)][None]) ** 2).sum(axis=2).argmin(axis=1)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>").repartition(3)
    written, whole = {}, cluster.materialise
    monkeypatch.setattr(cluster, "materialise", lambda df, name, *a: written.setdefault(name, whole(df, name, *a)))
    got = {r.id: r.cluster for r in cluster.mean_shift(v, 2.0).collect()}
    assert written["modes"].count() == 4 and len(got) == 300
    assert got == {i: int(np.flatnonzero(of == of[i])[0]) for i in range(300)} and 1 < len(set(got.values())) < 300


def test_affinity_holds_no_square(monkeypatch):
    """the memory of a task does not grow with the square of the vectors."""
    monkeypatch.setattr(cluster, "AREA", 1 << 17, raising=False)
    x = np.random.default_rng(7).standard_normal((2500, 8))
    tracemalloc.start()
    of = cluster._affinity_rows(x, 0, 2500, None, False, 0.5, 20, lambda v: [v])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * 2500**2 and 1 < len(set(of)) < 2500


@pytest.mark.parametrize("kind", ["spread", "groups", "copies"])
@pytest.mark.parametrize("preference", [None, -0.1, 0.0])
def test_affinity_takes_in_entries_late(monkeypatch, kind, preference):
    """entries that begin to count in a later round are as if held from the first, and all rounds are those of whole matrices."""
    monkeypatch.setattr(cluster, "LIVE", 2, raising=False)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((90, 3))
    x = {"spread": x, "groups": x * 0.05 + rng.integers(0, 4, (90, 1)) * 5, "copies": np.repeat(x[:30], 3, axis=0)}[kind]
    points = cluster._Points(x, preference or 0.0)
    if preference is None:
        points.preference = -float(np.median(((x[:, None] - x[None]) ** 2).sum(axis=2)[~np.eye(90, dtype=bool)]))
    i, k = (v.ravel() for v in np.indices((90, 90)))
    s = points.similarities(i, k).reshape(90, 90)
    r, a, at = np.zeros((90, 90)), np.zeros((90, 90)), np.arange(90)
    live = cluster._Live(points, 0, 90, 0.5)
    for _ in range(60):
        t = a + s
        k = t.argmax(axis=1)
        first = t[at, k]
        t[at, k] = -np.inf
        t, best = s - first[:, None], s[at, k] - t.max(axis=1)
        t[at, k] = best
        r = 0.5 * r + 0.5 * t
        p = np.maximum(r, 0)
        p[at, at] = r[at, at]
        t = p.sum(axis=0)[None] - p
        a = 0.5 * a + 0.5 * np.where(np.eye(90, dtype=bool), t, np.minimum(t, 0))
        live.round(lambda v: [v])
        of = np.repeat(at, np.diff(live.start))
        assert live.r == pytest.approx(r[of, live.col], abs=1e-8) and live.a == pytest.approx(a[of, live.col], abs=1e-8)
    assert len(live.col) < 90 * 90 or kind == "copies"
    score = (a + r)[at, at]
    exemplars = np.flatnonzero(score > 0) if (score > 0).any() else np.array([score.argmax()])
    want = exemplars[s[:, exemplars].argmax(axis=1)]
    want[exemplars] = exemplars
    assert (cluster._affinity_rows(x, 0, 90, preference, False, 0.5, 60, lambda v: [v]) == want).all()
