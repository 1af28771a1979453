import numpy as np
import pytest

from siftwork.operators import graph, similarity


def counts(spark, n):
    rng = np.random.default_rng(3)
    return [(f"i{i}", f"f{k}", int(v)) for i in range(n) for k, v in enumerate(rng.integers(0, 4, 3)) if v]


def brute(rows):
    items = {}
    for i, f, v in rows:
        items.setdefault(i, {})[f] = v
    norm = {i: sum(v * v for v in x.values()) ** 0.5 for i, x in items.items()}
    dots = {(a, b): sum(v * items[b].get(f, 0) for f, v in items[a].items()) for a in items for b in items if a < b}
    return {(a, b): d / (norm[a] * norm[b]) for (a, b), d in dots.items() if d}


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(similarity, "WIDE", 7)
    monkeypatch.setattr(similarity, "TILE", 16)


@pytest.mark.parametrize("least", [None, 0.9])
def test_products_of_counts_in_blocks(spark, small_blocks, least):
    rows = counts(spark, 30)
    got = similarity.count_products(spark.createDataFrame(rows, "id string, feature string, value long"), least).collect()
    want = {p: s for p, s in brute(rows).items() if least is None or s >= least}
    assert len(got) == len(want) and {(r.a, r.b): r.sim for r in got} == pytest.approx(want, rel=1e-12)


def test_frequent_features_join_no_pairs(spark, monkeypatch):
    """features that nearly all items have are not joined with themselves."""
    called = []
    whole = similarity.count_products
    monkeypatch.setattr(similarity, "count_products", lambda *a: called.append(1) or whole(*a))
    rows = counts(spark, 40)
    got = {(r.a, r.b): r.sim for r in similarity.sparse_pairs(spark.createDataFrame(rows, "construct_id string, feature string, value long"), 0.9).collect()}
    assert called and got == pytest.approx({p: s for p, s in brute(rows).items() if s >= 0.9 - 1e-12}, rel=1e-12)


def test_kernel_and_spectra_join_no_pairs(spark, small_blocks):
    """F1, F2, F5, F8: pairs of graphs are made in their own tasks; no later exchange or aggregate takes them."""
    e = spark.createDataFrame([(g, f"{g}-{k}", f"{g}-{k + 1}") for g in range(20) for k in range(1 + g % 5)], "graph_id long, src string, dst string")
    n = spark.createDataFrame([(g, f"{g}-{k}", "xyz"[(g + k) % 3]) for g in range(20) for k in range(2 + g % 5)], "graph_id long, node_id string, label string")
    kernel, spectra, scaled = graph.wl_kernel(graph.wl_labels(n, e, 1)), graph.spectrum_distance(e), graph.scaled_spectrum_distance(e)
    for out in (kernel, spectra, scaled):
        above = out._jdf.queryExecution().optimizedPlan().toString().split("MapInPandas")[0]
        assert "Join" not in above and "Aggregate" not in above
    want = {(i, j): sum((2 - 2 * np.cos(np.pi * k / (2 + i % 5)) - 2 + 2 * np.cos(np.pi * k / (2 + j % 5))) ** 2 for k in range(2 + min(i % 5, j % 5))) for i in range(20) for j in range(20)}
    assert {(r.a, r.b): r.distance for r in spectra.collect()} == pytest.approx({p: d for p, d in want.items() if p[0] < p[1]}, abs=1e-9)
    most = {j: max(want[i, j] for i in range(20)) for j in range(20)}
    assert {(r.a, r.b): r.distance for r in scaled.collect()} == pytest.approx({p: d / most[p[1]] for p, d in want.items() if p[0] != p[1]}, abs=1e-9)


def runs(rows):
    values = [r[2] for r in rows]
    return sum(x != y for x, y in zip(values, values[1:]))


def copies(n):
    """Edges and nodes of graphs of which each n-th is equal."""
    e = [(g, f"{g}-{k}", f"{g}-{k + 1}") for g in range(8 * n) for k in range(1 + g % n)]
    return e, [(g, f"{g}-{k}", "xyz"[k * (g % n) % 3]) for g in range(8 * n) for k in range(2 + g % n)]


@pytest.mark.parametrize("query", ["F2 spectrum_distance", "F3 scaled_spectrum_distance"])
def test_equal_distances_stand_together(spark, query):
    """Pairs of copies of graphs stand side by side, so that files hold their results as runs."""
    e = spark.createDataFrame(copies(5)[0], "graph_id long, src string, dst string")
    made = graph.spectrum_distance(e) if query.startswith("F2") else graph.scaled_spectrum_distance(e)
    got = made.collect()
    assert len(got) == len({(r.a, r.b) for r in got}) == 40 * 39 // (2 if query.startswith("F2") else 1) and runs(got) < len(got) / 3


@pytest.mark.parametrize("rounds", [0, 1])
def test_equal_kernels_stand_together(spark, rounds):
    """as distances do."""
    e, n = copies(5)
    labels = graph.wl_labels(spark.createDataFrame(n, "graph_id long, node_id string, label string"), spark.createDataFrame(e, "graph_id long, src string, dst string"), rounds)
    got = graph.wl_kernel(labels).collect()
    assert len(got) == len({(r.a, r.b) for r in got}) == 40 * 39 // 2 and runs(got) < len(got) / 3


def test_many_copies_are_dealt_to_all_blocks(spark, monkeypatch):
    """copies do not fill one block, where they are many."""
    monkeypatch.setattr(similarity, "WIDE", 50)
    blocks, whole = [], similarity.materialise
    monkeypatch.setattr(similarity, "materialise", lambda df, name, *a: blocks.append(whole(df, name, *a)) or blocks[-1])
    got = similarity.count_products(spark.createDataFrame([(i, "f", 1) for i in range(400)], "id long, feature string, value long"), None).collect()
    assert {(r.a, r.b) for r in got} == {(a, b) for a in range(400) for b in range(a + 1, 400)} and {r.sim for r in got} == {1.0}
    assert blocks[-1].count() == 8
