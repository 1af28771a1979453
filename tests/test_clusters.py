import random

import pytest
from pyspark.sql import functions as F

from siftwork.operators import cluster, differences, similarity, statistics
from siftwork.operators.components import components


def test_components_do_not_depend_on_order(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60) if i % 10 != 9] + [(3, 3), (5, 4)]
    for _ in range(2):
        rng.shuffle(links)
        got = {r.c: r.comp for r in components(spark.createDataFrame([(b, a) if rng.random() < 0.5 else (a, b) for a, b in links], "a int, b int")).collect()}
        assert got == {i: i - i % 10 for i in range(60) if i % 10}


def features(spark):
    rows = [("a", "x", 3), ("a", "y", 1), ("b", "x", 6), ("b", "y", 2), ("c", "x", 3), ("c", "z", 9), ("d", "q", 1), ("e", "q", 5), ("z", "n", 0), ("f", "x", 3), ("f", "y", 1)]
    return spark.createDataFrame(rows, "construct_id string, feature string, value int")


def brute(rows, threshold):
    vec = {}
    for i, f, v in rows:
        vec.setdefault(i, {})[f] = v
    out = {}
    for a in vec:
        for b in vec:
            na, nb = (sum(v * v for v in vec[k].values()) ** 0.5 for k in (a, b))
            if a < b and na and nb and (s := sum(v * vec[b].get(f, 0) for f, v in vec[a].items()) / na / nb) >= threshold - 1e-12:
                out[a, b] = s
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.95, 1.0])
def test_sparse_pairs_equal_brute_force(spark, threshold):
    rng = random.Random(2)
    more = [(f"r{i}", f"w{min(rng.randrange(8), rng.randrange(8))}", rng.randrange(1, 5)) for i in range(30) for _ in range(4)]
    more = list({(i, f): (i, f, v) for i, f, v in more}.values())
    f = features(spark).unionByName(spark.createDataFrame(more, "construct_id string, feature string, value int"))
    got = {(r.a, r.b): r.sim for r in similarity.sparse_pairs(f, threshold).collect()}
    want = brute([tuple(r) for r in f.collect()], threshold)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_links_of_copies_give_the_same_components(spark):
    f = features(spark)
    ids = f.select("construct_id").distinct()
    full = cluster.threshold_clusters(ids, similarity.sparse_pairs(f, 0.9), "construct_id")
    short = cluster.threshold_clusters(ids, similarity.similar_links(f, 0.9), "construct_id")
    assert sorted(full.collect()) == sorted(short.collect())
    assert {r.construct_id: r.cluster for r in full.collect()} == {"a": "a", "b": "a", "f": "a", "c": "c", "d": "d", "e": "d", "z": "z"}


@pytest.mark.parametrize("block", [2048, 3])
def test_dense_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0, 1.0]), (6, None), (7, [-1.0, 0.0])]
    v = spark.createDataFrame(rows, "id int, vec array<double>")
    got = {(r.a, r.b): round(r.sim, 6) for r in similarity.dense_pairs(v, 0.7).collect()}
    assert got == {(1, 2): 1.0, (1, 5): 0.707107, (2, 5): 0.707107, (3, 5): 0.707107}
    near = {(r.a, r.b) for r in similarity.dense_pairs(v, 1.0, metric="euclidean").collect()}
    assert near == {(1, 2), (1, 4), (1, 5), (3, 4), (3, 5), (4, 7)}


def test_dbscan(spark):
    items = spark.createDataFrame([(i,) for i in range(9)], "id int")
    near = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3), (5, 6), (3, 4)], "a int, b int")
    got = {r.id: (r.cluster, r.core) for r in cluster.dbscan(items, near, 3).collect()}
    assert got == {0: (0, True), 1: (0, True), 2: (0, True), 3: (0, True), 4: (0, False), 5: (None, False), 6: (None, False), 7: (None, False), 8: (None, False)}


def test_gate_and_two_steps(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.5]), (4, [0.0, 1.0]), (5, [0.0, 1.0])], "id int, vec array<double>")
    got = sorted(map(tuple, cluster.two_step(v, 0.85, 0.98).collect()))
    assert got == [(1, 1, 1), (1, 1, 2), (1, 3, 3), (4, 4, 4), (4, 4, 5)]
    assert sorted(map(tuple, cluster.two_step(v, 0.85, 0.98, most=2).collect())) == [(4, 4, 4), (4, 4, 5)]


def test_group_algorithms(spark):
    v = spark.createDataFrame([(i, [float(i // 3) * 10 + i % 3 * 0.1, 0.0]) for i in range(9)], "id int, vec array<double>")
    want = {i: i - i % 3 for i in range(9)}
    assert {r.id: r.cluster for r in cluster.mean_shift(v, 1.0).collect()} == want
    assert {r.id: r.cluster for r in cluster.affinity(v, None, False).collect()} == want
    assert {r.id for r in cluster.affinity(v, 0.0, True).collect()} == set(range(9))


def test_differences_and_ranks(spark):
    f = features(spark)
    nested = spark.createDataFrame([("a", 1, "a"), ("a", 1, "f"), ("a", 2, "b"), ("c", 1, "c"), ("d", 1, "d"), ("d", 2, "e")], "cluster string, sub int, construct_id string")
    got = sorted(map(tuple, differences.differing(nested.select("cluster", "construct_id"), f).collect()))
    assert got == [("a", "x"), ("a", "y"), ("d", "q")]
    assert [tuple(r) for r in differences.majority_rank(nested).collect()] == [("a", 2, 1), ("c", 1, 0), ("d", 2, 0)]
    places = nested.select("*", F.lit("f").alias("file"), F.col("construct_id").alias("function"), F.lit("v").alias("variable"), F.expr("cast(array() as array<string>)").alias("bbs"))
    ranks = {r.cluster: r.score for r in differences.composite_rank(places).collect()}
    assert ranks["d"] == pytest.approx(1 - (1 + 1 + 0 + 0 + 0) / 5) and "c" not in ranks


def test_statistics(spark):
    times = spark.createDataFrame([("s", "g", 60.0), ("s", "g", 60.0), ("t", None, 3600.0)], "stage string, granularity string, seconds double")
    assert sorted(map(tuple, statistics.stage_times(times).collect())) == [("s_g", 2.0, 0.033333), ("t", 60.0, 1.0), ("total", 62.0, 1.033333)]
    sizes = spark.createDataFrame([("g", n) for n in (1, 2, 3, 4)], "gran string, n_nodes int")
    got = statistics.size_distribution(sizes, ["gran"]).first()
    assert (got.q1, got.median, got.q3, got.n) == (1.75, 2.5, 3.25, 4)
    clusters = spark.createDataFrame([(1, "x/f.foo"), (1, "x/g.bar"), (2, "y/f.foo")], "cluster int, location string")
    known = spark.createDataFrame([("foo",), ("nothing_like_it",)], "function string")
    got = sorted((r.function, r.cluster, r.n, r.members) for r in statistics.clusters_of_functions(clusters, known).collect())
    assert got == [("foo", 1, 2, ["x/f.foo", "x/g.bar"]), ("foo", 2, 1, ["y/f.foo"])]
    assert [tuple(r) for r in statistics.biggest_clusters(clusters, 1).collect()] == [(1, 2)]


def test_zero_vectors_and_empty_slices_have_no_similarity(spark):
    clusters = spark.createDataFrame([("c", "a"), ("c", "b"), ("c", "z")], "cluster string, id string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("z", [0.0, 0.0])], "id string, vec array<double>")
    assert sorted((r.sub, r.id) for r in cluster.second_step(clusters, vectors, 0.9).collect()) == [("a", "a"), ("a", "b"), ("z", "z")]
    features = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("z", "x", 0)], "construct_id string, feature string, value int")
    slices = spark.createDataFrame([("g", i) for i in "abz"], "group string, construct_id string")
    assert sorted((r.a, r.b, r.sim) for r in statistics.slice_similarities(features, slices).collect()) == [("a", "b", 1.0), ("a", "z", 0.0), ("b", "z", 0.0)]


@pytest.mark.parametrize("metric, threshold", [("cosine", 0.8), ("euclidean", 0.7)])
def test_links_connect_what_pairs_connect(spark, monkeypatch, metric, threshold):
    monkeypatch.setattr(similarity, "BLOCK", 16)
    monkeypatch.setattr(similarity, "TASKS", 3)
    rng = random.Random(8)
    rows = [(k, [rng.gauss(0, 1) for _ in range(3)]) for k in range(120)] + [(200 + k, [1.0, 0.5, 0.0]) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, vec array<double>")
    pairs, links = similarity.dense_pairs(df, threshold, metric=metric), similarity.dense_links(df, threshold, metric=metric)
    as_map = lambda x: {r.c: r.comp for r in components(x).collect()}
    assert as_map(pairs) == as_map(links)
    assert links.count() < pairs.count() / 2


def test_topics_with_a_place_for_each_feature_and_by_hash(spark):
    rows = [(k, f"{'ab'[k % 2]}{j}", 5) for k in range(20) for j in range(6)]
    counts = spark.createDataFrame(rows, "construct_id int, feature string, value long")
    for vocabulary in (12, 4):
        got = {r.construct_id: r.cluster for r in cluster.lda(counts, 2, rounds=20, vocabulary=vocabulary).collect()}
        assert set(got) == set(range(20)) and set(got.values()) <= {0, 1}
        if vocabulary == 12:
            assert len({got[k] for k in range(0, 20, 2)}) == len({got[k] for k in range(1, 20, 2)}) == 1 and got[0] != got[1]
    assert cluster.lda(counts.limit(0), 2).count() == 0
