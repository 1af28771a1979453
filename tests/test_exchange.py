import pytest

from siftwork.operators import cluster, features, graph, inconsistency
from siftwork.plans.config import Config, Step
from siftwork.sources import readers, writers
from tests.test_inconsistency import DOC, construct, doc


def test_dot_keeps_blocks_and_edges(spark):
    nodes = spark.createDataFrame([("g", "a", 'say "x"', "0xA"), ("g", "b", None, "0xA"), ("g", "c", "z", None)], "graph_id string, node_id string, label string, bb_id string")
    edges = spark.createDataFrame([("g", "a", "b", "red", None), ("g", "a", "b", "blue", "cluster_bb_0xA")], "graph_id string, src string, dst string, color string, lhead string")
    n, e = readers.dot_graphs(writers.dot_texts(nodes, edges))
    assert sorted((r.node_id, r.bb_id) for r in n.collect()) == [("a", "0xA"), ("b", "0xA"), ("c", None)]
    assert sorted((r.src, r.dst, r.color, r.lhead or "") for r in e.collect()) == [("a", "b", "blue", "cluster_bb_0xA"), ("a", "b", "red", "")]


def test_matrices_maps_and_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(0, "0 1.5 0"), (1, "0 0 0"), (2, "1 0 1")], "ord int, value string")
    assert sorted(map(tuple, readers.matrix_edges(rows).collect())) == [(0, 1), (2, 0), (2, 2)]
    maps = spark.createDataFrame([('{"1": [2, 3], "2": []}',), ("broken",)], "value string")
    assert sorted(map(tuple, readers.map_edges(maps).collect())) == [(1, 2), (1, 3)]
    writers.write_vectors(spark.createDataFrame([(7, [0.5, -1.0])], "id int, vec array<double>"), str(tmp_path / "v"))
    assert [tuple(r) for r in readers.vectors(spark, str(tmp_path / "v")).collect()] == [("7", [0.5, -1.0])]


def test_integer_labels_see_both_sides(spark):
    n = spark.createDataFrame([("g", k, "x") for k in "abcd"] + [("g", "e", None)], "graph_id string, node_id string, label string")
    e = spark.createDataFrame([("g", "a", "b"), ("g", "c", "b"), ("g", "b", "d")], "graph_id string, src string, dst string")
    got = {(r.node_id, r.round): r.label for r in graph.integer_wl(n, e, 2).collect()}
    assert len({got[k, 0] for k in "abcd"}) == 1 and got["e", 0] == 0
    assert got["a", 1] == got["c", 1] == got["d", 1] != got["b", 1] and got["e", 1] != got["a", 1]
    assert got["a", 2] == got["c", 2] == got["d", 2]
    words = {r.node_id: r.sentence.split() for r in graph.wl_sentences(graph.integer_wl(n, e, 1), e).where("round = 0").collect()}
    assert words["e"] == ["0+0"] and len(words["a"]) == 3 and len(words["b"]) == 3


def test_console_report(spark):
    docs = spark.createDataFrame([doc("b", [construct(lines=(3, 4)), construct(lines=(9,))], ord=2), doc("a", [construct()], [construct()], ord=1)], DOC)
    code = spark.createDataFrame([("b", 0, 4, "free(x);"), ("b", 1, 9, "hidden")], "_id string, k int, line int, text string")
    rows = {}
    for r in inconsistency.report(docs, code).orderBy("_id", "line").collect():
        rows.setdefault(r._id, []).append(r.text)
    assert rows["a"][0].startswith("Inconsistency #1 , Total subclusters: (2)") and rows["b"][0].startswith("Inconsistency #2 ,")
    assert rows["b"][1:] == ["Subcluster #0 , Total items: (2)", "f.c fn [3, 4]", "     4 free(x);", "f.c fn [9]", "+" * 80]


def test_steps_follow_the_settings(spark):
    counts = [("a", "x", 1), ("b", "x", 2), ("c", "x", 1), ("c", "y", 1), ("d", "y", 1), ("e", "y", 3)]
    first = spark.createDataFrame(counts, "id string, feature string, value int")
    vectors = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [0.1, 0.0]), ("c", [9.0, 9.0]), ("d", [0.0, 0.0]), ("e", [5.0, 0.0])], "id string, vec array<double>")
    got = lambda first_step, second_step, other: sorted(map(tuple, cluster.run_steps(Config(first=first_step, second=second_step), first, other).collect()))
    assert got(Step("NN", "cc", 0.9), Step("SM", "dbscan", 0.5), vectors) == [("a", "a", "a"), ("a", "a", "b"), ("d", "d", "d"), ("d", "e", "e")]
    assert got(Step("NN", "dbscancos", 0.7), Step("NN", "cc", 0.9), first) == [("a", "a", "a"), ("a", "a", "b"), ("a", "c", "c"), ("a", "d", "d"), ("a", "d", "e")]
    assert got(Step("NN", "cc", 0.9), Step("SM", "means", 0.5), vectors) == [("a", "a", "a"), ("a", "a", "b"), ("d", "d", "d"), ("d", "e", "e")]


def test_nested_report_names_only_divided_clusters(spark):
    nested = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (5, 5, "z"), (None, None, "w")], "cluster int, sub int, construct_id string")
    lines = spark.createDataFrame([("x", [3, 4])], "construct_id string, lines array<int>")
    differing = spark.createDataFrame([(1, "icmp")], "cluster int, feature string")
    rows = writers.nested_report(nested, lines, differing).collect()
    assert [r.cluster for r in rows] == [1] and "  x [3, 4]" in rows[0].text and "  y []" in rows[0].text and rows[0].text.index("icmp") > rows[0].text.index("  y")


def test_settings_from_flags():
    c = Config.parse(["-p", "a,b", "--first", "afs.bb1_NN", "dbscancos_0.9", "-t", "call", "--no-filtering", "-d", "odd", "--call-verbs", "free"])
    assert c.projects == ("a", "b") and c.first == Step("NN", "dbscancos", 0.9) and c.second == Step("G2v", "cc", 0.98)
    assert c.inconsistency_type == "call" and not c.filtering and c.call_verbs == ("free",) and c.granularity == Config().granularity
    for wrong in (["-g", "afs.bb9"], ["-t", "x"], ["--first", "afs_NN", "best_1"], ["--what"]):
        with pytest.raises(SystemExit):
            Config.parse(wrong)


def test_labels_that_stand_together_get_vectors(spark):
    sentences = spark.createDataFrame([("a b",), ("a b c",), (None,)], "sentence string")
    got = {r.label: r.vec for r in features.label_embeddings(sentences, 4).collect()}
    assert set(got) == {"a", "b", "c"} and all(len(v) == 4 for v in got.values())
