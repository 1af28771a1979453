import math

import pytest
from pyspark.sql import functions as F

from siftwork.functions import scalars
from siftwork.operators import differences, features, graph

NODES = "graph_id string, node_id string, label string, url string, bb_id string, ord int"
EDGES = "graph_id string, src string, dst string, key int, color string, lhead string, ltail string"


def nodes(spark, *rows):
    return spark.createDataFrame([("g", n, label, url, bb, i) for i, (n, label, url, bb) in enumerate(rows)], NODES)


def edges(spark, *rows):
    return spark.createDataFrame([("g", *(list(r) + [0, "red", None, None][len(r) - 2 :])) for r in rows], EDGES)


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def test_edges_are_judged_by_their_first_parallel_edge(spark):
    e = edges(spark, ("a", "b", 0, "red"), ("a", "b", 1, "blue"), ("c", "d", 0, "blue"), ("c", "d", 1, "red"), ("u", "u", 0, "red"), ("x", "y", 0, "green"))
    assert pairs(graph.eliminate_edges(e), "src", "dst", "key") == [("a", "b", 0), ("a", "b", 1)]


def test_slices_of_cycles_and_branches(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "t"), ("z", "a"), ("c", "t", 1, "red"))
    start = spark.createDataFrame([("g", "b"), ("g", "t")], "graph_id string, root string")
    members, inner = graph.forward_slices(None, e, start)
    assert pairs(members, "root", "node_id") == [("b", "a"), ("b", "b"), ("b", "c"), ("b", "t"), ("t", "t")]
    assert pairs(inner, "src", "dst") == [("a", "b"), ("b", "c"), ("c", "a"), ("c", "t")]
    both = graph.forward_backward_slices(None, e, start)
    assert {r.node_id for r in both.where("root = 'b'").collect()} == {"a", "b", "c", "t", "z"}


def test_long_chains_are_reached(spark):
    e = edges(spark, *((str(i), str(i + 1)) for i in range(30)))
    got = graph.reach(spark.createDataFrame([("g", "0")], "graph_id string, root string"), e)
    assert got.count() == 31
    assert graph.reach(spark.createDataFrame([], "graph_id string, root string"), e).count() == 0


def test_roots_and_their_names(spark):
    n = nodes(
        spark,
        ("arg", "[f] IN ARG i32 %n", None, None), ("co", "[f] IN ARG i64 %s.coerce", None, None), ("glob", "[f] GLOB IN @limit = global i32 7", None, None),
        ("loc", "%x = alloca i32", None, None), ("same", "%n = alloca i32", None, None), ("num", "%12 = alloca i32", None, None), ("add", "%y = add i32 %x, 1", None, None),
        ("br", "br label %x = alloca", None, None), ("none", None, None, None), ("leaf", "%q = alloca i8", None, None), ("split", "%s = alloca i8", None, None),
    )
    e = edges(spark, *((k, "end") for k in ("arg", "co", "glob", "loc", "same", "num", "add", "br", "none", "split")))
    got = {r.node_id: (r.kind, r.name) for r in graph.roots(n, e).collect()}
    assert got == {"arg": ("ARG", "n"), "glob": ("GLB", "limit"), "loc": ("LCL", "x"), "same": ("ARG", "n"), "split": ("ARG", "s")}


@pytest.mark.parametrize(
    ("label", "want"),
    [
        ("%3 = load i32, i32* %x, align 4", "load i32 i32*"), ("%p = alloca %struct.foo*, align 8", "alloca %struct.foo*"), ("%c = icmp eq i32 %a, 0", "icmp eq i32"),
        ("call void @free(i8* %p)", "call void @free i8*"), ("store i8* null, i8** %p", "store i8* null i8**"), ("getelementptr @.str.12, i64 1e3 0x1f nan !dbg #5 $a ~b ...", "getelementptr @.str i64"), ("load @seen @other", "load @other"),
    ],
)
def test_label_abstraction(spark, label, want):
    got = spark.createDataFrame([(label, ["seen"])], "l string, g array<string>").select(scalars.abstract_label(F.col("l"), F.col("g"))).first()[0]
    assert got == want


def test_numbers(spark):
    values = {"1": True, "-1.5e3": True, ".5": True, "inf": True, "NaN": True, "1d": False, "0x1p3": False, "null": False, "": False, "1_0": False, " 2 ": True}
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", scalars.is_number(F.col("v")).alias("n")).collect()
    assert {r.v: r.n for r in got} == values


def test_blocks_quotient_and_chunks(spark):
    n = nodes(spark, ("a", "x", "f:3:1", "1"), ("b", "y", "f:4:1", "1"), ("c", "z", "f:5:9", "2"), ("d", "z", None, "3"), ("e", None, None, None))
    e = edges(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("b", "d"), ("c", "e"), ("c", "c"))
    assert pairs(graph.block_ends(n), "bb_id", "first_node", "last_node") == [("1", "a", "b"), ("2", "c", "c"), ("3", "d", "d")]
    assert pairs(graph.quotient(n, e, ["graph_id"]), "src_bb", "dst_bb") == [("1", "2"), ("1", "3")]
    assert pairs(graph.chunks(n, e, ["graph_id"], 1), "bbs", "node_id") == [("1", "a"), ("1", "b"), ("2", "c"), ("3", "d")]
    assert pairs(graph.chunks(n, e, ["graph_id"], 2), "bbs", "node_id") == [("1,2", "a"), ("1,2", "b"), ("1,2", "c"), ("1,3", "a"), ("1,3", "b"), ("1,3", "d")]
    assert graph.chunks(n, e, ["graph_id"], 3).count() == 0
    for bad in (0, -2):
        with pytest.raises(ValueError):
            graph.chunks(n, e, ["graph_id"], bad)
    control = edges(spark, ("b", "c", 0, "blue", "2", "1"), ("a", "d", 0, "red", "3", "1"))
    assert pairs(graph.lift_control_flow(n, control), "src", "dst") == [("b", "c")]
    slim = graph.abstract_nodes(n.select("graph_id", "node_id"), n)
    assert pairs(slim, "node_id", "label", "line") == [("a", "x", 3), ("b", "y", 4), ("c", "z", 5), ("d", "z", None)] or len(pairs(slim.select("node_id"))) == 4


def test_path_ngrams(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"))
    start = spark.createDataFrame([("g", "a")], "graph_id string, root string")
    assert pairs(graph.path_ngrams(e, start, 2), "members") == [("a,b",), ("a,c",), ("b,c",)]


def test_path_ngrams_of_a_long_path_and_of_no_roots(spark):
    e = edges(spark, *((f"n{k:02}", f"n{k + 1:02}") for k in range(40)))
    start = spark.createDataFrame([("g", "n00")], "graph_id string, root string")
    assert len(pairs(graph.path_ngrams(e, start, 2), "members")) == 40
    assert graph.path_ngrams(e, start.limit(0), 2).count() == 0


def test_wl_labels_ignore_node_names_and_see_direction(spark):
    n = nodes(spark, ("a", "x", None, None), ("b", "y", None, None), ("c", "y", None, None))
    renamed = nodes(spark, ("q", "y", None, None), ("p", "x", None, None), ("r", "y", None, None))
    words = lambda n, e: sorted(r.label for r in graph.wl_labels(n, e, 2).collect())
    base = words(n, edges(spark, ("a", "b"), ("a", "c")))
    assert base == words(renamed, edges(spark, ("p", "q"), ("p", "r")))
    assert base != words(n, edges(spark, ("b", "a"), ("a", "c")))


def test_wl_labels_are_hashes_of_labels_joined_by_underscores(spark):
    from hashlib import md5

    h = lambda t: md5(t.encode()).hexdigest()
    n = nodes(spark, ("a", "x", None, None), ("b", "bc", None, None), ("c", "a", None, None))
    got = {(r.node_id, r.round): r.label for r in graph.wl_labels(n, edges(spark, ("a", "b"), ("a", "c")), 2).collect()}
    assert got["a", 1] == h("x_a_bc") and got["b", 1] == h("bc") and got["c", 2] == h(h("a"))
    assert got["a", 2] == h("_".join([h("x_a_bc"), *sorted([h("a"), h("bc")])]))


def test_kernel_is_one_for_equal_graphs(spark):
    n = spark.createDataFrame([(g, k, label) for g in (1, 2, 3) for k, label in enumerate("xyz" if g < 3 else "xxx")], "graph_id int, node_id int, label string")
    e = spark.createDataFrame([(g, 0, 1) for g in (1, 2, 3)], "graph_id int, src int, dst int")
    got = {(r.a, r.b): r.kernel for r in graph.wl_kernel(graph.wl_labels(n, e, 1)).collect()}
    assert got[1, 2] == pytest.approx(1) and got[1, 3] < 1 and got[1, 3] == got[2, 3]


def test_hashes_keep_items_apart(spark):
    n = spark.createDataFrame([("a", "f", "1", 12, "x"), ("a", "f", "1", 3, "x"), ("b", "f", "1", 1, "x"), ("b", "f", "1", 23, "x"), ("c", "f", "1", 3, "x"), ("c", "f", "1", 12, "x")], "id string, file string, bb_id string, line int, label string")
    got = {r.id: r.hash for r in graph.construct_hash(n, ["id"]).collect()}
    assert got["a"] == got["c"] != got["b"]
    both = spark.createDataFrame([("l1", "h", 5), ("l0", "h", 5), ("l2", "k", 2)], "location string, hash string, n_nodes int")
    assert [r.location for r in graph.eligible(both).collect()] == ["l0"]


def test_entropy_and_spectrum(spark):
    n = nodes(spark, ("a", "x", None, None), ("b", "y", None, None), ("c", "y", None, None))
    assert graph.degree_entropy(edges(spark, ("a", "b"), ("a", "c")), n).first().entropy == pytest.approx(-(math.log2(1 / 3) / 3 + 2 * math.log2(2 / 3) / 3))
    e = edges(spark, ("a", "b"), ("a", "c")).unionByName(edges(spark, ("p", "q"), ("p", "r")).withColumn("graph_id", F.lit("h")))
    got = graph.spectrum_distance(e, spark.createDataFrame([("g", "h")], "a string, b string")).first()
    assert got.distance == pytest.approx(0)
    scaled = graph.scaled_distances(spark.createDataFrame([(1, 2, 4.0), (1, 3, 2.0), (2, 3, 0.0), (4, 5, 0.0)], "a int, b int, distance double"))
    assert {tuple(r) for r in scaled.where("a IN (1, 4)").collect()} == {(1, 2, 1.0), (1, 3, 1.0), (4, 5, 0.0)}


def test_edge_list_utilities(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (2, 3)], "src int, dst int")
    assert pairs(graph.undirected(e)) == [(1, 2), (2, 1), (2, 3), (3, 2)]
    assert graph.graph_size(e).first().asDict() == {"n_vertices": 3, "n_edges": 2, "n_loops": 1}
    assert pairs(graph.degrees(graph.undirected(e))) == [(1, 1), (2, 2), (3, 1)]
    assert pairs(graph.subgraph(e, spark.createDataFrame([(1,), (2,)], "v int"))) == [(1, 2), (2, 1)]
    loops = spark.createDataFrame([(1, 1), (2, 1)], "src int, dst int")
    assert pairs(graph.without_loops(loops)) == [(2, 1)]
    assert [tuple(r) for r in graph.adjacency(loops.union(loops)).orderBy("v").collect()] == [(1, [1]), (2, [1])]
    three = spark.createDataFrame([(1,), (2,), (3,), (3,)], "v int")
    assert pairs(graph.clique(three)) == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)] and graph.clique(three.limit(0)).count() == 0
    assert pairs(graph.has_edge(e, spark.createDataFrame([(1, 2), (1, 3)], "src int, dst int"))) == [(1, 2, True), (1, 3, False)]


def test_features(spark):
    n = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b"), ("l", 4, "a")], "construct_id string, node_id int, label string")
    e = spark.createDataFrame([("k", 1, 2), ("k", 2, 3)], "construct_id string, src int, dst int")
    assert pairs(features.extract("NN", n, e)) == [("k", "a", 2), ("k", "b", 1), ("l", "a", 1)]
    assert ("k", "metadata_num_edges", 2) in pairs(features.extract("NNMD", n, e)) and ("k", "metadata_num_nodes", 3) in pairs(features.extract("NNMD", n, e))
    with pytest.raises(ValueError):
        features.extract("??", n, e)
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (4, [0.0, 1.0])], "node_id int, vec array<double>")
    assert {r.construct_id: r.vec for r in features.mean_vectors(n, v).collect()} == {"k": [2.0, 3.0], "l": [0.0, 1.0]}
    words = features.extract("G2v", n, e)
    emb = {r.construct_id: r.vec for r in features.hashed_embedding(words, 16).collect()}
    assert sum(x * x for x in emb["k"]) == pytest.approx(1) and len(emb["l"]) == 16
    docs = [features.document_vectors(words, 4, 2).orderBy("construct_id").collect() for _ in range(2)]
    assert docs[0] == docs[1] and len(docs[0]) == 2
    ast = spark.createDataFrame([("1", "CALL_EXPR", "f"), ("2", "MEMBER_REF", "m"), ("3", "CALL_EXPR", "")], "id string, type string, spelling string")
    of = spark.createDataFrame([("fn", "1"), ("fn", "2"), ("fn", "3")], "function string, id string")
    assert pairs(features.ast_features(ast, of, ("C", "MR"))) == [("fn", "call:f", 1), ("fn", "member:m", 1)]
    assert ("fn", "CALL_EXPR", 2) in pairs(features.ast_features(ast, of))


def test_locations_and_lines(spark):
    path = "/p/f.c/afs/_ODD_main.pdg_ARG_buf_len_0xA1_0xB2.afs.bb2.dot"
    got = differences.parse_location(spark.createDataFrame([(path,)], "location string")).first()
    assert (got.file, got.dependency, got.function, got.kind, got.variable, got.bbs, got.granularity) == ("/p/f.c", "_ODD_", "main", "ARG", "buf_len", ["0xA1", "0xB2"], "afs.bb2")
    n = spark.createDataFrame([("k", "a", 5), ("k", "a", 3), ("k", "b", None), ("k", "a", 5)], "construct_id string, label string, line int")
    assert differences.construct_lines(n).first().lines == [3, 5]
    assert {r.label: r.lines for r in differences.label_lines(n).collect()} == {"a": ["3", "5", "5"], "b": []}
