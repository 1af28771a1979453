import json

from pyspark.sql import functions as F

from siftwork.operators import features, structure
from siftwork.sources import readers, writers

DOT = """digraph "PDG" {
graph [compound=true]
subgraph cluster_bb_0xA {
  NODE0x1 [label="%x = alloca i32, \\"q\\"" labelURL="f.c:3:7"]
  NODE0x2 [label="store i32 0"]
} /* cluster_bb_0xA */
subgraph cluster_bb_0xB {
  NODE0x3 [label="br"]
} /* cluster_bb_0xB */
/* -- node 0x1 */
NODE0x1 -> NODE0x2 [color="red"]
NODE0x1 -> NODE0x2 [color="blue"]
NODE0x2 -> NODE0x3 [color="blue" lhead="cluster_bb_0xB" ltail="cluster_bb_0xA"]
}
"""


def test_dot(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "g.dot").write_text(DOT)
    (tmp_path / "g.txt").write_text("x")
    nodes, edges = readers.dot_files(spark, str(tmp_path))
    got = sorted((r.node_id, r.bb_id, r.url, r.ord) for r in nodes.collect())
    assert got == [("NODE0x1", "0xA", "f.c:3:7", 0), ("NODE0x2", "0xA", None, 1), ("NODE0x3", "0xB", None, 2)]
    assert sorted((r.src, r.dst, r.key, r.color, r.lhead) for r in edges.collect()) == [("NODE0x1", "NODE0x2", 0, "red", None), ("NODE0x1", "NODE0x2", 1, "blue", None), ("NODE0x2", "NODE0x3", 0, "blue", "cluster_bb_0xB")]
    names = [r.path.rsplit("/", 1)[1] for r in readers.files(spark, str(tmp_path), ".dot", within=["sub/"]).collect()]
    assert names == ["g.dot"]
    again = writers.dot_texts(nodes, edges).select("graph_id", "text")
    n2, e2 = readers.dot_graphs(again)
    assert sorted(r.node_id for r in n2.collect()) == ["NODE0x1", "NODE0x2", "NODE0x3"] and e2.count() == 3


def test_compile_db(spark, tmp_path):
    db = [
        {"file": "a.c", "directory": "/p/d", "arguments": ["cc", "-c", "-I.", "-I../inc", ".", "-o", "a.o", "-DX"]},
        {"file": "/q/b.c", "directory": "/p", "command": "cc -c -g -O2 b.o b.c -Iabs"},
        {"file": "c.cpp", "directory": "/p", "command": "c++ c.cpp"},
        {"file": "a.c", "directory": "/p/d", "arguments": ["cc", "-DY"]},
        {"directory": "/p"},
    ]
    (tmp_path / "db.json").write_text(json.dumps(db))
    read = readers.compile_db(spark, str(tmp_path / "db.json"))
    got = {r.path: r.args for r in readers.c_files(read).collect()}
    assert got == {"/p/d/a.c": ["-DY"], "/q/b.c": ["-O2", "-Iabs"]}
    first = readers.c_files(read.where("ord = 0")).first().args
    assert first == ["-I/p/d/.", "-I/p/d/../inc", "/p/d/.", "a.o", "-DX"]
    args = {r.path: r.args for r in readers.arguments_of(spark.createDataFrame([("/p/d/a.c",), ("/none",)], "path string"), read).collect()}
    assert args == {"/p/d/a.c": ["-I.", "-I/p/inc", ".", "a.o", "-DX"], "/none": None}
    missing = readers.missing_sources(read, spark.createDataFrame([("/p/d/a.c",)], "path string"))
    assert sorted(r.path for r in missing.collect()) == ["/p/c.cpp", "/q/b.c"]


def test_texts(spark, tmp_path):
    lines = spark.createDataFrame([("m", "define i32 @main(i32) : x inlinehint y"), ("m", "define void @go() : nothing"), ("m", "no name")], "file string, value string")
    assert sorted((r.function, r.inlinehint) for r in readers.functions_list(lines).collect()) == [("go", False), ("main", True)]
    numbered = spark.createDataFrame([("m", 1, "; Attrs: inlinehint"), ("m", 2, "define @f()")], "file string, line int, value string")
    assert readers.defined_functions(numbered).first().value == "define @f() : ; Attrs: inlinehint"
    edges, vertices = readers.edge_list(spark.createDataFrame([("1 2",), ("# no",), ("3",), ("2 1 # twice",)], "value string"))
    assert sorted(map(tuple, edges.collect())) == [(1, 2), (2, 1)] and sorted(r.v for r in vertices.collect()) == [1, 2, 3]
    edges, _ = readers.edge_list(spark.createDataFrame([("1 2 3",)], "value string"), undirected=False, adjacency=True)
    assert sorted(map(tuple, edges.collect())) == [(1, 2), (1, 3)]
    report = spark.createDataFrame(list(enumerate(["Cluster #7", "# Items 2", "x", "y", "=====", "Cluster #8", "# Items 1", "z"])), "ord int, value string")
    assert sorted(map(tuple, readers.cluster_report(report).collect())) == [("7", "x"), ("7", "y"), ("8", "z")]
    back = writers.cluster_report(readers.cluster_report(report)).collect()
    assert back[0].text == "Cluster #7\n# Items 2\nx\ny" and back[1].n == 1
    deps = spark.createDataFrame([("a.o: /x/y/h.h \\\n src/k.h a.c",)], "value string")
    assert sorted(r.dir for r in readers.include_dirs(deps).collect()) == ["/x", "/x/y", "src"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "step1_afs.time.txt").write_text("1.5\n")
    (tmp_path / "t" / "total.time.txt").write_text("oops")
    assert [tuple(r) for r in readers.stage_seconds(spark, str(tmp_path / "t")).collect()] == [("step1", "afs", 1.5)]
    (tmp_path / "c.json").write_text('{"a": [1,\n 2]}')
    assert readers.json_config(spark, str(tmp_path / "c.json"), "a array<int>").first().a == [1, 2]
    assert [r.project for r in readers.projects(spark.createDataFrame([(".git",), ("p",)], "project string")).collect()] == ["p"]


def test_feature_tables(spark, tmp_path):
    (tmp_path / "f.csv").write_text("location,call @f.x,store\nk,2,\nl,0,1\n")
    f = readers.feature_csv(spark, str(tmp_path / "f.csv"))
    assert sorted(map(tuple, f.collect())) == [("k", "call @f.x", 2.0), ("l", "store", 1.0)]
    assert readers.header(spark, str(tmp_path / "f.csv")) == ["location", "call @f.x", "store"]
    assert sorted(r.location for r in readers.locations(f).collect()) == ["k", "l"]
    assert sorted(map(tuple, writers.wide(f, ["store"]).collect())) == [("k", 0.0), ("l", 1.0)]
    out = str(tmp_path / "out")
    for module in ("m", "n", "m"):
        writers.write_features(f.withColumn("module", F.lit(module)), out)
    assert spark.read.parquet(out).count() == 4
    times = []
    with writers.timed(times, "s"):
        pass
    assert times[0][0] == "s"


def test_graphml(spark, tmp_path):
    (tmp_path / "a.graphml").write_text('<graphml><key attr.name="type" attr.type="string" for="node" id="d0"/><key attr.name="spelling" for="node" id="d1" attr.type="string"/><graph edgedefault="directed"><node id="1"><data key="d0">FUNCTION_DECL</data><data key="d1">f</data></node><node id="2"><data key="d0">CALL_EXPR</data></node><edge source="1" target="2"/></graph></graphml>')
    nodes, edges = readers.graphml(spark, str(tmp_path / "a.graphml"))
    assert sorted((str(r.id), r.type, r.spelling or "") for r in nodes.collect()) == [("1", "FUNCTION_DECL", "f"), ("2", "CALL_EXPR", "")]
    assert [(str(r.src), str(r.dst)) for r in edges.collect()] == [("1", "2")]


def test_structure(spark):
    e = spark.createDataFrame([(a, b) for a, b in [(1, 2), (2, 3), (3, 1), (3, 4)] for a, b in ((a, b), (b, a))], "src int, dst int")
    t = {(r.prev, r.cur, r.next): r.prob for r in structure.transitions(e).collect()}
    assert abs(t[1, 3, 1] - 4 / 9) < 1e-9 and abs(t[1, 3, 2] - 1 / 9) < 1e-9 and abs(t[1, 3, 4] - 4 / 9) < 1e-9
    links = {tuple(r) for r in e.collect()}
    walks = structure.walks(e, 3, 5).collect()
    assert len(walks) == 12 and all(len(w.path) == 5 and all(p in links for p in zip(w.path, w.path[1:])) for w in walks)
    assert sorted(walks) == sorted(structure.walks(e, 3, 5).collect())
    rings = {(r.v, r.layer): r.degrees for r in structure.rings(e, 3).collect()}
    assert rings == {(1, 0): [2], (1, 1): [2, 3], (1, 2): [1], (2, 0): [2], (2, 1): [2, 3], (2, 2): [1], (3, 0): [3], (3, 1): [1, 2, 2], (4, 0): [1], (4, 1): [3], (4, 2): [2, 2]}
    pairs = {(r.degree, r.freq) for row in structure.compact(structure.rings(e, 1)).where("v = 3 AND layer = 1").collect() for r in row.pairs}
    assert pairs == {(1, 1), (2, 2)}
    near = structure.candidates(e)
    d = {(r.v, r.u, r.layer): r.distance for r in structure.layer_distances(structure.rings(e, 2), near).collect()}
    assert d[1, 2, 2] == 0 and d[1, 4, 0] == 2.5 / 1.5 - 1
    w = structure.layer_weights(structure.layer_distances(structure.rings(e, 2), near))
    assert all(abs(r.s - 1) < 1e-9 for r in w.groupBy("layer", "v").agg(F.sum("weight").alias("s")).collect())
    paths = structure.structural_walks(w, 1, 4).collect()
    assert len(paths) == 4 and all(len(p.path) == 4 for p in paths)


def test_members_of_functions_within_functions(spark):
    nodes = spark.createDataFrame([(1, "FUNCTION_DECL"), (2, "STMT"), (3, "FUNCTION_DECL"), (4, "STMT"), (5, "STMT")], "id int, type string")
    e = spark.createDataFrame([(1, 2), (1, 3), (3, 4)], "src int, dst int")
    got = {tuple(r) for r in features.function_members(nodes, e).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (1, 4), (3, 3), (3, 4)}


def test_a_folder_of_parts_is_one_entry(spark, tmp_path):
    spark.range(20).repartition(3).write.parquet(str(tmp_path / "a.parquet" / "deep" / "a.parquet"))
    spark.range(2).coalesce(1).write.parquet(str(tmp_path / "b.parquet"))
    (tmp_path / "c.parquet").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"x")
    assert [*map(tuple, readers.entries(spark, str(tmp_path), ".parquet").orderBy("name").collect())] == [("a.parquet",), ("b.parquet",), ("c.parquet",)]
