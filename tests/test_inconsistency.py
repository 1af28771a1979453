import pytest
from pyspark.sql import functions as F

from siftwork.operators import differences
from siftwork.operators import inconsistency as q
from siftwork.plans.config import Config, Step, csv
from siftwork.sources.readers import source_lines

DOC = "_id string, ord int, construct_type string, dependency string, firststep_threshold double, subclusters array<struct<sub_cluster_number:int,constructs_total:int,constructs:array<struct<graph_path:string,source_file_path:string,lines:array<int>,function_name:string,bbs:array<string>,variable_name:string,node_diffs:array<struct<node_name:string,node_value:int,lines:array<string>>>>>>>"


def construct(*diffs, file="f.c", function="fn", lines=(1,)):
    return ("p", file, list(lines), function, [], "v", [(n, 1, list(at)) for n, at in diffs])


def doc(i, *subs, threshold=0.8, kind="afs", dep="_ODD_", ord=None):
    return (i, hash(i) % 1000 if ord is None else ord, kind, dep, threshold, [(k, len(s), list(s)) for k, s in enumerate(subs)])


def ids(df):
    return sorted(r._id for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    icmp, store, free, trunc = ("icmp eq i32", ["3"]), ("store i8* null i8**", []), ("call void @X_Free i8*", []), ("trunc i64 to i32", [])
    rows = [
        doc("check", [construct(icmp)], [construct()]), doc("store", [construct(store)]), doc("call", [construct(free)]), doc("type", [construct(trunc)]),
        doc("low", [construct(icmp)], threshold=0.65), doc("edge", [construct(icmp)], threshold=0.7), doc("bb", [construct(icmp)], kind="afs.bb1"), doc("cdd", [construct(icmp)], dep="_CDD_"), doc("named", [construct(("xicmp ", []))]),
    ]
    return spark.createDataFrame(rows, DOC)


def test_types_of_queries(docs):
    assert ids(q.select(docs, "check")) == ["bb", "cdd", "check", "edge"]
    assert ids(q.select(docs, "check", granularity=["afs"], dependency="odd")) == ["check", "edge"]
    assert ids(q.select(docs, "store")) == ["store"] and ids(q.select(docs, "call")) == ["call"] and ids(q.select(docs, "type")) == ["type"]
    assert ids(q.select(docs, "call", verbs=["alloc"])) == [] and ids(q.select(docs, "type", casts=["icmp"])) == ["bb", "cdd", "check", "edge"]
    assert ids(q.select(docs, "order")) == ["check"] and len(ids(q.select(docs, "all"))) == 8
    assert ids(q.by_ids(docs, ["low", "none"])) == ["low"]
    with pytest.raises(ValueError):
        q.select(docs, "chek")


def test_filters(spark):
    d = lambda n: [(f"icmp {k}", []) for k in range(n)]
    rows = [
        doc("five", *[[construct(lines=[k], file=f"{k}")] for k in range(5)], ord=1), doc("six", *[[construct(lines=[k], file=f"{k}x")] for k in range(6)], ord=2),
        doc("last", [construct(*d(3), file="a", lines=[1])], [construct(file="b", lines=[2])], ord=3), doc("many", [construct(file="a", lines=[4])], [construct(*d(3), file="b", lines=[5])], ord=4),
        doc("lines", [construct(("icmp", ["1", "2", "3"]), file="a", lines=[6]), construct(file="b", lines=[7])], ord=5),
        doc("overlap", [construct(lines=[1, 2]), construct(lines=[2, 3])], ord=6), doc("apart", [construct(lines=[1]), construct(lines=[3])], ord=7), doc("empty", [construct(lines=[]), construct(lines=[])], ord=8),
        doc("copy", [construct(lines=[1, 2]), construct(lines=[2, 3])], ord=9),
    ]
    marked = {r._id: r for r in q.mark(spark.createDataFrame(rows, DOC), "check").collect()}
    assert {k for k, r in marked.items() if r.too_many_subs} == {"six"}
    assert {k for k, r in marked.items() if r.too_many_diffs} == {"many", "lines"}
    assert {k for k, r in marked.items() if r.same_place} == {"overlap", "copy"}
    assert {k for k, r in marked.items() if r.repeated} == {"copy"}
    every = {r._id for r in q.mark(spark.createDataFrame(rows, DOC), "check", every_construct=True).where("too_many_diffs").collect()}
    assert every == {"last", "many", "lines"}
    assert not any(r.too_many_diffs for r in q.mark(spark.createDataFrame(rows, DOC), "all").collect())
    kept = q.kept(q.mark(spark.createDataFrame(rows, DOC), "check"))
    assert ids(kept) == ["apart", "empty", "five", "last"]
    assert tuple(q.counts(spark.createDataFrame(rows, DOC), kept).first()) == (9, 4)
    assert [r._id for r in q.page(kept, 2, 2).collect()] == ["last", "apart"]
    assert len(q.kept(q.mark(spark.createDataFrame(rows, DOC), "check"), filtering=False).collect()) == 9


def test_common_lines_start_at_the_first_construct_that_has_some(spark):
    rows = [doc("late", [construct(lines=()), construct(lines=(1, 2))], [construct(lines=(2,))]), doc("gap", [construct(lines=(1, 2)), construct(lines=())], [construct(lines=(2,))]), doc("none", [construct(lines=())])]
    got = {r._id: r.same_place for r in q.mark(spark.createDataFrame(rows, DOC), "check").collect()}
    assert got == {"late": True, "gap": False, "none": False}


def test_sources_and_excerpts(spark):
    text = source_lines(spark.createDataFrame([("f.c", "one\n  two\n\n two \nfive")], "file string, text string"))
    rows = [doc("same", [construct(lines=[2]), construct(lines=[4])], ord=1), doc("differs", [construct(("icmp x", ["2"]), lines=[2]), construct(lines=[5])], ord=2)]
    docs = spark.createDataFrame(rows, DOC)
    same = q.same_sources(docs, text)
    assert ids(same) == ["same"]
    assert {r._id for r in q.mark(docs, "order", same_source=same).where("same_source").collect()} == {"same"}
    got = sorted((r.k, r.line, r.kind, r.text) for r in q.excerpts(docs, text, "check").where("_id = 'differs'").collect())
    assert got == [(0, 1, "margin", "one"), (0, 2, "diff", "two"), (1, 4, "margin", "two"), (1, 5, "code", "five")]


def test_recall(spark):
    docs = spark.createDataFrame([doc("d", [construct(("icmp", ["3"]), lines=[3, 9])])], DOC)
    truth = spark.createDataFrame(
        [(1, "check", "p", [3], ["f.c"], ["fn"], [9]), (2, "check", "p", [4], ["f.c"], [], []), (3, "call", "p", [], [], [], []), (4, "check", "p", [], [], [], []), (5, "check", "other", [], [], [], [])],
        "id int, type string, benchmark string, line_diffs array<int>, files array<string>, functions array<string>, lines_no_diff array<int>",
    )
    assert {r.id: r.found_by for r in q.recall(docs, truth, "check", "p").collect()} == {1: ["d"], 2: [], 4: ["d"]}


def test_assembly(spark):
    nested = spark.createDataFrame([("k", "k", "k"), ("k", "m", "m"), ("k", "m", "n"), ("z", "z", "z")], "cluster string, sub string, construct_id string")
    feats = spark.createDataFrame([("k", "a.b", 2), ("m", "a.b", 1), ("n", "a.b", 1), ("m", "c", 1), ("k", "e", 1), ("m", "e", 1), ("n", "e", 1)], "construct_id string, feature string, value int")
    cons = nested.select("construct_id", F.lit("g").alias("graph_path"), F.lit("f.c").alias("source_file_path"), F.lit("fn").alias("function_name"), F.array(F.lit("b")).alias("bbs"), F.lit("v").alias("variable_name"), F.array(F.lit(1)).alias("lines"))
    lines = spark.createDataFrame([("k", "a.b", ["4"])], "construct_id string, label string, lines array<string>")
    out = differences.assemble(nested, cons, feats, lines, {"construct_type": "afs", "firststep_threshold": 0.95}).collect()
    assert len(out) == 1 and out[0].cluster == "k" and out[0].score == 1 and out[0].construct_type == "afs"
    subs = out[0].subclusters
    assert [s.constructs_total for s in subs] == [1, 2]
    first = {d.node_name: (d.node_value, d.lines) for d in subs[0].constructs[0].node_diffs}
    assert first == {"a;b": (2, ["4"]), "c": (0, [])}
    assert all({d.node_name for d in c.node_diffs} == {"a;b", "c"} for s in subs for c in s.constructs)


def test_config():
    assert csv("") == () and csv("a, b") == ("a", "b")
    assert Step.parse("afs_NN", "cc_0.95") == Step("NN", "cc", 0.95)
    for bad in ({"chunk_window": 0}, {"dependency": "x"}, {"granularity": ("q",)}, {"inconsistency_type": "x"}, {"big_clusters": 1}):
        with pytest.raises(ValueError):
            Config(**bad)
    with pytest.raises(ValueError):
        Step("NN", "nope", 1)


def test_bugs_that_ask_the_same_are_sought_once(spark):
    docs = spark.createDataFrame([doc(x, [construct(("icmp", ["3"]), lines=[3, 9])]) for x in "de"], DOC)
    truth = spark.createDataFrame([(i, "check", "p", [], ["f.c"], [], [9 if i % 2 else 8]) for i in [*range(40), 6]] + [(6, "check", "p", [], ["f.c"], [], [3])], "id int, type string, benchmark string, line_diffs array<int>, files array<string>, functions array<string>, lines_no_diff array<int>")
    asked = q.demands(truth, "check", "p")
    assert q.found(docs, asked).count() == 2 and asked.select("demand").distinct().count() == 3
    got = q.recall(docs, truth, "check", "p").collect()
    assert len(got) == 40 and {r.id: r.found_by for r in got} == {i: ["d", "e"] if i % 2 or i == 6 else [] for i in range(40)}
