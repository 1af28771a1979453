"""Queries over inconsistency documents, filters on their results, recall, and report pages.

A document: _id, ord (its place in the store), construct_type, dependency, firststep_threshold and subclusters
(see differences.assemble).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import contains_all
from ..plans.config import CALL_VERBS, INCONSISTENCY_TYPES, STORED_VALUES, TYPE_CASTS

# At most so many sub-clusters, important differences, and lines of one.
MOST_SUBS, MOST_DIFFS, MOST_LINES = 5, 2, 2


def some_construct(test) -> Column:
    return F.exists("subclusters", lambda s: F.exists(s["constructs"], test))


def some_diff(test) -> Column:
    return some_construct(lambda c: F.exists(c["node_diffs"], lambda d: test(d["node_name"])))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def name_test(kind: str, name: Column, verbs: Sequence[str] = CALL_VERBS, casts: Sequence[str] = TYPE_CASTS, values: Sequence[str] = STORED_VALUES) -> Column:
    """Whether a difference's name is of the kind asked for."""
    if kind == "check":
        return name.rlike("^icmp .*")
    if kind == "store":
        return _any([name.rlike(f"^store.* {x} .*") for x in values])
    if kind == "call":
        return _any([name.rlike(f"(?i)call .*@.*?{x}.*") for x in verbs])
    if kind == "type":
        return _any([name.rlike(f"^{x} .*") for x in casts])
    raise ValueError(f"no name test for {kind}")


def select(docs: DataFrame, kind: str, threshold: float = 0.7, granularity: Sequence[str] = ("afs", "afs.bb1", "afs.bb2"), dependency: str = "", **lists) -> DataFrame:
    """Documents of an inconsistency type: check, store, call, type, order (a construct without differences) or all."""
    if kind not in INCONSISTENCY_TYPES:
        raise ValueError(f"unknown inconsistency type {kind}")
    out = docs.where((F.col("firststep_threshold") >= threshold) & F.col("construct_type").isin(*granularity))
    if dependency:
        out = out.where(F.col("dependency") == f"_{dependency.upper()}_")
    if kind == "all":
        return out
    if kind == "order":
        return out.where(some_construct(lambda c: F.size(c["node_diffs"]) == 0))
    return out.where(some_diff(lambda n: name_test(kind, n, **lists)))


def by_ids(docs: DataFrame, ids: Sequence) -> DataFrame:
    return docs.where(F.col("_id").isin(*ids))


def is_important(kind: str, name: Column, verbs: Sequence[str] = CALL_VERBS, casts: Sequence[str] = TYPE_CASTS) -> Column:
    """Differences that filters count; none for types order and all."""
    low = F.lower(name)
    if kind == "type":
        return _any([low.startswith(x) for x in casts])
    if kind == "check":
        return low.startswith("icmp")
    if kind == "store":
        return low.startswith("store")
    if kind == "call":
        return _any([low.rlike(f"call .*@.*{x}.*") for x in verbs])
    return F.lit(False)


def constructs() -> Column:
    return F.flatten(F.transform("subclusters", lambda s: s["constructs"]))


def mark(docs: DataFrame, kind: str, every_construct: bool = False, same_source: DataFrame | None = None, **lists) -> DataFrame:
    """Documents with the reasons to skip them (too_many_subs, too_many_diffs, same_place, repeated, same_source) and `skip`.

    too_many_diffs counts the important differences of the last construct, or of the construct with most if
    every_construct. A repeated document has the files, functions and lines of an earlier one, skipped or not.
    same_source: (_id), documents whose constructs read the same (type order only).
    """
    important = lambda c: F.filter(c["node_diffs"], lambda d: is_important(kind, d["node_name"], **lists))
    rows = docs.withColumn("_c", constructs())
    counts = F.transform("_c", lambda c: F.size(important(c)))
    n_diffs = F.array_max(counts) if every_construct else F.try_element_at(counts, F.lit(-1))
    n_lines = F.array_max(F.flatten(F.transform("_c", lambda c: F.transform(important(c), lambda d: F.size(d["lines"])))))
    lines = F.transform("_c", lambda c: F.array_distinct(c["lines"]))
    # constructs without lines before the first with some do not count, those after it do
    filled = F.filter(lines, lambda x, i: F.exists(F.slice(lines, F.lit(1), i + 1), lambda y: F.size(y) > 0))
    common = F.reduce(filled, F.get(filled, F.lit(0)), lambda a, b: F.array_intersect(a, b))
    longest = F.array_max(F.transform(lines, lambda x: F.size(x)))
    one = lambda f: F.size(F.array_distinct(F.transform("_c", lambda c: c[f]))) == 1
    text = lambda f: F.array_join(F.array_sort(F.transform("_c", lambda c: c[f])), "\x1f")
    all_lines = F.array_join(F.transform(F.array_sort(F.flatten(F.transform("_c", lambda c: c["lines"]))), lambda x: x.cast("string")), ",")
    key = F.sha1(F.concat_ws("\x1e", text("source_file_path"), text("function_name"), all_lines).cast("binary"))
    rows = rows.withColumn("_key", key)
    first = rows.groupBy("_key").agg(F.min(F.struct("ord", "_id")).alias("_first"))
    rows = rows.join(first, "_key").withColumn("repeated", F.struct("ord", "_id") > F.col("_first"))
    rows = rows.withColumn("too_many_subs", F.size("subclusters") > MOST_SUBS)
    rows = rows.withColumn("too_many_diffs", F.coalesce(n_diffs > MOST_DIFFS, F.lit(False)) | F.coalesce(n_lines > MOST_LINES, F.lit(False)))
    rows = rows.withColumn("same_place", F.coalesce(one("source_file_path") & one("function_name") & (longest > 0) & (F.size(common) > 0), F.lit(False)))
    if kind == "order" and same_source is not None:
        rows = rows.join(same_source.select("_id").distinct().withColumn("same_source", F.lit(True)), "_id", "left").fillna(False, ["same_source"])
    else:
        rows = rows.withColumn("same_source", F.lit(False))
    return rows.withColumn("skip", F.expr("too_many_subs OR too_many_diffs OR same_place OR repeated OR same_source")).drop("_c", "_key", "_first")


def kept(marked: DataFrame, filtering: bool = True) -> DataFrame:
    return marked.where(~F.col("skip")) if filtering else marked


def counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: documents before and after filters."""
    return before.agg(F.count("*").alias("n_before")).join(after.agg(F.count("*").alias("n_after")))


def same_sources(docs: DataFrame, source_lines: DataFrame) -> DataFrame:
    """(_id) of documents whose constructs all have the same stripped source lines. source_lines: (file, line, text)."""
    each = docs.select("_id", F.posexplode(constructs()).alias("k", "c")).select("_id", "k", F.col("c.source_file_path").alias("file"), F.explode_outer("c.lines").alias("line"))
    text = each.join(source_lines, ["file", "line"], "left").groupBy("_id", "k").agg(F.array_sort(F.collect_list(F.struct("line", F.trim("text").alias("t")))).alias("x"))
    read = text.select("_id", F.array_join(F.transform("x", lambda r: F.coalesce(r["t"], F.lit(""))), "\n").alias("t"))
    return read.groupBy("_id").agg(F.count_distinct("t").alias("n")).where("n = 1").select("_id")


def facts(docs: DataFrame) -> DataFrame:
    """(_id, files, functions, lines, diff_lines) sets of each document."""
    c = constructs()
    return docs.select(
        "_id",
        F.array_distinct(F.transform(c, lambda x: x["source_file_path"])).alias("files"),
        F.array_distinct(F.transform(c, lambda x: x["function_name"])).alias("functions"),
        F.array_distinct(F.flatten(F.transform(c, lambda x: x["lines"]))).alias("lines"),
        F.array_distinct(F.transform(F.flatten(F.flatten(F.transform(c, lambda x: F.transform(x["node_diffs"], lambda d: d["lines"])))), lambda s: s.cast("int"))).alias("diff_lines"),
    )


def demands(truth: DataFrame, kind: str, benchmark: str) -> DataFrame:
    """(id, demand), an id once, of the benchmark's bugs of the type: what a bug asks of a document, equal where bugs ask the
    same; an id that stands in several rows asks any one of them."""
    asked = F.struct(*(F.array_sort(F.array_distinct(c)).alias(c) for c in ("files", "functions", "lines_no_diff", "line_diffs")))
    return truth.where((F.col("type") == kind) & (F.col("benchmark") == benchmark)).groupBy("id").agg(F.array_sort(F.collect_set(asked)).alias("demand"))


def found(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(demand, found_by): each distinct demand that documents meet, with those that hold all its files, functions and lines. A
    demand that names a file meets only documents with that file; others meet all."""
    items = asked.select("demand").distinct().select("demand", F.inline("demand"))
    known = facts(docs)
    named = items.where(F.size("files") > 0).withColumn("file", F.get("files", F.lit(0)))
    met = named.join(known.withColumnRenamed("files", "_files").withColumnRenamed("functions", "_functions").withColumn("file", F.explode("_files")), "file")
    rest = items.where(F.size("files") == 0).withColumn("file", F.lit(None).cast("string"))
    # a bug without a file meets the documents with its first function or line; one that says nothing is in every document
    text = lambda c: F.get(c, F.lit(0)).cast("string")
    at = F.when(F.size("functions") > 0, F.concat(F.lit("function "), text("functions"))).when(F.size("lines_no_diff") > 0, F.concat(F.lit("line "), text("lines_no_diff"))).when(F.size("line_diffs") > 0, F.concat(F.lit("diff "), text("line_diffs"))).otherwise("")
    tagged = lambda kind_, c: F.transform(c, lambda x: F.concat(F.lit(kind_), x.cast("string")))
    named = known.withColumnRenamed("files", "_files").withColumnRenamed("functions", "_functions")
    spread = F.explode(F.array_distinct(F.concat(F.array(F.lit("")), tagged("function ", "_functions"), tagged("line ", "lines"), tagged("diff ", "diff_lines"))))
    met = met.unionByName(named.withColumn("at", spread).join(rest.withColumn("at", at), "at").select(*met.columns))
    hit = contains_all(F.col("diff_lines"), F.col("line_diffs")) & contains_all(F.col("_files"), F.col("files")) & contains_all(F.col("_functions"), F.col("functions")) & contains_all(F.col("lines"), F.col("lines_no_diff"))
    return met.where(hit).groupBy("demand").agg(F.array_sort(F.collect_set("_id")).alias("found_by"))


def recall(docs: DataFrame, truth: DataFrame, kind: str, benchmark: str) -> DataFrame:
    """(id, found_by): the benchmark's bugs of the type, with the documents that hold all their files, functions and lines; an
    empty array if missed. Bugs that ask the same are sought once."""
    asked = demands(truth, kind, benchmark)
    none = F.slice(F.array(F.lit(None).cast(dict(docs.dtypes)["_id"])), 1, 0)
    return asked.join(found(docs, asked), "demand", "left").select("id", F.coalesce("found_by", none).alias("found_by"))


def page(docs: DataFrame, starting_item: int, n: int | None = None) -> DataFrame:
    """Documents from a 1-based place on, in order of `ord`."""
    out = docs.orderBy("ord").offset(starting_item - 1)
    return out.limit(n) if n is not None else out


def excerpts(docs: DataFrame, source_lines: DataFrame, kind: str, **lists) -> DataFrame:
    """(_id, k, file, line, kind, text): non-blank source lines of each construct: `diff` where a difference of the type
    stands, `code` else, and `margin` next to them."""
    each = docs.select("_id", F.posexplode(constructs()).alias("k", "c"))
    hits = F.flatten(F.transform(F.filter("c.node_diffs", lambda d: is_important(kind, d["node_name"], **lists)), lambda d: F.transform(d["lines"], lambda s: s.cast("int"))))
    wanted = each.select("_id", "k", F.col("c.source_file_path").alias("file"), F.col("c.lines").alias("own"), hits.alias("hits"))
    around = F.array_distinct(F.flatten(F.transform("own", lambda x: F.array(x - 1, x, x + 1))))
    rows = wanted.withColumn("line", F.explode(around))
    place = F.when(~F.array_contains("own", F.col("line")), "margin").when(F.array_contains("hits", F.col("line")), "diff").otherwise("code")
    return rows.join(source_lines, ["file", "line"]).where(F.trim("text") != "").select("_id", "k", "file", "line", place.alias("kind"), F.trim("text").alias("text"))


def report(docs: DataFrame, code: DataFrame | None = None) -> DataFrame:
    """(_id, line, text): the documents as a console report, numbered by `ord`; in `line` order within a document.

    code: (_id, k, line, text), source lines of constructs as `excerpts` gives them; they are shown for the first
    construct of each sub-cluster, whose others are named with their lines only.
    """
    ranks = docs.select("_id", "ord")
    number = ranks.withColumn("i", F.row_number().over(W.orderBy("ord", "_id"))).select("_id", "i")  # ids alone are numbered together
    flow = F.when(F.col("dependency") == "_ODD_", "Data Flow").otherwise("Control&Data Flow")
    string = lambda c: F.col(c).cast("string")
    named = docs.join(number, "_id")
    head = F.concat(F.lit("Inconsistency #"), string("i"), F.lit(" , Total subclusters: ("), F.size("subclusters").cast("string"), F.lit(") , Granularity: ("), string("construct_type"), F.lit(") , Similarity: ("), string("firststep_threshold"), F.lit(") , ID: "), string("_id"), F.lit(" , Dependency: "), flow)
    tops = named.select("_id", F.array(F.lit(-1), F.lit(0), F.lit(0), F.lit(0)).alias("at"), F.concat(head, F.lit("\n" + "=" * 80)).alias("text"))
    subs = named.select("_id", F.posexplode("subclusters").alias("s", "sub"))
    heads = subs.select("_id", F.array(F.col("s"), F.lit(-1), F.lit(0), F.lit(0)).alias("at"), F.concat(F.lit("Subcluster #"), string("s"), F.lit(" , Total items: ("), F.col("sub.constructs_total").cast("string"), F.lit(")")).alias("text"))
    ends = subs.select("_id", F.array(F.col("s"), F.lit(1 << 30), F.lit(0), F.lit(0)).alias("at"), F.lit("+" * 80).alias("text"))
    each = subs.select("_id", "s", F.posexplode("sub.constructs").alias("c", "x"))
    place = F.concat(F.col("x.source_file_path"), F.lit(" "), F.col("x.function_name"), F.lit(" ["), F.array_join(F.transform("x.lines", lambda v: v.cast("string")), ", "), F.lit("]"))
    rows = tops.unionByName(heads).unionByName(ends).unionByName(each.select("_id", F.array(F.col("s"), F.col("c"), F.lit(0), F.lit(0)).alias("at"), place.alias("text")))
    if code is not None:
        sizes = F.transform("subclusters", lambda s: F.size(s["constructs"]))
        first = named.select("_id", F.posexplode(sizes).alias("s", "n"), sizes.alias("all"))
        first = first.select("_id", "s", F.aggregate(F.slice("all", F.lit(1), F.col("s")), F.lit(0), lambda a, b: a + b).alias("k"))
        shown = code.join(first, ["_id", "k"]).select("_id", F.array(F.col("s"), F.lit(0), F.lit(1), F.col("line").cast("int")).alias("at"), F.concat(F.lpad(string("line"), 6, " "), F.lit(" "), F.col("text")).alias("text"))
        rows = rows.unionByName(shown)
    return rows.withColumn("line", F.row_number().over(W.partitionBy("_id").orderBy("at", "text"))).select("_id", "line", "text")
