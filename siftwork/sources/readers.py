"""Readers: files, compile databases, function lists, graphs, feature tables, syntax trees, sources, times."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import NUMBER, join_path, parent, words
from ..plans.tables import materialise


def files(spark: SparkSession, directory: str, suffix: str = "", prefix: str = "", within: Sequence[str] = ()) -> DataFrame:
    """(path) of files below a directory by name; with `within`, only paths that hold one of the strings."""
    out = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory).select("path")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    out = out.where(name.endswith(suffix) & name.startswith(prefix))
    if within:
        out = out.where(F.exists(F.array(*map(F.lit, within)), lambda s: F.col("path").contains(s)))
    return out


def entries(spark: SparkSession, directory: str, suffix: str = "") -> DataFrame:
    """(name), each once: what stands directly in a directory by such a name. A table may be a file or a folder of parts."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    top = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/") + "/"
    name = F.substring_index(F.substr("path", F.lit(len(top) + 1)), "/", 1)
    return files(spark, directory).select(name.alias("name")).where(F.endswith("name", F.lit(suffix))).distinct()


def projects(names: DataFrame, wanted: Sequence[str] = ()) -> DataFrame:
    """Visible projects (project); all of them if none is named."""
    out = names.where(~F.col("project").startswith("."))
    return out.where(F.col("project").isin(*wanted)) if wanted else out


COMPILE_DB = "array<struct<file:string,directory:string,arguments:array<string>,command:string>>"


def compile_db(spark: SparkSession, path: str) -> DataFrame:
    """(ord, file, directory, arguments, command) of a JSON array of entries."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", COMPILE_DB).alias("e"))
    return raw.select(F.posexplode("e").alias("ord", "x")).select("ord", "x.*")


def _without_first(args: Column, *words_: str) -> Column:
    """The array without the first occurrence of each word."""
    for w in words_:
        at = F.array_position(args, w)
        args = F.when(at > 0, F.concat(F.slice(args, F.lit(1), (at - 1).cast("int")), F.slice(args, (at + 1).cast("int"), F.greatest(F.size(args), F.lit(1))))).otherwise(args)
    return args


def c_files(db: DataFrame) -> DataFrame:
    """(path, args) of the .c files of a compile database; an entry stands over earlier ones of its file.

    Without `arguments` the command's words stand, but for objects and sources. Relative include paths and lone dots are put behind the directory.
    """
    path = join_path(F.col("directory"), F.col("file"))
    spoken = F.filter(words(F.coalesce("command", F.lit(""))), lambda w: ~w.endswith(".o") & ~w.endswith(".c"))
    args = _without_first(F.coalesce("arguments", spoken), "-c", "cc", "-o", "-g")
    fixed = F.transform(args, lambda a: F.when(a.startswith("-I."), F.concat(F.lit("-I"), join_path(F.col("directory"), F.substring(a, 3, 1 << 20)))).when(a.isin(".", ".."), join_path(F.col("directory"), a)).otherwise(a))
    rows = db.where(F.col("file").isNotNull()).select("ord", path.alias("path"), fixed.alias("args")).where(F.col("path").endswith(".c"))
    return rows.groupBy("path").agg(F.max_by("args", "ord").alias("args"))


def arguments_of(paths: DataFrame, db: DataFrame) -> DataFrame:
    """paths (path) with the arguments of their first entry, null without one; `-I..` steps up from the directory."""
    first = db.where("file IS NOT NULL").select("ord", "directory", "arguments", join_path(F.col("directory"), F.col("file")).alias("path")).groupBy("path").agg(F.min_by(F.struct("directory", "arguments"), "ord").alias("e"))
    ups = lambda a: F.size(F.split(a, r"\.\.")) - 1

    def climb(a: Column) -> Column:
        pieces = F.split(F.col("e.directory"), "/")
        top = F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - ups(a), F.lit(0))), "/")
        return F.concat(F.lit("-I"), join_path(top, F.regexp_replace(F.substring(a, 3, 1 << 20), r"^(\.\./?)+", "")))

    args = F.transform(_without_first(F.col("e.arguments"), "-c", "cc", "-o"), lambda a: F.when(a.startswith("-I.."), climb(a)).otherwise(a))
    return paths.join(first, "path", "left").select(*paths.columns, args.alias("args"))


def missing_sources(db: DataFrame, sources: DataFrame) -> DataFrame:
    """(path) of entries that are not among sources (path)."""
    return db.where("file IS NOT NULL").select(join_path(F.col("directory"), F.col("file")).alias("path")).distinct().join(sources, "path", "left_anti")


def functions_list(lines: DataFrame) -> DataFrame:
    """(file, function, inlinehint) from lines (file, value) such as `define … @name(…) … :… inlinehint`."""
    name = F.regexp_extract("value", r"@([^(]*)\(", 1)
    return lines.where(F.col("value").contains("@")).select("file", name.alias("function"), F.get(F.split("value", ":"), F.lit(1)).contains(" inlinehint ").alias("inlinehint")).fillna(False, ["inlinehint"])


def defined_functions(lines: DataFrame) -> DataFrame:
    """(file, line, value): `define` lines with the line before them, from (file, line, value)."""
    before = F.lag("value").over(W.partitionBy("file").orderBy("line"))
    return lines.withColumn("_before", before).where(F.col("value").startswith("define")).select("file", "line", F.concat_ws(" : ", "value", "_before").alias("value"))


def _dot_rows(graph_id: str, text: str) -> tuple[list, list]:
    """Node and edge rows of a DOT graph: statements one a line, clusters as basic blocks, `/* -- node` ending the blocks."""
    import re

    attribute = re.compile(r'(\w+)\s*=\s*(?:"((?:[^"\\]|\\.)*)"|([^,\]\s]+))')
    name = r'("(?:[^"\\]|\\.)*"|[\w.:\\-]+?)'
    edge = re.compile(rf"^\s*{name}\s*->\s*{name}\s*(?:\[(.*)\])?\s*;?\s*$")
    node = re.compile(rf"^\s*{name}\s*\[(.*)\]\s*;?\s*$")
    bare = lambda s: s[1:-1] if s.startswith('"') else s
    known, nodes, edges, keys, block, closed = {}, [], [], {}, None, False
    for line in text.splitlines():
        stripped = line.strip()
        if m := re.match(r"subgraph\s+\"?(cluster_bb_([^\s\"{]+))", stripped):
            block = None if closed else m[2]
            continue
        if block is not None and (stripped.startswith("} /* cluster_bb_" + block) or stripped == "}"):
            block = None
            continue
        if stripped.startswith("/* -- node") and known and any(n[4] for n in nodes):
            closed = True
            continue
        if m := edge.match(stripped):
            a = {k: (x or y) for k, x, y in attribute.findall(m[3] or "")}
            s, d = bare(m[1]), bare(m[2])
            key = keys[s, d] = keys.get((s, d), -1) + 1
            edges.append((graph_id, s, d, key, a.get("color"), a.get("lhead"), a.get("ltail")))
        elif (m := node.match(stripped)) and bare(m[1]) not in ("graph", "node", "edge"):
            a = {k: (x or y) for k, x, y in attribute.findall(m[2])}
            n = bare(m[1])
            if n not in known:
                known[n] = len(nodes)
                nodes.append([graph_id, n, a.get("label"), a.get("labelURL") or a.get("URL"), block, len(nodes)])
            else:
                row = nodes[known[n]]
                row[2], row[3], row[4] = row[2] or a.get("label"), row[3] or a.get("labelURL"), row[4] or block
    return nodes, edges


DOT_NODES = "graph_id string, node_id string, label string, url string, bb_id string, ord int"
DOT_EDGES = "graph_id string, src string, dst string, key int, color string, lhead string, ltail string"


def dot_graphs(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of DOT graphs (graph_id, text), parsed once and written to the shared folder."""
    node_names, edge_names = ([c.split()[0] for c in columns.split(", ")] for columns in (DOT_NODES, DOT_EDGES))
    every = {c.split()[0]: c for columns in (DOT_NODES, DOT_EDGES) for c in columns.split(", ")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parsed = [_dot_rows(i, t or "") for i, t in zip(pdf["graph_id"], pdf["text"], strict=True)]
            nodes = pd.DataFrame([r for n, _ in parsed for r in n], columns=node_names).assign(is_node=True)
            edges = pd.DataFrame([r for _, e in parsed for r in e], columns=edge_names).assign(is_node=False)
            rows = pd.concat([nodes, edges]).reindex(columns=[*every, "is_node"])
            for c in ("ord", "key"):
                rows[c] = rows[c].astype("Int32")
            yield rows

    rows = materialise(texts.select("graph_id", "text").mapInPandas(run, ", ".join([*every.values(), "is_node boolean"])), "dot")
    return rows.where("is_node").select(*node_names), rows.where("NOT is_node").select(*edge_names)


def dot_files(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    raw = spark.read.text(directory, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.dot")
    return dot_graphs(raw.select(F.input_file_name().alias("graph_id"), F.col("value").alias("text")))


def feature_csv(spark: SparkSession, path: str, id_: str = "location") -> DataFrame:
    """A wide feature table (a column a feature) in long form; empty cells count 0 and are left out."""
    wide = spark.read.option("header", True).csv(path)
    names = [c for c in wide.columns if c != id_]
    quoted = [F.col(f"`{c.replace('`', '``')}`").cast("double").alias(str(i)) for i, c in enumerate(names)]
    entries = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(str(i)).alias("value")) for i, c in enumerate(names)))
    return wide.select(F.col(id_), *quoted).select(id_, F.explode(entries).alias("e")).select(id_, "e.feature", "e.value").where("value IS NOT NULL AND value <> 0")


def header(spark: SparkSession, path: str) -> list[str]:
    """The column names of a CSV file."""
    return spark.read.option("header", True).csv(path).columns


def locations(features: DataFrame, id_: str = "location") -> DataFrame:
    return features.select(id_).distinct()


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """AST nodes (id, type, spelling) and edges (src, dst) of a GraphML file."""
    schema = "_id string, data array<struct<_key:string,_VALUE:string>>"
    nodes = spark.read.format("xml").option("rowTag", "node").schema(schema).load(path)
    keys = spark.read.format("xml").option("rowTag", "key").schema("_id string, `_attr.name` string, _for string").load(path)
    names = {r["_id"]: r["_attr.name"] for r in keys.where("_for = 'node'").collect()}  # a file's few attribute names
    value = lambda n: F.get(F.transform(F.filter("data", lambda d: d["_key"].isin(*([k for k, v in names.items() if v == n] or [n]))), lambda d: d["_VALUE"]), F.lit(0))
    edges = spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string").load(path)
    return nodes.select(F.col("_id").alias("id"), value("type").alias("type"), value("spelling").alias("spelling")), edges.select(F.col("_source").alias("src"), F.col("_target").alias("dst"))


def edge_list(lines: DataFrame, undirected: bool = True, adjacency: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst) and vertices (v) of text lines (value): two integers, or with `adjacency` a vertex and its neighbours.
    `#` starts a comment; a line of one integer is a vertex."""
    parts = words(F.regexp_replace("value", "#.*", ""))
    rows = lines.select(F.transform(parts, lambda x: x.cast("bigint")).alias("p")).where(F.size("p") > 0)
    last = F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))) if adjacency else F.slice("p", F.lit(2), F.least(F.size("p") - 1, F.lit(1)))
    edges = rows.select(F.get("p", F.lit(0)).alias("src"), F.explode(last).alias("dst"))
    vertices = rows.select(F.explode(F.when(F.lit(adjacency), F.col("p")).otherwise(F.slice("p", 1, 2))).alias("v")).distinct()
    if undirected:
        edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.distinct(), vertices


def matrix_edges(lines: DataFrame) -> DataFrame:
    """Edges (src, dst) of the lines (ord, value) of a square matrix: where row `ord`, from 0, has another number than 0."""
    cells = lines.select("ord", F.posexplode(words(F.col("value"))).alias("dst", "x"))
    return cells.where(F.col("x").cast("double") != 0).select(F.col("ord").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


def map_edges(texts: DataFrame) -> DataFrame:
    """Edges (src, dst) of JSON objects (value) that give each vertex a list of its neighbours."""
    pairs = texts.select(F.explode(F.from_json("value", "map<string,array<bigint>>")).alias("src", "to"))
    return pairs.select(F.col("src").cast("long").alias("src"), F.explode("to").alias("dst")).distinct()


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, vec) of lines of an id and its numbers."""
    parts = words(F.col("value"))
    return spark.read.text(path).select(F.get(parts, F.lit(0)).alias("id"), F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda x: x.cast("double")).alias("vec"))


def walks(spark: SparkSession, path: str) -> DataFrame:
    """(path) of lines of vertices."""
    return spark.read.text(path).select(words(F.col("value")).alias("path"))


def source_lines(texts: DataFrame) -> DataFrame:
    """(file, line, text) with lines numbered from 1, from (file, text)."""
    return texts.select("file", F.posexplode(F.split("text", "\n")).alias("k", "text")).select("file", (F.col("k") + 1).alias("line"), "text")


def cluster_report(lines: DataFrame) -> DataFrame:
    """(cluster, location) of the lines (ord, value) of a report, or of several with a column file: `Cluster #k`, `# Items n`,
    `=…`, and members."""
    head = F.when(F.col("value").startswith("Cluster"), F.regexp_replace(F.get(words(F.col("value")), F.lit(1)), "#", ""))
    named = lines.withColumn("cluster", F.last(head, True).over(W.partitionBy("file" if "file" in lines.columns else F.lit(0)).orderBy("ord")))
    return named.where("cluster IS NOT NULL").where(~F.col("value").rlike("^(Cluster|# Items|=)") & (F.trim("value") != "")).select("cluster", F.col("value").alias("location"))


def stage_seconds(spark: SparkSession, directory: str, suffix: str = ".time.txt") -> DataFrame:
    """(stage, granularity, seconds) of files `<stage>[_<granularity>].time.txt` that hold one number."""
    raw = spark.read.text(directory, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{suffix}")
    stem = F.regexp_extract(F.input_file_name(), rf"([^/]*){suffix.replace('.', chr(92) + '.')}$", 1)
    return raw.select(F.regexp_extract(stem, r"^([^_]*)", 1).alias("stage"), F.nullif(F.regexp_extract(stem, r"_(.*)$", 1), F.lit("")).alias("granularity"), F.trim("value").alias("v")).where(F.col("v").rlike(NUMBER)).select("stage", "granularity", F.col("v").cast("double").alias("seconds"))


def json_config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file; nothing in it is ever evaluated."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def include_dirs(dependencies: DataFrame) -> DataFrame:
    """(dir): directories of header paths in dependency texts (value), with all their parents."""
    path = dependencies.select(F.explode(words(F.regexp_replace("value", r"[\\:]", " "))).alias("p")).where(F.col("p").endswith(".h"))
    pieces = F.split(parent(F.col("p")), "/")
    return path.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda k: F.array_join(F.slice(pieces, F.lit(1), k), "/"))).alias("dir")).where("dir <> ''").distinct()


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Stored inconsistency documents."""
    return spark.read.parquet(path)
