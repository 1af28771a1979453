"""Writers: partitioned feature and document tables, DOT texts, wide exports, and reports."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_features(features: DataFrame, path: str, partitions: tuple[str, ...] = ("dependency", "module", "granularity", "kind"), most_rows: int = 0) -> None:
    """Long-form features, partitioned by those of the columns that there are; rewrites the partitions it holds. A file has up
    to `most_rows` rows, and those beyond go to further files (0: no limit)."""
    features.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", most_rows).partitionBy(*(p for p in partitions if p in features.columns)).parquet(path)


def write_documents(docs: DataFrame, path: str) -> None:
    """Inconsistency documents; the flat columns that queries filter by are pushed to the scan."""
    docs.write.mode("overwrite").parquet(path)


def dot_texts(nodes: DataFrame, edges: DataFrame, by: str = "graph_id") -> DataFrame:
    """(by, text): a DOT text for each graph, blocks as clusters; edges keep color, lhead and ltail where there are such columns."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    lines = lambda x: F.array_join(F.array_sort(F.collect_list(x)), "\n")
    each = nodes.groupBy(by, "bb_id").agg(lines(F.concat(quote(F.col("node_id")), F.lit(" ["), F.concat_ws(" ", F.concat(F.lit("label="), quote(F.col("label")))), F.lit("];"))).alias("n"))
    block = F.col("bb_id").cast("string")
    inside = F.when(block.isNull(), F.col("n")).otherwise(F.concat(F.lit("subgraph cluster_bb_"), block, F.lit(" {\n"), F.col("n"), F.lit("\n} /* cluster_bb_"), block, F.lit(" */")))
    n = each.groupBy(by).agg(lines(inside).alias("n"))
    attributes = F.concat_ws(" ", *(F.concat(F.lit(f"{c}="), quote(F.col(c))) for c in ("color", "lhead", "ltail") if c in edges.columns))
    e = edges.groupBy(by).agg(lines(F.concat(quote(F.col("src")), F.lit(" -> "), quote(F.col("dst")), F.lit(" ["), attributes, F.lit("];"))).alias("e"))
    return n.join(e, by, "left").select(by, F.concat_ws("\n", F.lit("digraph {"), "n", "e", F.lit("}")).alias("text"))


def wide(features: DataFrame, names: list[str], id_: str = "location") -> DataFrame:
    """A column for each of the named features, 0 where absent: for small exports only."""
    return features.groupBy(id_).agg(*(F.coalesce(F.sum(F.when(F.col("feature") == n, F.col("value"))), F.lit(0)).alias(n) for n in names))


def cluster_report(clusters: DataFrame, id_: str = "location") -> DataFrame:
    """(cluster, n, text): a report's section for each cluster, from the largest down."""
    text = F.concat_ws("\n", F.concat(F.lit("Cluster #"), F.col("cluster").cast("string")), F.concat(F.lit("# Items "), F.col("n").cast("string")), F.array_join(F.array_sort("m"), "\n"))
    return clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.collect_list(F.col(id_).cast("string")).alias("m")).select("cluster", "n", text.alias("text")).orderBy(F.desc("n"), "cluster")


def nested_report(nested: DataFrame, lines: DataFrame, differing: DataFrame | None = None, id_: str = "construct_id") -> DataFrame:
    """(cluster, text): a section for each cluster of two or more sub-clusters: their members with their lines, and the
    features that differ. nested: (cluster, sub, id_); lines: (id_, lines); differing: (cluster, feature). Noise, whose
    cluster is null, is left out."""
    rule = lambda c, n: F.lit(" " + c * n)
    told = F.concat(F.lit("  "), F.col(id_).cast("string"), F.lit(" ["), F.array_join(F.transform("lines", lambda x: x.cast("string")), ", "), F.lit("]"))
    members = nested.where("cluster IS NOT NULL").join(lines.select(id_, "lines"), id_, "left").withColumn("lines", F.coalesce("lines", F.expr("cast(array() as array<int>)")))
    subs = members.groupBy("cluster", "sub").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(told)).alias("m"))
    one = F.concat_ws("\n", F.concat(F.lit(" Sub Cluster #"), F.col("sub").cast("string"), F.lit(" :")), rule("-", 50), F.concat(F.lit("  # Items: "), F.col("n").cast("string")), F.array_join("m", "\n"), rule("-", 50))
    sections = subs.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("sub", one.alias("text")))).alias("s")).where(F.size("s") > 1)
    body = F.array_join(F.transform("s", lambda x: x["text"]), "\n")
    if differing is not None:
        features = differing.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_set("feature")), "\n  ").alias("f"))
        sections = sections.join(features, "cluster", "left")
        body = F.concat_ws("\n", body, F.when(F.col("f").isNotNull(), F.concat_ws("\n", rule("+", 30), F.concat(F.lit("  "), F.col("f")))))
    head = F.concat(F.lit(" Cluster #"), F.col("cluster").cast("string"), F.lit(" :"))
    return sections.select("cluster", F.concat_ws("\n", head, rule("-", 50), body, rule("=", 100)).alias("text"))


def graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A syntax tree, nodes (id, type, spelling) and edges (src, dst), as GraphML files in a folder."""
    keys = nodes.sparkSession.createDataFrame([("type", "node", "type"), ("spelling", "node", "spelling")], "`_attr.name` string, `_for` string, `_id` string")
    entry = lambda c: F.struct(F.lit(c).alias("_key"), F.col(c).cast("string").alias("_VALUE"))
    data = F.filter(F.array(entry("type"), entry("spelling")), lambda d: d["_VALUE"].isNotNull())
    tables = {"key": keys, "node": nodes.select(F.col("id").cast("string").alias("_id"), data.alias("data")), "edge": edges.select(F.col("src").cast("string").alias("_source"), F.col("dst").cast("string").alias("_target"))}
    for tag, df in tables.items():
        df.write.mode("append").format("xml").option("rowTag", tag).option("rootTag", "graphml").save(path)


def tree_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A syntax tree as JSON lines: each node with the ids of its children in order."""
    below = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("children"))
    nodes.join(below, "id", "left").write.json(path)


def write_vectors(vectors: DataFrame, path: str, id_: str = "id") -> None:
    """(id_, vec) as lines of an id and its numbers, separated by spaces."""
    vectors.select(F.concat_ws(" ", F.col(id_).cast("string"), F.transform("vec", lambda x: x.cast("string"))).alias("value")).write.text(path)


def write_walks(walks: DataFrame, path: str) -> None:
    """Walks (path) as lines of vertices."""
    walks.select(F.array_join(F.transform("path", lambda x: x.cast("string")), " ").alias("value")).write.text(path)


def write_times(spark: SparkSession, times: list[tuple[str, str | None, float]], directory: str) -> None:
    """A file `<stage>[_<granularity>].time.txt` for each (stage, granularity, seconds) of a run, of which there are few."""
    jvm = spark.sparkContext._jvm
    for stage, granularity, seconds in times:
        where = jvm.org.apache.hadoop.fs.Path(f"{directory}/{stage}{'_' + granularity if granularity else ''}.time.txt")
        out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
        out.write(bytearray(f"{seconds}\n".encode()))
        out.close()


@contextmanager
def timed(times: list[tuple[str, float]], stage: str):
    """Append (stage, seconds) when the block ends."""
    began = time.perf_counter()
    yield
    times.append((stage, time.perf_counter() - began))
