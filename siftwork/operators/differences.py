"""What tells the sub-clusters of a cluster apart, ranks, and inconsistency documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import basename, parent, sequence_ratio


def differing(members: DataFrame, features: DataFrame, id_: str = "construct_id") -> DataFrame:
    """(cluster, feature): features that do not have one value over all members of the cluster, an absent one counting 0."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"))
    values = members.join(features, id_).groupBy("cluster", "feature").agg(F.sum((F.col("value") != 0).cast("long")).alias("k"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return values.join(sizes, "cluster").where("(k > 0 AND k < n) OR lo <> hi").select("cluster", "feature")


def majority_rank(nested: DataFrame) -> DataFrame:
    """(cluster, n_subs, score): the largest minus the smallest sub-cluster, from the highest score down."""
    sizes = nested.groupBy("cluster", "sub").agg(F.count("*").alias("n"))
    return sizes.groupBy("cluster").agg(F.count("*").alias("n_subs"), (F.max("n") - F.min("n")).alias("score")).orderBy(F.desc("score"), "cluster")


def composite_rank(nested: DataFrame, id_: str = "construct_id") -> DataFrame:
    """(cluster, score): 1 minus the mean of the members' pairwise mismatches of blocks (if any has some), function and file, the
    pairwise similarity of variable names, the spread of sub-cluster sizes, and 1 - k/k_max of the number of subs.

    nested: (cluster, sub, id_, file, function, variable, bbs), gated in size. Clusters of one member have no pairs and no score.
    """
    a = nested.select("cluster", *(F.col(c).alias(f"a_{c}") for c in (id_, "file", "function", "variable", "bbs")))
    b = nested.select("cluster", *(F.col(c).alias(f"b_{c}") for c in (id_, "file", "function", "variable", "bbs")))
    pairs = a.join(b, "cluster").where(F.col(f"a_{id_}") < F.col(f"b_{id_}"))
    differ = lambda c: F.avg((~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).cast("double"))
    has = lambda p: F.size(F.coalesce(f"{p}_bbs", F.expr("array()"))) > 0
    blocks = F.avg(F.when(has("a") & has("b"), (F.col("a_bbs") != F.col("b_bbs")).cast("double")))
    pairs = pairs.withColumn("r", sequence_ratio("a_variable", "b_variable"))
    scores = pairs.groupBy("cluster").agg(blocks.alias("m0"), F.avg("r").alias("m1"), differ("function").alias("m2"), differ("file").alias("m3"))
    sizes = nested.groupBy("cluster", "sub").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.count("*").alias("k"), ((F.max("n") - F.min("n")) / F.sum("n")).alias("m4"))
    most = sizes.agg(F.max("k").alias("most"))
    full = scores.join(sizes, "cluster").join(F.broadcast(most))  # `most` is one row
    parts = F.array_compact(F.array("m0", "m1", "m2", "m3", "m4", 1 - F.col("k") / F.col("most")))
    return full.select("cluster", (1 - F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(parts)).alias("score"))


def construct_lines(nodes: DataFrame, by: str = "construct_id") -> DataFrame:
    """(by, lines): the sorted distinct lines of a construct."""
    return nodes.groupBy(by).agg(F.array_sort(F.collect_set(F.col("line").cast("int"))).alias("lines"))


def label_lines(nodes: DataFrame, by: str = "construct_id") -> DataFrame:
    """(by, label, lines): where each label stands, as strings in order; none where no line is known."""
    return nodes.groupBy(by, "label").agg(F.transform(F.array_sort(F.collect_list(F.col("line").cast("int"))), lambda x: x.cast("string")).alias("lines"))


def parse_location(paths: DataFrame, path: str = "location") -> DataFrame:
    """The parts of a construct's path: file, dependency, function, kind, variable, all its block ids and granularity."""
    name = basename(F.col(path))
    left, right = F.get(F.split(name, r"\.pdg_"), F.lit(0)), F.get(F.split(name, r"\.pdg_"), F.lit(1))
    stem = F.regexp_replace(right, r"\.afs(\.bb\d+)?\.dot$", "")
    pieces = F.split(stem, "_0x")
    return paths.select(
        "*",
        parent(parent(F.col(path))).alias("file"),
        F.substring(left, 1, 5).alias("dependency"),
        F.substring(left, 6, 1 << 20).alias("function"),
        F.substring(F.get(pieces, F.lit(0)), 1, 3).alias("kind"),
        F.substring(F.get(pieces, F.lit(0)), 5, 1 << 20).alias("variable"),
        F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x: F.concat(F.lit("0x"), x)).alias("bbs"),
        F.regexp_extract(right, r"\.(afs(?:\.bb\d+)?)\.dot$", 1).alias("granularity"),
    )


def assemble(nested: DataFrame, constructs: DataFrame, features: DataFrame, lines: DataFrame, settings: dict[str, str | float], id_: str = "construct_id") -> DataFrame:
    """Inconsistency documents: one a cluster of two or more sub-clusters, ranked by majority.

    constructs: (id_, graph_path, source_file_path, function_name, bbs, variable_name, lines); lines: (id_, label, lines).
    Every construct lists every differing feature of its cluster, with value 0 where it lacks it. `.` in feature names
    is stored as `;`.
    """
    rank = majority_rank(nested).where("n_subs >= 2")
    kept = nested.join(rank.select("cluster"), "cluster", "left_semi")
    wanted = kept.select("cluster", id_).join(differing(kept.select("cluster", id_), features, id_), "cluster")
    filled = wanted.join(features, [id_, "feature"], "left").join(lines.select(id_, F.col("label").alias("feature"), F.col("lines").alias("at")), [id_, "feature"], "left")
    diff = F.struct(F.regexp_replace("feature", r"\.", ";").alias("node_name"), F.coalesce(F.col("value").cast("int"), F.lit(0)).alias("node_value"), F.coalesce("at", F.expr("cast(array() as array<string>)")).alias("lines"))
    diffs = filled.groupBy(id_).agg(F.array_sort(F.collect_list(diff)).alias("node_diffs"))
    none = F.expr("cast(array() as array<struct<node_name:string,node_value:int,lines:array<string>>>)")
    each = kept.join(constructs, id_).join(diffs, id_, "left").withColumn("node_diffs", F.coalesce("node_diffs", none))
    construct = F.struct(F.col("graph_path"), "source_file_path", "lines", "function_name", "bbs", "variable_name", "node_diffs")
    subs = each.groupBy("cluster", "sub").agg(F.array_sort(F.collect_list(construct)).alias("constructs"))
    sub = F.struct(F.col("number").alias("sub_cluster_number"), F.size("constructs").alias("constructs_total"), "constructs")
    numbered = subs.withColumn("number", F.row_number().over(W.partitionBy("cluster").orderBy("sub")))
    docs = numbered.groupBy("cluster").agg(F.array_sort(F.collect_list(sub)).alias("subclusters"))
    out = docs.join(rank, "cluster")
    return out.select("cluster", "score", *(F.lit(v).alias(k) for k, v in settings.items()), "subclusters")
