"""Numeric summaries: sizes, times, similarities of known slices, clusters of known functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def size_distribution(sizes: DataFrame, by: list[str], n: str = "n_nodes") -> DataFrame:
    """(by…, n, least, q1, median, q3, most, mean) of construct sizes; linear interpolation between ranks."""
    q = lambda p: F.percentile(n, F.lit(p))
    return sizes.groupBy(*by).agg(F.count(n).alias("n"), F.min(n).alias("least"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max(n).alias("most"), F.avg(n).alias("mean"))


def stage_times(times: DataFrame) -> DataFrame:
    """(metric, minutes, hours): seconds summed by stage (and granularity where there is one), and their total."""
    metric = F.concat_ws("_", "stage", "granularity")
    each = times.groupBy(metric.alias("metric")).agg(F.sum("seconds").alias("s"))
    total = times.agg(F.sum("seconds").alias("s")).select(F.lit("total").alias("metric"), "s")
    return each.unionByName(total).select("metric", F.round(F.col("s") / 60, 4).alias("minutes"), F.round(F.col("s") / 3600, 6).alias("hours"))


def slice_similarities(features: DataFrame, slices: DataFrame, id_: str = "construct_id", digits: int = 5) -> DataFrame:
    """(group, a, b, sim), a < b: cosines of known slices (group, id_) of one group, 0 where nothing is shared or a
    slice has no features but zeros."""
    known = features.where("value <> 0").join(slices, id_)
    norms = known.groupBy("group", id_).agg(F.sqrt(F.sum(F.col("value") * F.col("value").cast("double"))).alias("norm"))
    x = known.join(norms, ["group", id_]).select("group", "feature", F.col(id_).alias("a"), (F.col("value") / F.col("norm")).alias("x"))
    dots = x.join(x.withColumnsRenamed({"a": "b", "x": "y"}), ["group", "feature"]).where("a < b").groupBy("group", "a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("sim"))
    every = slices.select("group", F.col(id_).alias("a")).join(slices.select("group", F.col(id_).alias("b")), "group").where("a < b").distinct()
    return every.join(dots, ["group", "a", "b"], "left").select("group", "a", "b", F.round(F.coalesce("sim", F.lit(0.0)), digits).alias("sim"))


def biggest_clusters(clusters: DataFrame, n: int = 5) -> DataFrame:
    """(cluster, n), the biggest clusters, ties to the smaller label."""
    return clusters.groupBy("cluster").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster").limit(n)


def clusters_of_functions(clusters: DataFrame, functions: DataFrame, id_: str = "location", most: int = 100) -> DataFrame:
    """(function, cluster, n, members): the clusters with a member that ends in a known function's name; members only of clusters up
    to `most`. functions: (function), a short list."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    # a suffix of each known length is looked up, so that the join is on equal keys
    lengths = functions.select(F.length("function").alias("k")).distinct()
    tails = clusters.join(F.broadcast(lengths), F.length(id_) >= F.col("k")).select("cluster", F.expr(f"substring({id_}, -k, k)").alias("function"))
    hits = tails.join(functions, "function")
    found = hits.select("function", "cluster").distinct().join(sizes, "cluster")
    # members are put together of the clusters that show them only, which are small
    shown = clusters.join(found.where(F.col("n") <= most).select("cluster").distinct(), "cluster").groupBy("cluster").agg(F.array_sort(F.collect_list(id_)).alias("members"))
    return found.join(shown, "cluster", "left").select("function", "cluster", "n", "members")
