"""Feature counts of constructs in long form: (construct_id, feature, value); an absent row counts 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import reach, wl_labels


def label_counts(nodes: DataFrame, by: str = "construct_id", label: str = "label") -> DataFrame:
    """NN: how often each node label stands in a construct."""
    return nodes.groupBy(by, F.col(label).alias("feature")).agg(F.count("*").alias("value"))


def size_features(nodes: DataFrame, edges: DataFrame, by: str = "construct_id") -> DataFrame:
    """Numbers of nodes and edges as two features."""
    n = nodes.groupBy(by).agg(F.count("*").alias("value")).withColumn("feature", F.lit("metadata_num_nodes"))
    m = edges.groupBy(by).agg(F.count("*").alias("value")).withColumn("feature", F.lit("metadata_num_edges"))
    return n.unionByName(m).select(by, "feature", "value")


def label_counts_with_sizes(nodes: DataFrame, edges: DataFrame, by: str = "construct_id") -> DataFrame:
    """NNMD: label counts and sizes."""
    return label_counts(nodes, by).unionByName(size_features(nodes, edges, by))


def binary(features: DataFrame) -> DataFrame:
    return features.withColumn("value", (F.col("value") > 0).cast("int"))


def mean_vectors(nodes: DataFrame, vectors: DataFrame, by: str = "construct_id") -> DataFrame:
    """SM: the mean of the vectors (node_id, vec) of a construct's nodes; nodes without a vector are left out."""
    each = nodes.join(vectors, "node_id").select(by, F.posexplode("vec").alias("dim", "x"))
    means = each.groupBy(by, "dim").agg(F.avg("x").alias("m"))
    return means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("vec"))


def label_vectors(nodes: DataFrame, vectors: DataFrame, by: str = "construct_id") -> DataFrame:
    """SM by label: features `label (dim)` with the mean, to two digits, of the vectors (node_id, vec) of a construct's nodes
    of a label, themselves taken to two digits. Halves go away from zero."""
    each = nodes.join(vectors, "node_id").select(by, "label", F.posexplode("vec").alias("dim", "x"))
    feature = F.concat("label", F.lit(" ("), F.col("dim").cast("string"), F.lit(")")).alias("feature")
    sums = each.groupBy(by, feature).agg(F.sum(F.round(F.col("x") * 100).cast("long")).alias("s"), F.count("x").alias("n")).where("n > 0")
    mean = F.signum("s") * F.floor((2 * F.abs("s") + F.col("n")) / (2 * F.col("n"))) / 100
    return sums.select(by, "feature", mean.alias("value"))


def similar_labels(nodes: DataFrame, vectors: DataFrame, most: int = 5, by: str = "construct_id") -> DataFrame:
    """SM by neighbours: how often each label is among the `most` nodes of a construct most like one of its nodes by the
    cosine of their vectors, ties to the smaller node_id. Constructs are gated in size."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    unit = nodes.join(vectors, "node_id").withColumn("vec", F.col("vec").cast("array<double>")).withColumn("norm", norm)
    unit = unit.select(by, "node_id", "label", F.transform("vec", lambda x: F.coalesce(F.try_divide(x, F.col("norm")), F.lit(0.0))).alias("u"))
    pairs = unit.select(by, F.col("node_id").alias("of"), F.col("u").alias("x")).join(unit.withColumnRenamed("u", "y"), by).where("of <> node_id")
    sim = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    near = pairs.groupBy(by, "of").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.round(sim, 9)).alias("s"), "node_id", "label"))), 1, most).alias("near"))
    return near.select(by, F.explode("near").alias("n")).groupBy(by, F.col("n.label").alias("feature")).agg(F.count("*").alias("value"))


def wl_features(nodes: DataFrame, edges: DataFrame, rounds: int = 5, by: str = "construct_id") -> DataFrame:
    """Weisfeiler-Lehman words of all rounds, counted: the words a whole-graph embedding learns from."""
    words = wl_labels(nodes, edges, rounds, (by,))
    return words.groupBy(by, F.col("label").alias("feature")).agg(F.count("*").alias("value"))


def hashed_embedding(features: DataFrame, dims: int = 1024, by: str = "construct_id") -> DataFrame:
    """G2v by default: log-damped counts weighted by inverse construct frequency, summed into `dims` signed hash
    buckets and scaled to length 1. Deterministic: equal constructs get equal vectors."""
    n = features.select(F.count_distinct(by).alias("n"))
    frequency = features.groupBy("feature").agg(F.count_distinct(by).alias("df"))
    weighted = features.join(frequency, "feature").crossJoin(F.broadcast(n))  # n is one row
    h = F.xxhash64("feature")
    x = (1 + F.log(F.col("value").cast("double"))) * (1 + F.log((1 + F.col("n")) / (1 + F.col("df")))) * F.when(F.shiftrightunsigned(h, 63) == 1, -1.0).otherwise(1.0)
    sums = weighted.select(by, F.pmod(h, F.lit(dims)).cast("int").alias("dim"), x.alias("x")).groupBy(by, "dim").agg(F.sum("x").alias("x"))
    sparse = sums.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("dim", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    at = lambda d: F.coalesce(F.try_element_at(F.col("m"), d), F.lit(0.0)) / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)
    return sparse.select(by, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: at(d)).alias("vec"))


def document_vectors(words: DataFrame, dims: int = 64, epochs: int = 20, rate: float = 0.1, negatives: int = 5, seed: int = 1, by: str = "construct_id", block: str | None = None) -> DataFrame:
    """PV-DBOW vectors learnt from (by, feature, value): opt-in, one model for each value of `block` (a column), which must be
    of a size that a task can train; results depend on the seed alone."""
    import numpy as np
    import pandas as pd

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([by, "feature"])
        docs, d = np.unique(pdf[by].to_numpy(), return_inverse=True)
        vocabulary, w = np.unique(pdf["feature"].to_numpy(), return_inverse=True)
        rng = np.random.default_rng(seed)
        x = (rng.random((len(docs), dims)) - 0.5) / dims
        y = np.zeros((len(vocabulary), dims))
        pairs = np.repeat(np.stack([d, w], 1), pdf["value"].to_numpy().astype(int), axis=0)
        noise = np.bincount(pairs[:, 1], minlength=len(vocabulary)) ** 0.75
        noise /= noise.sum()
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            for part in np.array_split(pairs[rng.permutation(len(pairs))], max(1, len(pairs) // 256)):
                targets = np.concatenate([part[:, 1:], rng.choice(len(vocabulary), (len(part), negatives), p=noise)], axis=1)
                u, v = x[part[:, 0]], y[targets]
                g = np.concatenate([np.ones((len(part), 1)), np.zeros((len(part), negatives))], 1) - 1 / (1 + np.exp(-np.einsum("nd,nkd->nk", u, v)))
                np.add.at(x, part[:, 0], step * np.einsum("nk,nkd->nd", g, v))
                np.add.at(y, targets, step * g[:, :, None] * u[:, None, :])
        return pd.DataFrame({by: docs, "vec": list(x)})

    kind = dict(words.dtypes)[by]
    rows = words if block else words.withColumn("_block", F.lit(0))
    return rows.groupBy(block or "_block").applyInPandas(train, f"{by} {kind}, vec array<double>")


def label_embeddings(sentences: DataFrame, dims: int = 64, window: int = 10, least: int = 1, seed: int = 1) -> DataFrame:
    """(label, vec) by skip-gram over sentences of relabelled nodes (sentence), words separated by spaces. The library's
    trainer takes a hierarchical softmax where sampled contrasts would do; it trains partitions side by side."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    words = sentences.where("sentence IS NOT NULL").select(F.split("sentence", " ").alias("words"))
    model = Word2Vec(vectorSize=dims, windowSize=window, minCount=least, seed=seed, maxIter=1, inputCol="words", outputCol="v").fit(words)
    return model.getVectors().select(F.col("word").alias("label"), vector_to_array("vector").alias("vec"))


def function_members(ast_nodes: DataFrame, edges: DataFrame, entry: str = "FUNCTION_DECL") -> DataFrame:
    """(function, id): the nodes below each node of the type `entry`, itself included, by the ids of an AST's nodes (id, type,
    …) and edges (src, dst). A function within another has members of its own, and is one of the other's."""
    roots = ast_nodes.where(F.col("type") == entry).select(F.lit(0).alias("graph_id"), F.col("id").alias("root"))
    found = reach(roots, edges.select(F.lit(0).alias("graph_id"), "src", "dst"))
    return found.select(F.col("root").alias("function"), F.col("node_id").alias("id"))


def ast_features(ast_nodes: DataFrame, members: DataFrame, kinds: tuple[str, ...] = ("NT",)) -> DataFrame:
    """Counts for each function of AST node types (NT), called names (C) and member names (MR); kinds may be combined.

    members: (function, id), the nodes below each function.
    """
    rows = members.join(ast_nodes, "id")
    parts = {
        "NT": rows.select("function", F.col("type").alias("feature")),
        "C": rows.where("type = 'CALL_EXPR' AND spelling <> ''").select("function", F.concat(F.lit("call:"), "spelling").alias("feature")),
        "MR": rows.where("type IN ('MEMBER_REF_EXPR', 'MEMBER_REF') AND spelling <> ''").select("function", F.concat(F.lit("member:"), "spelling").alias("feature")),
    }
    if unknown := set(kinds) - set(parts):
        raise ValueError(f"unknown kinds {sorted(unknown)}")
    out = parts[kinds[0]]
    for k in kinds[1:]:
        out = out.unionByName(parts[k])
    return out.groupBy("function", "feature").agg(F.count("*").alias("value"))


#: Feature kinds by name, from (nodes, edges).
REGISTRY: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "NN": lambda nodes, edges: label_counts(nodes),
    "NNMD": label_counts_with_sizes,
    "G2v": lambda nodes, edges: wl_features(nodes, edges),
}


def extract(kind: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The features of a registered kind."""
    if kind not in REGISTRY:
        raise ValueError(f"unknown feature kind {kind}")
    return REGISTRY[kind](nodes, edges)
