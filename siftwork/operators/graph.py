"""Dependence graphs as tables: slicing, chunking, relabelling and kernels.

nodes(graph_id, node_id, label, url, bb_id, ord) and edges(graph_id, src, dst, key, color, lhead, ltail); the red edges
carry data, blue and green ones control. All operators work on every graph of the table at once. Iterations join a
frontier with the edges and write each round to the shared folder, so plans stay short and lost executors cost one round.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import abstract_label, is_number, line_of_url, words
from ..plans.tables import materialise, table_path
from .similarity import TILE, count_products, grow, ordered, pairs_of_blocks, shrink

#: Steps of a round of reachability.
HOPS = 4


def block_ends(nodes: DataFrame) -> DataFrame:
    """(graph_id, bb_id, first_node, last_node) by `ord`; nodes without a block have none."""
    return nodes.where("bb_id IS NOT NULL").groupBy("graph_id", "bb_id").agg(F.min_by("node_id", "ord").alias("first_node"), F.max_by("node_id", "ord").alias("last_node"))


def eliminate_edges(edges: DataFrame) -> DataFrame:
    """Edges but loops and those between two nodes whose first parallel edge (key 0) is a control edge."""
    control = edges.where((F.col("key") == 0) & F.col("color").isin("blue", "green")).select("graph_id", "src", "dst").distinct()
    return edges.where("src <> dst").join(control, ["graph_id", "src", "dst"], "left_anti")


def lift_control_flow(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Control edges between blocks (blue, with lhead and ltail) as edges from the last node of the one to the first of the other."""
    ends = block_ends(nodes)
    between = edges.where("color = 'blue' AND lhead IS NOT NULL AND ltail IS NOT NULL").select("graph_id", "lhead", "ltail").distinct()
    tail = ends.select("graph_id", F.col("bb_id").alias("ltail"), F.col("last_node").alias("src"))
    head = ends.select("graph_id", F.col("bb_id").alias("lhead"), F.col("first_node").alias("dst"))
    return between.join(tail, ["graph_id", "ltail"]).join(head, ["graph_id", "lhead"]).select("graph_id", "src", "dst")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, kind, name) of the nodes that slices start from: arguments, local and global variables with a
    successor. A name that is also an argument's counts as one, and a local before a global."""
    label = F.trim("label")
    parts = F.split(label, "=")
    head, second = F.trim(F.get(parts, F.lit(0))), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    is_arg, is_glob = head.startswith("[f] IN ARG"), head.startswith("[f] GLOB IN")
    alloca = (F.size(parts) > 1) & second.startswith("alloca")
    open_ = nodes.where(F.col("label").isNotNull()).join(edges.select("graph_id", F.col("src").alias("node_id")).distinct(), ["graph_id", "node_id"], "left_semi")
    wanted = (is_arg | ((F.size(parts) > 1) & (alloca | is_glob))) & ~(label.startswith("GLOB") | label.startswith("br") | label.startswith("ret"))
    tail = lambda c, n: F.substring(F.element_at(words(c), n), 2, 1 << 30)
    found = open_.where(wanted).select("graph_id", "node_id", F.when(is_arg, "ARG").when(is_glob, "GLB").otherwise("LCL").alias("origin"), F.when(is_arg, tail(label, -1)).when(is_glob, tail(head, -1)).otherwise(tail(label, 1)).alias("raw"), label.endswith(".coerce").alias("coerce"))
    coerced = (F.col("origin") == "ARG") & F.col("coerce")
    name = F.when(coerced, F.get(F.split("raw", r"\."), F.lit(0))).otherwise(F.col("raw"))
    found = found.withColumn("name", name).where(~((F.col("origin") == "LCL") & F.col("raw").rlike("^[0-9]+$")))
    by_name = found.groupBy("graph_id", "name").agg(F.max(F.col("origin") == "ARG").alias("a"), F.max(F.col("origin") == "LCL").alias("l"))
    kept = found.where(~coerced & (F.col("name") != "") & ((F.col("origin") == "LCL") | ~is_number(F.col("name"))))
    return kept.join(by_name, ["graph_id", "name"]).select("graph_id", "node_id", F.when(F.col("a"), "ARG").when(F.col("l"), "LCL").otherwise("GLB").alias("kind"), "name")


def reach(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, root, node_id) of all that each root reaches, itself included. start: (graph_id, root).

    Semi-naive, HOPS steps a round: a round extends only what the round before reached last, and the loop ends when
    nothing is new, cycles included.
    """
    steps = materialise(edges.select("graph_id", F.col("src").alias("node_id"), F.col("dst").alias("next")).distinct(), "steps")
    seen = frontier = materialise(start.select("graph_id", "root", F.col("root").alias("node_id")).distinct(), "reach")
    while True:
        layer, layers = frontier, []
        for hop in range(1, HOPS + 1):
            layer = layer.join(steps, ["graph_id", "node_id"]).select("graph_id", "root", F.col("next").alias("node_id")).distinct()
            layers.append(layer.withColumn("hop", F.lit(hop)))
        found = functools.reduce(DataFrame.unionByName, layers).groupBy("graph_id", "root", "node_id").agg(F.min("hop").alias("hop"))
        found = materialise(found.join(seen, ["graph_id", "root", "node_id"], "left_anti"), "reach")
        seen = seen.unionByName(found.drop("hop"))
        frontier = found.where(F.col("hop") == HOPS).drop("hop")
        if frontier.isEmpty():
            return seen


def induced(members: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Distinct edges (by…, src, dst) with both ends in the same member set (graph_id, by…, node_id)."""
    pairs = edges.select("graph_id", "src", "dst").distinct()
    keys = ["graph_id", *(b for b in by if b != "graph_id")]
    out = members.select(*keys, F.col("node_id").alias("src")).join(pairs, ["graph_id", "src"])
    return out.join(members.select(*keys, F.col("node_id").alias("dst")), [*keys, "dst"], "left_semi").select(*keys, "src", "dst").distinct()


def forward_slices(nodes: DataFrame, edges: DataFrame, start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (graph_id, root, node_id) and edges (graph_id, root, src, dst) of the forward slice of each root."""
    members = materialise(reach(start, edges), "slices")
    return members, induced(members, edges, ["root"])


def forward_backward_slices(nodes: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """(graph_id, root, node_id): all from which a leaf of the root's forward slice is reached."""
    members, inner = forward_slices(nodes, edges, start)
    leaves = members.join(inner.select("graph_id", "root", F.col("src").alias("node_id")).distinct(), ["graph_id", "root", "node_id"], "left_anti")
    back = edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    reached = reach(leaves.select("graph_id", F.col("node_id").alias("root")), back).withColumnRenamed("root", "leaf")
    return leaves.select("graph_id", "root", F.col("node_id").alias("leaf")).join(reached, ["graph_id", "leaf"]).select("graph_id", "root", "node_id").distinct()


def abstract_nodes(members: DataFrame, nodes: DataFrame, globals_: DataFrame | None = None) -> DataFrame:
    """Slice nodes with abstracted label and line; unlabelled nodes go. globals_: (graph_id, names)."""
    rows = members.join(nodes.where("label IS NOT NULL"), ["graph_id", "node_id"])
    if globals_ is not None:
        rows = rows.join(globals_, "graph_id", "left")
    label = abstract_label(F.col("label"), F.col("names") if globals_ is not None else None)
    rows = rows.withColumn("label", label).withColumn("line", line_of_url(F.col("url")))
    return rows.drop("url", "names") if globals_ is not None else rows.drop("url")


def quotient(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Distinct (by…, src_bb, dst_bb) of edges between two basic blocks; nodes without a block take no part."""
    at = nodes.where("bb_id IS NOT NULL").select(*by, "node_id", "bb_id")
    tail = at.select(*by, F.col("node_id").alias("src"), F.col("bb_id").alias("src_bb"))
    head = at.select(*by, F.col("node_id").alias("dst"), F.col("bb_id").alias("dst_bb"))
    return edges.join(tail, [*by, "src"]).join(head, [*by, "dst"]).where("src_bb <> dst_bb").select(*by, "src_bb", "dst_bb").distinct()


def chunks(nodes: DataFrame, edges: DataFrame, by: list[str], window: int) -> DataFrame:
    """(by…, bbs, node_id): the nodes of each window of blocks. Windows of 1 are the blocks, of 2 the quotient's edges;
    -1 gives no chunks, and neither do windows above 2; 0 and below -1 are errors."""
    if window == 0 or window < -1:
        raise ValueError("the chunk window is -1 (none) or at least 1")
    at = nodes.where("bb_id IS NOT NULL").select(*by, "bb_id", "node_id")
    if window == 1:
        return at.select(*by, F.col("bb_id").cast("string").alias("bbs"), "node_id")
    pairs = quotient(nodes, edges, by)
    bbs = F.concat_ws(",", "src_bb", "dst_bb")
    each = pairs.select(*by, bbs.alias("bbs"), F.explode(F.array("src_bb", "dst_bb")).alias("bb_id")).where(F.lit(window == 2))
    return each.join(at, [*by, "bb_id"]).select(*by, "bbs", "node_id")


def path_ngrams(edges: DataFrame, start: DataFrame, n: int) -> DataFrame:
    """(graph_id, root, members): the distinct node sets of n-grams along all simple paths from the root to a leaf, of any
    length. Paths that end are added to one table, so the plan does not grow with their length."""
    spark = edges.sparkSession
    steps = materialise(edges.select("graph_id", F.col("src").alias("end"), F.col("dst").alias("next")).distinct(), "steps")
    live = materialise(start.select("graph_id", "root", F.array("root").alias("path")), "paths")
    ended, schema = table_path(spark, "paths"), live.schema
    while not live.isEmpty():
        grown = live.withColumn("end", F.element_at("path", -1)).join(steps, ["graph_id", "end"], "left")
        fresh = F.col("next").isNotNull() & ~F.array_contains("path", F.col("next"))
        has = grown.groupBy("graph_id", "root", "path").agg(F.max(fresh).alias("grows"))
        has.where(~F.col("grows")).select("graph_id", "root", "path").write.mode("append").parquet(ended)
        live = materialise(grown.where(fresh).select("graph_id", "root", F.array_append("path", F.col("next")).alias("path")), "paths")
    paths = spark.read.schema(schema).parquet(ended) if start.take(1) else live
    from ..functions.scalars import ngrams

    grams = paths.select("graph_id", "root", F.explode(ngrams(F.col("path"), n)).alias("g"))
    return grams.select("graph_id", "root", F.array_join(F.array_sort("g"), ",").alias("members")).distinct()


def construct_hash(nodes: DataFrame, by: list[str], file: str = "file") -> DataFrame:
    """(by…, hash): sha1 of the file and the sorted sets of blocks, lines and labels, with separators between all items."""
    as_set = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), "\x1f")
    return nodes.groupBy(*by).agg(F.sha1(F.concat_ws("\x1e", F.first(file, ignorenulls=True), as_set("bb_id"), as_set("line"), as_set("label")).cast("binary")).alias("hash"))


def wl_labels(nodes: DataFrame, edges: DataFrame, rounds: int, by: list[str] = ("graph_id",)) -> DataFrame:
    """(by…, node_id, round, label): Weisfeiler-Lehman labels. A round hashes a label and the sorted labels of its
    successors, joined by underscores; a node without any hashes its own alone."""
    by = list(by)
    labels = materialise(nodes.select(*by, "node_id", F.col("label")), "wl")
    pairs = edges.select(*by, "src", "dst").distinct()
    out = labels.withColumn("round", F.lit(0))
    for r in range(1, rounds + 1):
        after = pairs.join(labels.select(*by, F.col("node_id").alias("dst"), "label"), [*by, "dst"]).groupBy(*by, F.col("src").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_list("label")), "_").alias("after"))
        new = labels.join(after, [*by, "node_id"], "left").withColumn("label", F.md5(F.concat_ws("_", "label", "after").cast("binary")))
        labels = materialise(new.select(*by, "node_id", "label"), "wl")
        out = out.unionByName(labels.withColumn("round", F.lit(r)))
    return out.select(*by, "node_id", "round", "label")


def integer_wl(nodes: DataFrame, edges: DataFrame, rounds: int, by: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """(by…, node_id, round, label): relabelling by whole numbers over neighbours on both sides. A round numbers the pairs of a
    label and the sorted labels of predecessors and successors, with equal numbers where they are equal: 60 bits of
    their md5, so that no task has to count them. A node without a label has 0 in round 0."""
    by = list(by)
    number = lambda text: F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    labels = materialise(nodes.select(*by, "node_id", F.when(F.col("label").isNull(), 0).otherwise(number(F.col("label"))).cast("long").alias("label")), "wl")
    pairs = edges.select(*by, "src", "dst").distinct()
    both = pairs.unionByName(pairs.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst")))
    out = labels.withColumn("round", F.lit(0))
    for r in range(1, rounds + 1):
        near = both.join(labels.withColumnsRenamed({"node_id": "dst"}), [*by, "dst"]).groupBy(*by, F.col("src").alias("node_id")).agg(F.array_sort(F.collect_list("label")).alias("near"))
        text = F.concat_ws(",", F.col("label").cast("string"), F.transform("near", lambda x: x.cast("string")))
        labels = materialise(labels.join(near, [*by, "node_id"], "left").select(*by, "node_id", number(text).alias("label")), "wl")
        out = out.unionByName(labels.withColumn("round", F.lit(r)))
    return out.select(*by, "node_id", "round", "label")


def wl_sentences(labels: DataFrame, edges: DataFrame, by: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """(by…, node_id, round, sentence): a node's label `round+label`, then the distinct ones of its neighbours in the same
    round, the one before and the one after: what a skip-gram model of labels learns from."""
    by = list(by)
    word = F.concat(F.col("round").cast("string"), F.lit("+"), F.col("label").cast("string"))
    named = labels.select(*by, "node_id", "round", word.alias("word"))
    pairs = edges.select(*by, F.col("src").alias("node_id"), F.col("dst").alias("to")).unionByName(edges.select(*by, F.col("dst").alias("node_id"), F.col("src").alias("to"))).distinct()
    near = pairs.join(named.withColumnsRenamed({"node_id": "to", "round": "of"}), [*by, "to"]).select(*by, "node_id", "of", "word").distinct()
    near = near.withColumn("round", F.explode(F.array(F.col("of"), F.col("of") + 1, F.col("of") - 1)))
    place = F.when(F.col("of") == F.col("round"), 0).when(F.col("of") < F.col("round"), 1).otherwise(2)
    lists = near.groupBy(*by, "node_id", "round").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "word"))).alias("near"))
    full = named.join(lists, [*by, "node_id", "round"], "left")
    return full.select(*by, "node_id", "round", F.concat_ws(" ", "word", F.transform("near", lambda x: x["word"])).alias("sentence"))


def wl_kernel(labels: DataFrame, by: str = "graph_id") -> DataFrame:
    """(a, b, kernel), a < b: dot products of label counts over all rounds, normalised; graphs that share no label are left out."""
    counts = labels.groupBy(by, "round", "label").agg(F.count("*").alias("value"))
    feature = F.concat(F.col("round").cast("string"), F.lit(":"), "label")
    return count_products(counts.select(F.col(by).alias("id"), feature.alias("feature"), "value"), None, "kernel")


def degree_entropy(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, entropy): base-2 entropy of the distribution of degree centralities (equal degrees form one bin)."""
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id"))
    degree = nodes.select("graph_id", "node_id").join(ends.groupBy("graph_id", "node_id").agg(F.count("*").alias("d")), ["graph_id", "node_id"], "left").fillna(0, ["d"])
    bins = degree.groupBy("graph_id", "d").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(W.partitionBy("graph_id"))
    return bins.select("graph_id", p.alias("p")).groupBy("graph_id").agg(F.sum(-F.col("p") * F.log2("p")).alias("entropy"))


def spectra(edges: DataFrame) -> DataFrame:
    """(graph_id, values): the Laplacian eigenvalues of each graph in ascending order."""

    def spectrum(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = {v: i for i, v in enumerate(sorted({*pdf["src"], *pdf["dst"]}))}
        a = np.zeros((len(ids), len(ids)))
        for s, d in zip(pdf["src"], pdf["dst"], strict=True):
            if s != d:
                a[ids[s], ids[d]] = a[ids[d], ids[s]] = 1
        values = np.linalg.eigvalsh(np.diag(a.sum(axis=0)) - a)
        return pd.DataFrame({"graph_id": [pdf["graph_id"].iloc[0]], "values": [values.tolist()]})

    return edges.select("graph_id", "src", "dst").groupBy("graph_id").applyInPandas(spectrum, f"graph_id {dict(edges.dtypes)['graph_id']}, values array<double>")


def spectrum_distance(edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, distance) of graph pairs (a, b), or of all, a < b: squared differences of the Laplacian eigenvalues in ascending order,
    as many as both graphs have. (All of the energy is asked for, and only the last, largest value completes it.)"""
    found = spectra(edges)
    if pairs is None:
        return _all_gaps(materialise(found, "spectra"), "pairs")
    both = pairs.join(found.withColumnsRenamed({"graph_id": "a", "values": "x"}), "a").join(found.withColumnsRenamed({"graph_id": "b", "values": "y"}), "b")
    k = F.least(F.size("x"), F.size("y"))
    gaps = F.zip_with(F.slice("x", F.lit(1), k), F.slice("y", F.lit(1), k), lambda u, v: (u - v) * (u - v))
    return both.select("a", "b", F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v).alias("distance"))


def scaled_spectrum_distance(edges: DataFrame) -> DataFrame:
    """scaled_distances of all pairs of graphs: the pairs are compared twice, first for the greatest distance of each graph, so that
    none has to be kept or joined."""
    found = materialise(spectra(edges), "spectra")
    most = _all_gaps(found, "most").groupBy("graph_id").agg(F.max("most").alias("most"))
    return _all_gaps(materialise(found.join(most, "graph_id", "left").fillna(0.0, ["most"]), "most"), "scaled")


def _all_gaps(found: DataFrame, what: str) -> DataFrame:
    """Of all pairs of spectra (graph_id, values[, most]), in blocks: `pairs` (a, b, distance), a < b; `most` (graph_id, most), each
    graph's greatest distances by block; `scaled` (a, b, distance) both ways, over `most` of b."""
    kind = dict(found.dtypes)["graph_id"]
    items = found.where("graph_id IS NOT NULL").withColumnRenamed("graph_id", "id").withColumn("alike", F.xxhash64(*(c for c in found.columns if c != "graph_id")))
    size = items.agg(F.count("*").alias("n"), F.sum(F.size("values")).alias("rows")).first()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["values"].map(len).to_numpy()
        order = np.lexsort((pdf["id"], pdf["alike"], -lengths))  # long ones first, so that those with a k-th value are the first ones
        most = pdf["most"].to_numpy()[order] if "most" in pdf else np.zeros(len(pdf))
        values = np.concatenate([np.asarray(pdf["values"].iloc[i], np.float64) for i in order])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ids": [pdf["id"].to_numpy()[order].tolist()], "lengths": [shrink(lengths[order].astype(np.int64))], "values": [shrink(values)], "most": [shrink(most.astype(np.float64))]})

    def read(z: dict) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        lengths, values = grow(z["lengths"], np.int64), grow(z["values"], np.float64)
        starts = np.cumsum(lengths) - lengths
        columns = [values[starts[: int((lengths > k).sum())] + k] for k in range(int(lengths[0]))]
        return np.asarray(z["ids"]), lengths, columns, grow(z["most"], np.float64)

    def multiply(x, y, same):
        (a, la, xs, ma), (b, lb, ys, mb) = read(x), read(y)
        step, wide = 256, TILE // 256
        greatest = np.zeros(len(a)), np.zeros(len(b))
        for top in range(0, len(a), step):
            for left in range(0, len(b), wide):
                sums = np.zeros((min(step, len(a) - top), min(wide, len(b) - left)))
                for u, v in zip(xs, ys, strict=False):
                    u, v = u[top : top + step], v[left : left + wide]
                    if not len(u) or not len(v):
                        break
                    gaps = u[:, None] - v[None]
                    gaps *= gaps
                    sums[: len(u), : len(v)] += gaps
                if what == "most":
                    for z, at, axis in ((greatest[0], top, 1), (greatest[1], left, 0)):
                        some = sums.max(axis=axis)
                        z[at : at + len(some)] = np.maximum(z[at : at + len(some)], some)
                    continue
                i, j = (k.ravel() for k in np.indices(sums.shape))
                keep, low, high = ordered(a, b, top + i, left + j, same)
                i, j, gaps = i[keep], j[keep], sums.ravel()[keep]
                if what == "pairs":
                    yield pd.DataFrame({"a": low, "b": high, "distance": gaps})
                    continue
                for u, v, m in ((a[top + i], b[left + j], mb[left + j]), (b[left + j], a[top + i], ma[top + i])):
                    yield pd.DataFrame({"a": u, "b": v, "distance": np.divide(gaps, m, out=np.zeros(len(m)), where=m > 0)})
        if what == "most":
            yield pd.DataFrame({"graph_id": np.concatenate([a, b]), "most": np.concatenate(greatest)})

    packed = f"block int, ids array<{kind}>, lengths binary, values binary, most binary"
    out = f"graph_id {kind}, most double" if what == "most" else f"a {kind}, b {kind}, distance double"
    return pairs_of_blocks(items, size["n"], size["rows"] or 0, pack, packed, multiply, out, "spectra")


def scaled_distances(distances: DataFrame) -> DataFrame:
    """(a, b, distance) in both directions, each column b of the matrix scaled to 0..1; its least is the 0 of b with itself.
    A column of zeros stays so."""
    both = distances.select("a", "b", "distance").unionByName(distances.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    most = both.groupBy("b").agg(F.max("distance").alias("most"))
    return both.join(most, "b").select("a", "b", F.coalesce(F.try_divide("distance", "most"), F.lit(0.0)).alias("distance"))


# Undirected edge lists: (src, dst).


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each edge once, without loops."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"))


def graph_size(edges: DataFrame) -> DataFrame:
    """One row: vertices, edges (each undirected edge once) and loops."""
    both = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    n = both.select(F.explode(F.array("a", "b")).alias("v")).agg(F.count_distinct("v").alias("n_vertices"))
    return n.join(both.agg(F.sum((F.col("a") != F.col("b")).cast("long")).alias("n_edges"), F.sum((F.col("a") == F.col("b")).cast("long")).alias("n_loops")))  # one row each


def subgraph(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges between the given vertices (v)."""
    return edges.join(vertices.select(F.col("v").alias("src")), "src", "left_semi").join(vertices.select(F.col("v").alias("dst")), "dst", "left_semi").select("src", "dst")


def has_edge(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (src, dst) with a boolean `there`."""
    known = edges.select("src", "dst").distinct().withColumn("there", F.lit(True))
    return pairs.join(known, ["src", "dst"], "left").fillna(False, ["there"])


def adjacency(edges: DataFrame) -> DataFrame:
    """(v, neighbours): the sorted distinct neighbours that each vertex has edges to; a hub's list is one row."""
    return edges.groupBy(F.col("src").alias("v")).agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def clique(vertices: DataFrame) -> DataFrame:
    """(src, dst): an edge each way between any two of the vertices (v), which the caller keeps few: there are n(n - 1)."""
    v = vertices.select("v").distinct()
    ends = v.agg(F.collect_list("v").alias("all"))
    return v.join(F.broadcast(ends)).select(F.col("v").alias("src"), F.explode("all").alias("dst")).where("src <> dst")


def eligible(constructs: DataFrame, least: int = 2) -> DataFrame:
    """Constructs (location, hash, n_nodes) of more than `least` nodes, the first location of each hash."""
    first = constructs.where(F.col("n_nodes") > least).groupBy("hash").agg(F.min_by(F.struct(*constructs.columns), "location").alias("row"))
    return first.select(*(F.col("row").getField(c).alias(c) for c in constructs.columns))

