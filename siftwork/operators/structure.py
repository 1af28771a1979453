"""Random walks and structural identity: node2vec and multilayer structural similarity, over undirected edges (src, dst).

Walks draw from a hash of (seed, walk, step), so they can be repeated on any partitioning.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.tables import materialise


#: Vertices a part, about, where the order of degrees is dealt to tasks.
PART = 100_000


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))


def transitions(edges: DataFrame, p: float = 0.25, q: float = 0.25) -> DataFrame:
    """(prev, cur, next, prob): second-order transition chances: weight 1/p back to prev, 1 to its neighbours, 1/q elsewhere.

    edges: (src, dst[, weight]), both directions present. Joins on `cur` grow with the sum of squared degrees.
    """
    w = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
    first = edges.select(F.col("src").alias("prev"), F.col("dst").alias("cur"))
    second = w.select(F.col("src").alias("cur"), F.col("dst").alias("next"), "weight")
    near = edges.select(F.col("src").alias("prev"), F.col("dst").alias("next")).distinct().withColumn("near", F.lit(True))
    rows = first.join(second, "cur").join(near, ["prev", "next"], "left")
    bias = F.when(F.col("next") == F.col("prev"), 1 / p).when(F.col("near"), 1.0).otherwise(1 / q) * F.col("weight")
    return rows.select("prev", "cur", "next", (bias / F.sum(bias).over(W.partitionBy("prev", "cur"))).alias("prob"))


def walks(edges: DataFrame, n_walks: int = 10, length: int = 10, p: float = 0.25, q: float = 0.25, seed: int = 1) -> DataFrame:
    """(walk, path): n_walks second-order walks of `length` nodes from each vertex; a step is a join with a hashed draw."""
    chances = transitions(edges, p, q)
    upto = F.sum("prob").over(W.partitionBy("prev", "cur").orderBy("next").rowsBetween(W.unboundedPreceding, 0))
    steps = materialise(chances.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("prob")).withColumn("last", F.row_number().over(W.partitionBy("prev", "cur").orderBy(F.desc("next"))) == 1).select("prev", "cur", "next", "from", "upto", "last"), "transitions")
    w = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
    by = W.partitionBy("src")
    share = w.withColumn("upto", F.sum("weight").over(by.orderBy("dst").rowsBetween(W.unboundedPreceding, 0)) / F.sum("weight").over(by)).withColumn("from", F.col("upto") - F.col("weight") / F.sum("weight").over(by)).withColumn("last", F.row_number().over(by.orderBy(F.desc("dst"))) == 1)
    start = edges.select(F.col("src").alias("v")).distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n_walks))))
    live = start.select(F.concat_ws(":", "v", "k").alias("walk"), F.array("v").alias("path"), _uniform(F.lit(seed), F.col("v"), F.col("k"), F.lit(0)).alias("u"))
    hit = (F.col("from") <= F.col("u")) & ((F.col("u") < F.col("upto")) | F.col("last"))
    moved = live.withColumn("src", F.get("path", F.lit(0))).join(share.select("src", F.col("dst").alias("next"), "from", "upto", "last"), "src").where(hit)
    live = materialise(moved.select("walk", F.array_append("path", F.col("next")).alias("path")), "walks")
    for t in range(1, length - 1):
        drawn = live.select("walk", "path", F.element_at("path", -2).alias("prev"), F.element_at("path", -1).alias("cur"), _uniform(F.lit(seed), F.col("walk"), F.lit(t)).alias("u"))
        live = materialise(drawn.join(steps, ["prev", "cur"]).where(hit).select("walk", F.array_append("path", F.col("next")).alias("path")), "walks")
    return live


def node_embeddings(paths: DataFrame, dims: int = 128, window: int = 10, seed: int = 1) -> DataFrame:
    """(word, vector) by skip-gram over walks (path)."""
    from pyspark.ml.feature import Word2Vec

    sentences = paths.select(F.transform("path", lambda x: x.cast("string")).alias("path"))
    return Word2Vec(vectorSize=dims, windowSize=window, minCount=0, seed=seed, inputCol="path", outputCol="v").fit(sentences).getVectors()


def rings(edges: DataFrame, layers: int) -> DataFrame:
    """(v, layer, degrees): the sorted degrees of the vertices at each distance up to `layers`; breadth-first, all roots at once."""
    both = edges.select("src", "dst").distinct()
    degree = materialise(both.groupBy(F.col("src").alias("u")).agg(F.count("*").alias("d")), "degrees")
    frontier = materialise(degree.select(F.col("u").alias("v"), "u"), "ring")
    seen = frontier
    out = frontier.withColumn("layer", F.lit(0))
    for layer in range(1, layers + 1):
        step = frontier.join(both.withColumnsRenamed({"src": "u", "dst": "next"}), "u").select("v", F.col("next").alias("u")).distinct()
        frontier = materialise(step.join(seen, ["v", "u"], "left_anti"), "ring")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        out = out.unionByName(frontier.withColumn("layer", F.lit(layer)))
    return out.join(degree, "u").groupBy("v", "layer").agg(F.array_sort(F.collect_list("d")).alias("degrees"))


def compact(ring: DataFrame) -> DataFrame:
    """Rings with (degree, frequency) pairs in place of degree lists."""
    each = ring.select("v", "layer", F.explode("degrees").alias("degree")).groupBy("v", "layer", "degree").agg(F.count("*").alias("freq"))
    return each.groupBy("v", "layer").agg(F.array_sort(F.collect_list(F.struct("degree", "freq"))).alias("pairs"))


def candidates(edges: DataFrame) -> DataFrame:
    """(v, u): for each vertex about 2·log2(n) others of the closest degrees, by places in the order of degrees.

    The order's places are dealt in two levels: counts of the degrees' parts by hash, of about PART vertices of the whole
    order, then places within a part. So no task orders all vertices, nor all of the commonest degree.
    """
    degree = edges.select("src", "dst").distinct().groupBy(F.col("src").alias("v")).agg(F.count("*").alias("d"))
    n = degree.count()
    half = max(1, (2 * max(1, n).bit_length()) // 2)
    degree = materialise(degree.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(-(-max(1, n) // PART)))), "degrees")
    sizes = degree.groupBy("d", "part").agg(F.count("*").alias("m"))
    ahead = sizes.select("d", "part", F.coalesce(F.sum("m").over(W.orderBy("d", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # a row a part of a degree
    place = degree.join(ahead, ["d", "part"]).withColumn("place", F.col("ahead") + F.row_number().over(W.partitionBy("d", "part").orderBy("v")))
    wide = place.select("v", "d", F.col("place").alias("own")).withColumn("place", F.explode(F.sequence(F.col("own") - 2 * half, F.col("own") + 2 * half))).where("place <> own")
    near = wide.join(place.select("place", F.col("v").alias("u"), F.col("d").alias("du")), "place")
    order = W.partitionBy("v").orderBy(F.abs(F.col("d") - F.col("du")), F.abs(F.col("place") - F.col("own")), "u")
    return near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= 2 * half).select("v", "u")


def _paths(x: list, y: list, lows: list[int], highs: list[int]) -> tuple[float, list[tuple[int, int]]]:
    """The least cost of warping x to y, and its cells, where row i may use the columns lows[i] to highs[i]."""
    far = float("inf")
    before, low_before, moves = [], 0, []
    for i, (u, m) in enumerate(x):
        low, row, came = lows[i], [], []
        for j in range(low, highs[i] + 1):
            v, k = y[j]
            own = ((u if u > v else v) + 0.5) / ((v if u > v else u) + 0.5) - 1
            own *= m if m > k else k
            at = j - low_before
            up = before[at] if 0 <= at < len(before) else far
            left = row[-1] if row else far
            slant = before[at - 1] if 0 < at <= len(before) else far
            least, way = (up, 0) if up <= left else (left, 1)
            if slant < least:
                least, way = slant, 2
            row.append(own + (0.0 if i == j == 0 else least))
            came.append(way)
        before, low_before = row, low
        moves.append(came)
    i, j, cells = len(x) - 1, len(y) - 1, []
    while i or j:
        cells.append((i, j))
        way = moves[i][j - lows[i]]
        i, j = i - (way != 1), j - (way != 0)
    return before[len(y) - 1 - low_before], [*cells, (0, 0)]


def fast_warp(x: list, y: list, radius: int | None = 1) -> tuple[float, list[tuple[int, int]]]:
    """Dynamic time warping of two lists of (degree, frequency), in time in proportion to their lengths: the path found at
    half the resolution, widened by `radius`, bounds the cells. Without a radius all cells are used.

    A cell costs max/min - 1 of the degrees, raised by a half, times the greater frequency.
    """
    n, m = len(x), len(y)
    if radius is None or min(n, m) < radius + 2:
        return _paths(x, y, [0] * n, [m - 1] * n)
    halved = ([((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(z[::2], z[1::2])] for z in (x, y))  # noqa: B905  an odd last one goes
    lows, highs = [m] * n, [-1] * n
    for i, j in fast_warp(*halved, radius)[1]:
        low, high = max(0, 2 * (j - radius)), min(m - 1, 2 * (j + radius) + 1)
        for r in range(max(0, 2 * (i - radius)), min(n, 2 * (i + radius) + 2)):
            lows[r], highs[r] = min(lows[r], low), max(highs[r], high)
    return _paths(x, y, lows, highs)


def warped(radius: int | None = 1):
    """A column function of two rings, arrays of [degree, frequency]: their warped distance, null if one is null or empty.
    Arrow batches; rings that come again in a batch are warped once."""

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}

        def one(x, y):
            if x is None or y is None or not len(x) or not len(y):
                return None
            key = tuple(map(tuple, x)), tuple(map(tuple, y))
            if key not in known:
                known[key] = fast_warp(*key, radius)[0]
            return known[key]

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return distance


def layer_distances(ring: DataFrame, pairs: DataFrame, radius: int | None = 1) -> DataFrame:
    """(v, u, layer, distance): warped distances of rings, plain or compact, added up over layers; a pair ends at its first
    missing ring."""
    if "pairs" in ring.columns:
        points = F.transform("pairs", lambda p: F.array(p["degree"].cast("double"), p["freq"].cast("double")))
    else:
        points = F.transform("degrees", lambda d: F.array(d.cast("double"), F.lit(1.0)))
    rows = ring.select("v", "layer", points.alias("x"))
    both = pairs.join(rows, "v").join(rows.withColumnsRenamed({"v": "u", "x": "y"}), ["u", "layer"])
    each = both.select("v", "u", "layer", warped(radius)("x", "y").alias("own"))
    w = W.partitionBy("v", "u").orderBy("layer").rowsBetween(W.unboundedPreceding, 0)
    return each.withColumn("distance", F.sum("own").over(w)).select("v", "u", "layer", "distance")


def layer_weights(distances: DataFrame) -> DataFrame:
    """(layer, v, u, weight): exp(-distance), scaled to sum 1 for each vertex of a layer."""
    both = distances.select("layer", "v", "u", "distance").unionByName(distances.select("layer", F.col("u").alias("v"), F.col("v").alias("u"), "distance")).distinct()
    e = F.exp(-F.col("distance"))
    return both.select("layer", "v", "u", (e / F.sum(e).over(W.partitionBy("layer", "v"))).alias("weight"))


def climb_chances(weights: DataFrame) -> DataFrame:
    """(layer, v, p_up): chance to move up rather than down: log(x+e)/(1+log(x+e)) for x neighbours above the layer's mean weight."""
    mean = weights.groupBy("layer").agg(F.avg("weight").alias("mean"))
    x = weights.join(mean, "layer").groupBy("layer", "v").agg(F.sum((F.col("weight") > F.col("mean")).cast("long")).alias("x"))
    log = F.log(F.col("x") + F.exp(F.lit(1.0)))
    return x.select("layer", "v", (log / (log + 1)).alias("p_up"))


def structural_walks(weights: DataFrame, n_walks: int = 10, length: int = 10, stay: float = 0.3, seed: int = 1) -> DataFrame:
    """(walk, path): walks over the layers: with chance `stay` a step to a neighbour in the layer, else up or down a layer."""
    weights = materialise(weights, "weights")
    by = W.partitionBy("layer", "v")
    upto = F.sum("weight").over(by.orderBy("u").rowsBetween(W.unboundedPreceding, 0))
    steps = materialise(weights.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("weight")).withColumn("last", F.row_number().over(by.orderBy(F.desc("u"))) == 1), "steps")
    top = weights.groupBy("v").agg(F.max("layer").alias("top"))
    climbs = materialise(climb_chances(weights).join(top, "v"), "climbs")
    live = weights.where("layer = 0").select("v").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n_walks))))
    live = live.select(F.concat_ws(":", "v", "k").alias("walk"), F.array("v").alias("path"), "v", F.lit(0).alias("layer"))
    t = 0
    while not live.where(F.size("path") < length).isEmpty():
        for _ in range(5):  # steps between two writes
            u = lambda k, t=t: _uniform(F.lit(seed), F.col("walk"), F.lit(t), F.lit(k))
            # one chain of outer joins: a plan that used the walks twice a step would double with each step
            rows = live.withColumn("u0", u(1)).withColumn("open", F.size("path") < length).withColumn("moves", F.col("open") & (u(0) < stay))
            hit = F.col("moves") & (F.col("layer") == F.col("l")) & (F.col("v") == F.col("w")) & (F.col("from") <= F.col("u0")) & ((F.col("u0") < F.col("upto")) | F.col("last"))
            rows = rows.join(steps.select(F.col("layer").alias("l"), F.col("v").alias("w"), F.col("u").alias("next"), "from", "upto", "last"), hit, "left").drop("l", "w", "from", "upto", "last")
            rows = rows.join(climbs, ["layer", "v"], "left")
            up = (F.col("u0") < F.coalesce("p_up", F.lit(0.0))) & (F.col("layer") < F.col("top"))
            climbed = F.when(up, F.col("layer") + 1).otherwise(F.greatest(F.col("layer") - 1, F.lit(0)))
            path = F.when(F.col("moves"), F.array_append("path", F.col("next"))).otherwise(F.col("path"))
            live = rows.select("walk", path.alias("path"), F.when(F.col("moves"), F.col("next")).otherwise(F.col("v")).alias("v"), F.when(F.col("open") & ~F.col("moves"), climbed).otherwise(F.col("layer")).alias("layer"))
            t += 1
        live = materialise(live, "walks")
    return live.select("walk", "path")
