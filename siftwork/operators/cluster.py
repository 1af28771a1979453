"""Clustering in two nested steps. Cluster labels are the least member; -1 never arises except as DBSCAN noise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import Config, Step
from ..plans.tables import materialise
from ..plans.together import gathering, places
from .components import components, labelled
from .similarity import dense_links, dense_pairs, similar_links, sparse_pairs


#: Numbers of a block that affinity works on at once, about; entries that it begins with in each row.
AREA, LIVE = 1 << 21, 128


def threshold_clusters(items: DataFrame, links: DataFrame, id_: str = "id") -> DataFrame:
    """cc: (id_, cluster) by connected components of links (a, b)."""
    return labelled(items.select(id_).distinct(), links, id_).select(id_, F.col("comp").alias("cluster"))


def dbscan(items: DataFrame, neighbours: DataFrame, min_samples: int = 2, id_: str = "id") -> DataFrame:
    """(id_, cluster, core): density clusters over neighbour pairs (a, b), each within the radius of the other.

    A core has min_samples neighbours, itself included; a border item joins the least cluster of its core neighbours;
    noise has a null cluster.
    """
    ids = items.select(id_).distinct()
    both = materialise(neighbours.select("a", "b").unionByName(neighbours.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "neighbours")
    counts = both.groupBy(F.col("a").alias(id_)).agg(F.count("*").alias("k"))
    core = materialise(ids.join(counts, id_, "left").where(F.coalesce("k", F.lit(0)) + 1 >= min_samples).select(id_), "cores")
    as_ = lambda c: core.select(F.col(id_).alias(c))
    inner = both.join(as_("a"), "a", "left_semi").join(as_("b"), "b", "left_semi")
    clusters = labelled(core, inner, id_).select(id_, F.col("comp").alias("cluster"))
    border = both.join(as_("a"), "a", "left_anti").join(clusters.select(F.col(id_).alias("b"), "cluster"), "b").groupBy(F.col("a").alias(id_)).agg(F.min("cluster").alias("cluster"))
    found = clusters.withColumn("core", F.lit(True)).unionByName(border.withColumn("core", F.lit(False)))
    return ids.join(found, id_, "left").fillna(False, ["core"])


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x and y, with no more than a few MB besides the result."""
    out = np.empty((len(x), len(y)))
    step = max(1, (1 << 20) // max(1, y.size))
    for lo in range(0, len(x), step):
        out[lo : lo + step] = ((x[lo : lo + step, None] - y[None]) ** 2).sum(axis=2)
    return out


def _middle(gaps, loops: int, count: int, gather) -> float:
    """The median of `count` (an even number) values of at least 0 that tasks hold parts of, `loops` zeros in each aside: the
    mean of the middle two. `gaps` gives arrays of them, again and again: histograms of 16 bits at a time, until so few are left
    that they are told."""
    place = count // 2 - 1 + int(sum(gather(np.array([loops]))).sum())
    prefix, shift, left = 0, 64, count
    while shift == 64 or (shift and left > 1 << 16):
        shift -= 16
        found = np.zeros(1 << 16, np.int64)
        for row in gaps:
            bits = row.ravel().view(np.uint64) >> np.uint64(shift)
            if shift < 48:
                bits = bits[bits >> np.uint64(16) == prefix] & np.uint64(0xFFFF)
            found += np.bincount(bits.view(np.int64), minlength=1 << 16)
        found = sum(gather(found))
        upto = np.cumsum(found)
        digit = int(np.searchsorted(upto, place, side="right"))
        place -= int(upto[digit - 1]) if digit else 0
        prefix, left = prefix << 16 | digit, int(found[digit])
    held, above = [np.zeros(0)], np.inf
    for row in gaps:
        row = row.ravel()
        bits = row.view(np.uint64) >> np.uint64(shift)
        if shift:
            held.append(row[bits == prefix])
        above = row.min(where=bits > prefix, initial=above)
    above = min(float(v[0]) for v in gather(np.array([above])))
    if shift:
        told = np.sort(np.concatenate(gather(np.concatenate(held))))
        return float(told[place] + (told[place + 1] if place + 1 < left else above)) / 2
    value = float(np.array([prefix], np.uint64).view(np.float64)[0])
    return (value + (value if place + 1 < left else above)) / 2


class _Points:
    """Similarities of points, made where they are wanted: none of all pairs is held. `at` are places of points."""

    def __init__(self, x: np.ndarray, preference: float):
        self.x, self.preference = x - x.mean(axis=0), preference
        self.xx = (self.x * self.x).sum(axis=1)

    def gaps(self, at: np.ndarray, to: np.ndarray | None = None) -> np.ndarray:
        """Squared distances by a matrix product, so rounded."""
        y, yy = (self.x, self.xx) if to is None else (self.x[to], self.xx[to])
        out = self.x[at] @ y.T
        out *= -2
        out += self.xx[at][:, None]
        out += yy
        return np.maximum(out, 0, out=out)

    def slack(self, at: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """More than rounding and noise change of a squared distance of about `gap`."""
        return 4e-12 * (1 + gap) + 1e-15 * (self.x.shape[1] + 8) * (self.xx[at] + self.xx.max())

    def similarities(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Of the pairs (i, k), each with a little noise by a hash of its places, so that ties break."""
        s = np.empty(len(i))
        step = max(1, (1 << 19) // max(1, self.x.shape[1]))
        for lo in range(0, len(i), step):
            d = self.x[i[lo : lo + step]] - self.x[k[lo : lo + step]]
            s[lo : lo + step] = -(d * d).sum(axis=1)
        s[i == k] = self.preference
        z = (i.astype(np.uint64) * np.uint64(len(self.x)) + k.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
        noise = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53) - 0.5
        return s + 1e-12 * noise * (1 + np.abs(s))


class _Live:
    """The entries of rows lo to hi that count in affinity propagation, by row and column: s, r and a of each.

    An entry off the diagonal never has more than s as the sum of a and s, since its a is never above 0. So long as its s is
    below the second greatest sum of its row, it is neither of the two greatest, its r is not above 0, and no row or column
    notices it. Each row holds its diagonal and all entries of at least its floor. Where a row's second greatest sum falls below
    the floor, the row takes in more, and what these were in all rounds before follows from what the rounds told.
    """

    def __init__(self, points: _Points, lo: int, hi: int, damping: float):
        self.points, self.lo, self.n, self.damping = points, lo, len(points.x), damping
        self.floor = np.full(hi - lo, np.inf)
        self.start = np.zeros(hi - lo + 1, np.int64)
        self.col = np.zeros(0, np.int32)
        self.s, self.r, self.a = np.zeros(0), np.zeros(0), np.zeros(0)
        self.firsts: list[np.ndarray] = []  # by round, the greatest sum of each row, and of each column all positive r
        self.totals: list[np.ndarray] = []
        self.take(np.arange(hi - lo), np.full(hi - lo, np.inf), np.full(hi - lo, LIVE))

    def take(self, rows: np.ndarray, least: np.ndarray, count: np.ndarray) -> None:
        """Let the rows hold all entries of at least `least`, and the `count` greatest."""
        got = []
        order = np.argsort(count, kind="stable")
        step = max(1, AREA // self.n)
        for at in range(0, len(rows), step):
            some = order[at : at + step]
            own, k = rows[some], int(count[some].max())
            gaps = self.points.gaps(own + self.lo)
            cut = np.partition(gaps, k - 1, axis=1)[:, k - 1] if k < self.n else np.full(len(own), np.inf)
            cut = np.maximum(cut, -least[some])
            with np.errstate(invalid="ignore"):
                wide = cut + self.points.slack(own + self.lo, cut)
            gaps[np.arange(len(own)), own + self.lo] = 0
            i, col = np.nonzero(gaps <= wide[:, None])
            i = own[i]
            held = [self.col[self.start[q] : self.start[q + 1]].astype(np.int64) + q * self.n for q in own]
            new = ~np.isin(i * self.n + col, np.concatenate(held))
            i, col = i[new], col[new]
            s = self.points.similarities(i + self.lo, col)
            r, a, d = np.zeros(len(i)), np.zeros(len(i)), self.damping
            for first, total in zip(self.firsts, self.totals, strict=True):
                r = d * r + (1 - d) * (s - first[i])
                a = d * a + (1 - d) * np.minimum(total[col] - np.maximum(r, 0), 0)
            got.append((i, col.astype(np.int32), s, r, a))
            self.floor[own] = -cut
        i, col, *rest = (np.concatenate(v) for v in zip(*got, strict=True))
        own = np.repeat(np.arange(len(self.floor)), np.diff(self.start))
        order = np.argsort(np.concatenate([own, i]) * self.n + np.concatenate([self.col, col]), kind="stable")
        self.start += np.concatenate([[0], np.cumsum(np.bincount(i, minlength=len(self.floor)))])
        self.col = np.concatenate([self.col, col])[order]
        self.s, self.r, self.a = (np.concatenate([v, w])[order] for v, w in zip((self.s, self.r, self.a), rest, strict=True))
        of = np.repeat(np.arange(len(self.floor)), np.diff(self.start))
        self.diagonal = np.flatnonzero(self.col == of + self.lo)

    def parts(self):
        """Rows of about AREA / 8 entries in all, their entries, where each row begins in these, and where the diagonal is."""
        p = 0
        while p < len(self.floor):
            q = max(p + 1, int(np.searchsorted(self.start, self.start[p] + AREA // 8, side="right")) - 1)
            e = slice(self.start[p], self.start[q])
            yield slice(p, q), e, self.start[p:q] - e.start, self.diagonal[p:q] - e.start
            p = q

    def greatest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row the greatest sum of a and s, the next one, and where the greatest is."""
        first, second, at = np.empty(len(self.floor)), np.empty(len(self.floor)), np.empty(len(self.floor), np.int64)
        for p, e, start, _ in self.parts():
            t = self.a[e] + self.s[e]
            first[p] = np.maximum.reduceat(t, start)
            hit = np.flatnonzero(t == np.repeat(first[p], np.diff([*start, len(t)])))
            hit = hit[np.searchsorted(hit, start)]
            t[hit] = -np.inf
            second[p] = np.maximum.reduceat(t, start)
            at[p] = hit + e.start
        return first, second, at

    def round(self, gather) -> None:
        while True:
            first, second, at = self.greatest()
            short = np.flatnonzero(second < self.floor) if self.n > 1 else []
            if not len(short):
                break
            self.take(short, second[short], 2 * np.diff(self.start)[short])
        best = self.s[at] - (second if self.n > 1 else 0)
        d, total = self.damping, np.zeros(self.n)
        for p, e, start, diagonal in self.parts():
            t = self.s[e] - np.repeat(first[p], np.diff([*start, e.stop - e.start]))
            t[at[p] - e.start] = best[p]
            self.r[e] = d * self.r[e] + (1 - d) * t
            total += np.bincount(self.col[e], self._positive(e, diagonal), self.n)
        total = sum(gather(total))
        for _, e, _, diagonal in self.parts():
            t = total[self.col[e]] - self._positive(e, diagonal)
            kept = t[diagonal]
            np.minimum(t, 0, out=t)
            t[diagonal] = kept
            self.a[e] = d * self.a[e] + (1 - d) * t
        self.firsts.append(first)
        self.totals.append(total)

    def _positive(self, e: slice, diagonal: np.ndarray) -> np.ndarray:
        p = np.maximum(self.r[e], 0)
        p[diagonal] = self.r[e][diagonal]
        return p


def _affinity_rows(x: np.ndarray, lo: int, hi: int, preference: float | None, cosine: bool, damping: float, rounds: int, gather) -> np.ndarray:
    """The exemplar (a place) of each of the points x. This task works on the rows lo to hi of the three matrices, of which it
    holds the entries that count; `gather` hands its array to all tasks and gives back the arrays of all."""
    n = len(x)
    if cosine:
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        x = x / np.where(norm > 0, norm, 1)
        if x.shape[1] < n:  # points as far from one another as the rows of the cosine matrix, in as few dimensions as x has
            w, v = np.linalg.eigh(x.T @ x)
            x = x @ v * np.sqrt(np.maximum(w, 0))
        else:
            x = x @ x.T
    points, step = _Points(x, preference or 0.0), max(1, AREA // n)
    rows = [np.arange(at, min(hi, at + step)) for at in range(lo, hi, step)]

    class Gaps:
        def __iter__(self):
            for at in rows:
                gaps = points.gaps(at)
                gaps[np.arange(len(at)), at] = 0
                yield gaps

    if preference is None and n > 1:
        points.preference = -_middle(Gaps(), hi - lo, n * (n - 1), gather)
    live = _Live(points, lo, hi, damping)
    for _ in range(rounds):
        live.round(gather)
    score = np.concatenate(gather((live.a + live.r)[live.diagonal]))
    exemplars = np.flatnonzero(score > 0) if (score > 0).any() else np.array([score.argmax()])
    of = [np.zeros(0, np.int64)]
    for at in rows:
        gaps = points.gaps(at, exemplars)
        gaps[at[:, None] == exemplars] = 0
        least = gaps.min(axis=1)
        i, k = np.nonzero(gaps <= (least + points.slack(at, least))[:, None])
        s = points.similarities(at[i], exemplars[k])
        order = np.lexsort((k, -s, i))
        of.append(exemplars[k[order[np.unique(i[order], return_index=True)[1]]]])
    of = np.concatenate(gather(np.concatenate(of)))
    of[exemplars] = exemplars
    return of


def _by_exemplar(ids: np.ndarray, of: np.ndarray) -> list:
    """The least id of those that share an exemplar, ids being in ascending order."""
    _, first, at = np.unique(of, return_index=True, return_inverse=True)
    return list(ids[first][at])


def affinity(vectors: DataFrame, preference: float | None, cosine: bool, id_: str = "id", by: str | None = None, damping: float = 0.5, rounds: int = 200) -> DataFrame:
    """(by, id_, cluster) by affinity propagation of all vectors together, or within each value of a column `by` of the data.

    Similarity is the negative squared distance; with `cosine` the rows of the cosine matrix are the points. Of the three square
    matrices only entries that count are held (`_Live`): by one task for each value of `by`, else by rows, dealt to one task for each
    place of the cluster. These run at the same time and tell one another column sums in each round; the vectors, few beside
    their square, go to all.
    """
    if by:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(id_)
            ids, x = pdf[id_].to_numpy(), np.stack(pdf["vec"].to_numpy()).astype(float)
            of = _affinity_rows(x, 0, len(x), preference, cosine, damping, rounds, lambda v: [v])
            return pd.DataFrame({"_by": pdf["_by"].to_numpy(), id_: ids, "cluster": _by_exemplar(ids, of)})

        return _per_group(vectors, run, id_, by)
    spark = vectors.sparkSession
    sc, kind = spark.sparkContext, dict(vectors.dtypes)[id_]
    all_ = vectors.select(id_, F.col("vec").cast("array<double>").alias("vec")).where("vec IS NOT NULL").toPandas().sort_values(id_)
    schema = f"{id_} {kind}, cluster {kind}"
    if all_.empty:
        return spark.createDataFrame([], schema)
    ids, x = all_[id_].tolist(), np.stack(all_["vec"].to_numpy()).astype(float)
    tasks = min(len(x), places(sc))
    given = sc.broadcast((ids, x))

    def rows(numbers):
        ids, x = given.value
        (k,) = numbers
        lo, hi = len(x) * k // tasks, len(x) * (k + 1) // tasks
        with gathering() as gather:
            least = _by_exemplar(np.arange(len(x)), _affinity_rows(x, lo, hi, preference, cosine, damping, rounds, gather))
        return [(ids[i], ids[least[i]]) for i in range(lo, hi)]

    return materialise(spark.createDataFrame(sc.parallelize(range(tasks), tasks).barrier().mapPartitions(rows), schema), "affinity")


def _within(y: np.ndarray, x: np.ndarray, bandwidth: float) -> np.ndarray:
    """Which rows of x are within the bandwidth of rows of y: by matrix products, and where these are too close to tell, exactly."""
    yy, xx = (y * y).sum(axis=1), (x * x).sum(axis=1)
    gaps = yy[:, None] + xx[None] - 2 * (y @ x.T)
    near = gaps <= bandwidth**2
    gaps -= bandwidth**2
    i, j = np.nonzero(np.abs(gaps, out=gaps) <= 1e-9 * (yy.max(initial=0) + xx.max(initial=0) + bandwidth**2))
    for lo in range(0, len(i), 1 << 14):
        some = slice(lo, lo + (1 << 14))
        near[i[some], j[some]] = ((y[i[some]] - x[j[some]]) ** 2).sum(axis=1) <= bandwidth**2
    return near


def _climb(seeds: np.ndarray, x: np.ndarray, bandwidth: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the seeds come to rest among x, and how many of x are near there."""
    modes, weight, step = seeds.copy(), np.zeros(len(seeds), np.int64), max(1, (1 << 21) // max(1, len(x)))
    for lo in range(0, len(seeds), step):
        moving = np.arange(lo, min(len(seeds), lo + step))
        for _ in range(rounds):
            near = _within(modes[moving], x, bandwidth).astype(float)
            new = near @ x / np.maximum(near.sum(axis=1, keepdims=True), 1)
            far = np.sqrt(((new - modes[moving]) ** 2).sum(axis=1)) >= 1e-3 * bandwidth
            modes[moving] = new
            moving = moving[far]
            if not len(moving):
                break
        weight[lo : lo + step] = _within(modes[lo : lo + step], x, bandwidth).sum(axis=1)
    return modes, weight


def _centres(modes: np.ndarray, weight: np.ndarray, bandwidth: float) -> np.ndarray:
    """The places of the modes that no weightier centre is near, the weightiest first."""
    left, out = np.lexsort((np.arange(len(modes)), -weight)), []
    while len(left):
        some = left[:256]
        near, free, chosen = _within(modes[some], modes[some], bandwidth), np.ones(len(some), bool), []
        for k in range(len(some)):
            if free[k]:
                chosen.append(some[k])
                free &= ~near[k]
        out += chosen
        left = left[len(some) :]
        step = max(1, (1 << 21) // len(chosen))
        parts = [left[lo : lo + step] for lo in range(0, len(left), step)]
        left = np.concatenate([p[~_within(modes[p], modes[chosen], bandwidth).any(axis=1)] for p in parts]) if parts else left
    return np.array(out, np.int64)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 21) // max(1, len(centres)))
    return np.concatenate([_gaps(x[lo : lo + step], centres).argmin(axis=1) for lo in range(0, len(x), step)])


def mean_shift(vectors: DataFrame, bandwidth: float, id_: str = "id", by: str | None = None, rounds: int = 300) -> DataFrame:
    """(by, id_, cluster) by mean shift with a flat kernel of all vectors together, or within each value of `by`, in a task each.
    A mode rests once it moves less than a thousandth of the bandwidth.

    All together, blocks of the vectors climb in tasks of their own, each of which meets all vectors; one task chooses the
    centres among the modes.
    """
    if by:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(id_)
            ids, x = pdf[id_].to_numpy(), np.stack(pdf["vec"].to_numpy()).astype(float)
            modes, weight = _climb(x, x, bandwidth, rounds)
            return pd.DataFrame({"_by": pdf["_by"].to_numpy(), id_: ids, "cluster": _by_exemplar(ids, _nearest(x, modes[_centres(modes, weight, bandwidth)]))})

        return _per_group(vectors, run, id_, by)
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)[id_]
    rows = materialise(vectors.select(F.col(id_).alias("id"), F.col("vec").cast("array<double>").alias("vec")).where("vec IS NOT NULL AND id IS NOT NULL"), "vectors")
    blocks = max(1, min(4 * places(spark.sparkContext), rows.count() // 64))
    packed = f"block int, ids array<{kind}>, dims int, x binary"

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["vec"].to_numpy()).astype(float)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ids": [pdf["id"].tolist()], "dims": [x.shape[1]], "x": [x.tobytes()]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    whole = materialise(dealt.groupBy("block").applyInPandas(pack, packed), "blocks")

    def join(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, vectors and blocks of packed rows, by id."""
        ids = np.concatenate([np.asarray(v) for v in pdf["ids"]])
        order = np.argsort(ids, kind="stable")
        x = np.concatenate([np.frombuffer(v, np.float64).reshape(-1, d) for v, d in zip(pdf["x"], pdf["dims"], strict=True)])
        return ids[order], x[order], np.repeat(pdf["block"].to_numpy(), [len(v) for v in pdf["ids"]])[order]

    def climb(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x, block = join(pdf)
        own = block == pdf["i"].iloc[0]
        modes, weight = _climb(x[own], x, bandwidth, rounds)
        return pd.DataFrame({"block": [pdf["i"].iloc[0]], "ids": [ids[own].tolist()], "dims": [x.shape[1]], "x": [modes.tobytes()], "weight": [weight.tolist()]})

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        weight = np.concatenate(pdf["weight"].to_list())[np.argsort(np.concatenate([np.asarray(v) for v in pdf["ids"]]), kind="stable")]
        modes = join(pdf)[1]
        return pd.DataFrame({"dims": [modes.shape[1]], "centres": [modes[_centres(modes, weight, bandwidth)].tobytes()]})

    def place(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x, centres = (np.frombuffer(v, np.float64).reshape(-1, r.dims) for v in (r.x, r.centres))
                yield pd.DataFrame({"id": r.ids, "k": _nearest(x, centres)})

    climbed = materialise(whole.select(F.col("block").alias("i")).crossJoin(whole).repartition(2 * blocks, "i").groupBy("i").applyInPandas(climb, packed + ", weight array<long>"), "modes")
    chosen = materialise(climbed.groupBy().applyInPandas(choose, "dims int, centres binary"), "centres")
    placed = materialise(whole.repartition(blocks, "block").crossJoin(chosen.select("centres")).mapInPandas(place, f"id {kind}, k long"), "placed")
    least = placed.groupBy("k").agg(F.min("id").alias("cluster"))
    return placed.join(least, "k").select(F.col("id").alias(id_), "cluster")


def _per_group(vectors: DataFrame, run, id_: str, by: str | None) -> DataFrame:
    kinds = dict(vectors.dtypes)
    rows = vectors.select((F.col(by) if by else F.lit(0)).alias("_by"), id_, F.col("vec").cast("array<double>").alias("vec")).where("vec IS NOT NULL")
    out = rows.groupBy("_by").applyInPandas(run, f"_by {kinds[by] if by else 'int'}, {id_} {kinds[id_]}, cluster {kinds[id_]}")
    return out.withColumnRenamed("_by", by) if by else out.drop("_by")


def lda(features: DataFrame, topics: int, id_: str = "construct_id", seed: int = 1, rounds: int = 20, vocabulary: int = 1 << 16) -> DataFrame:
    """(id_, cluster): the likeliest of the topics of each construct's counts.

    Up to `vocabulary` distinct features have a place each; the names of so many are sent to the driver, which bounds the
    model. Beyond that, features share places by hash, so none is left out. Values are whole counts;
    a construct's row holds each feature as often as it counts.
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizerModel
    from pyspark.ml.functions import vector_to_array

    named = features.select(id_, F.col("feature").cast("string").alias("term"), F.col("value").cast("long").alias("value")).where("term IS NOT NULL AND value > 0")
    terms = [r.term for r in named.select("term").distinct().limit(vocabulary + 1).collect()]
    if len(terms) > vocabulary:
        named, terms = named.withColumn("term", F.pmod(F.xxhash64("term"), F.lit(vocabulary)).cast("string")), list(map(str, range(vocabulary)))
    sums = named.groupBy(id_, "term").agg(F.sum("value").cast("int").alias("n"))
    bags = sums.groupBy(id_).agg(F.flatten(F.collect_list(F.expr("array_repeat(term, n)"))).alias("terms"))
    if not terms:
        return bags.select(id_, F.lit(0).alias("cluster"))
    pack = CountVectorizerModel.from_vocabulary(sorted(terms), "terms", "features")
    rows = materialise(pack.transform(bags).select(id_, "features"), "counts")
    model = LDA(k=topics, maxIter=rounds, seed=seed, optimizer="online").fit(rows)
    p = vector_to_array("topicDistribution")
    return model.transform(rows).select(id_, (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("cluster"))


def members_by_size(clusters: DataFrame, id_: str = "id") -> DataFrame:
    """(cluster, n, members) from the largest cluster down."""
    return clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(id_)).alias("members")).orderBy(F.desc("n"), "cluster")


def gated(clusters: DataFrame, most: int = 50) -> DataFrame:
    """The clusters of 2 to `most` members."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    return clusters.join(sizes.where((F.col("n") > 1) & (F.col("n") <= most)).select("cluster"), "cluster", "left_semi")


def second_step(clusters: DataFrame, vectors: DataFrame, threshold: float, id_: str = "id", vec: str = "vec") -> DataFrame:
    """(cluster, sub, id_): each cluster split by cosine components of its members' vectors. The clusters must be gated:
    their bounded size bounds the pairs. A zero vector has the cosine 0 with all."""
    members = clusters.join(vectors.select(id_, F.col(vec).cast("array<double>").alias("v")), id_)
    a = members.select("cluster", F.col(id_).alias("a"), F.col("v").alias("x"))
    b = members.select("cluster", F.col(id_).alias("b"), F.col("v").alias("y"))
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    sim = F.try_divide(dot("x", "y"), F.sqrt(dot("x", "x")) * F.sqrt(dot("y", "y")))
    links = a.join(b, "cluster").where("a < b").where(F.coalesce(sim, F.lit(0.0)) >= threshold).select("a", "b")
    return labelled(members.select("cluster", id_), links, id_).select("cluster", F.col("comp").alias("sub"), id_)


def two_step(vectors: DataFrame, first: float, second: float, most: int = 50, id_: str = "id", vec: str = "vec") -> DataFrame:
    """(cluster, sub, id_): cosine components at `first`, gated by size, then split at `second`."""
    links = dense_links(vectors, first, id_, vec)
    clusters = materialise(gated(threshold_clusters(vectors, links, id_), most), "clusters")
    return second_step(clusters, vectors, second, id_, vec)


def cluster_by(step: Step, data: DataFrame, id_: str = "id", by: str | None = None, min_samples: int = 1) -> DataFrame:
    """([by,] id_, cluster) of long-form counts (id_, feature, value) or of vectors (id_, vec), by the step's algorithm.

    The threshold is the least cosine of cc and dbscancos, the greatest distance of dbscan, the bandwidth of means, the
    preference of aff and affcos, and the number of topics of lda. With `by`, a column whose groups are gated in size,
    each group is clustered apart; lda has one model for all. Noise of dbscan has a null cluster.
    """
    dense = "vec" in data.columns
    if step.algorithm in ("cc", "dbscancos", "dbscan"):
        if by:
            pairs = _pairs_within(data, step, id_, by)
        elif dense and step.algorithm == "cc":
            pairs = dense_links(data, step.threshold, id_)
        elif dense:
            pairs = dense_pairs(data, step.threshold, id_, metric="euclidean" if step.algorithm == "dbscan" else "cosine")
        elif step.algorithm == "cc":
            pairs = similar_links(data, step.threshold, id_)
        elif step.algorithm == "dbscancos":
            pairs = sparse_pairs(data, step.threshold, id_)
        else:
            raise ValueError("dbscan takes vectors")
        keys = data.select(*([by] if by else []), id_).distinct()
        found = threshold_clusters(keys, pairs, id_) if step.algorithm == "cc" else dbscan(keys, pairs, min_samples, id_).select(id_, "cluster")
        return keys.join(found, id_) if by else found
    if step.algorithm == "lda":
        found = lda(data, int(step.threshold), id_)
        return data.select(by, id_).distinct().join(found, id_) if by else found
    if not dense:
        raise ValueError(f"{step.algorithm} takes vectors")
    if step.algorithm == "means":
        return mean_shift(data, step.threshold, id_, by)
    return affinity(data, step.threshold or None, step.algorithm == "affcos", id_, by)


def _pairs_within(data: DataFrame, step: Step, id_: str, by: str) -> DataFrame:
    """(a, b) of one group that the step's threshold links."""
    if "vec" in data.columns:
        rows = data.select(by, id_, F.col("vec").cast("array<double>").alias("v"))
    else:
        norm = data.groupBy(by, id_).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.col("value").cast("double")))).alias("v"))
        rows = norm
    a, b = (rows.select(by, F.col(id_).alias(k), F.col("v").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    if "vec" in data.columns:
        dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    else:
        dot = lambda u, v: F.aggregate(F.map_keys(u), F.lit(0.0), lambda s, k: s + F.try_element_at(F.col(u), k) * F.coalesce(F.try_element_at(F.col(v), k), F.lit(0.0)))
    if step.algorithm == "dbscan":
        close = dot("x", "x") + dot("y", "y") - 2 * dot("x", "y") <= step.threshold**2
    else:
        close = F.coalesce(F.try_divide(dot("x", "y"), F.sqrt(dot("x", "x") * dot("y", "y"))), F.lit(0.0)) >= step.threshold
    return a.join(b, by).where("a < b").where(close).select("a", "b")


def run_steps(config: Config, first: DataFrame, second: DataFrame, id_: str = "id") -> DataFrame:
    """(cluster, sub, id_): clusters of `first` by the first step, gated by the settings' size, each split by the second step
    over `second`. Both are counts or vectors, as the steps' features say. Items without data of the second step are left out."""
    clusters = cluster_by(config.first, first, id_).where("cluster IS NOT NULL")
    clusters = materialise(gated(clusters, config.big_clusters), "clusters")
    members = materialise(clusters.join(second, id_), "members")
    members = members.withColumnRenamed("cluster", "parent")
    found = cluster_by(config.second, members, id_, "parent").where("cluster IS NOT NULL")
    return found.select(F.col("parent").alias("cluster"), F.col("cluster").alias("sub"), id_)


__all__ = ["affinity", "cluster_by", "components", "dbscan", "gated", "lda", "mean_shift", "members_by_size", "run_steps", "second_step", "threshold_clusters", "two_step"]
