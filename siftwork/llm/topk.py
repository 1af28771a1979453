"""Exact top-k search by columnar branch-and-bound.

Vectors lie dimension by dimension (a row an axis), the axes with most mass first. Scores of a block of queries against
a part of the candidates grow DIMS dimensions at a time. After each step a pair's score is at most what it has so far
plus the product of the two remaining norms (Cauchy-Schwarz); where that falls below the query's k-th best score so far,
the candidate is out for this query. Candidates that no query of a tile can want any more are packed away, and once few
pairs are left (SPARSE hundredths), the surviving pairs alone are carried on, packed after each step. The first tile of
candidates, those of the greatest norms, is scored whole and gives the first bounds. Results are exact.

Queries are a stated set; they are dealt in blocks, candidates in parts, and each (block, part) is a task of bounded size whose
best k a query go into one last ranking. Repeated vec_ids are candidates each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, table

#: Dimensions a step; rows a block of queries and a part of candidates, about; rows of either that are held as one tile.
DIMS, QUERIES, CANDIDATES = 16, 8192, 32768
TILE_Q, TILE_C = 256, 4096
#: Hundredths of a tile's pairs below which they are carried on one by one.
SPARSE = 40


class TooLarge(ValueError):
    """Inner products of these integers could pass 2^53, where doubles are no longer exact."""


def search(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, alive: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query: (query number, candidate number, score), ties to the smaller id.

    q: (dimensions, queries), c: (dimensions, candidates), both of whole numbers held as doubles. A candidate with the
    query's own id is left out. `alive`, an array of zeros with a place more than there are steps, is given the pairs
    that could be bounded, and how many of them are left after each step.
    """
    dims = len(q)
    steps = [*range(0, dims, DIMS), dims]
    rest = lambda x: np.stack([np.sqrt((x[d:] ** 2).sum(axis=0)) for d in steps[1:]])
    # axes with most mass first, and the candidates with the greatest norms: good scores come early and raise the bounds
    axes = np.argsort(-(q**2).mean(axis=1) * (c**2).mean(axis=1), kind="stable") if q.size and c.size else np.arange(dims)
    order = np.argsort(-np.sqrt((c**2).sum(axis=0)), kind="stable")
    q, c, c_ids = q[axes], np.ascontiguousarray(c[axes][:, order]), c_ids[order]
    c_rest = rest(c)
    out = []
    for ql in range(0, q.shape[1], TILE_Q):
        qt, qi = q[:, ql : ql + TILE_Q], q_ids[ql : ql + TILE_Q]
        # one part in 2^40 covers the rounding of the norms
        q_rest = rest(qt) * (1 + 2.0**-40)
        m = qt.shape[1]
        bound = np.full(m, -np.inf)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for cl in range(0, c.shape[1], TILE_C):
            part = slice(cl, min(cl + TILE_C, c.shape[1]))
            if np.isfinite(bound).any():
                i, j, score = _tile(qt, q_rest, c, c_rest, part, bound, steps, alive)
            else:
                i, j, score = _first(qt.T @ c[:, part], qi[:, None] == c_ids[None, part], part.start, k)
            other = qi[i] != c_ids[j]
            i, j, score = (np.concatenate([x, y[other]]) for x, y in zip(best, (i, j, score), strict=True))
            ranked = np.lexsort((c_ids[j], -score, i))
            i, j, score = i[ranked], j[ranked], score[ranked]
            first = np.searchsorted(i, np.arange(m))
            rank = np.arange(len(i)) - first[i]
            best = i[rank < k], j[rank < k], score[rank < k]
            bound[i[rank == k - 1]] = score[rank == k - 1]
        out.append((best[0] + ql, order[best[1]], best[2]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _first(scores: np.ndarray, own: np.ndarray, start: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of a tile, scored whole, that are among their query's k best, ties included."""
    scores[own] = -np.inf
    kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
    i, at = np.nonzero(scores >= kth[:, None])
    return i, at + start, scores[i, at]


def _tile(q: np.ndarray, q_rest: np.ndarray, c: np.ndarray, c_rest: np.ndarray, part: slice, bound: np.ndarray, steps: list[int], alive: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (query, candidate, score) of a tile that reach the queries' bounds."""
    live = np.arange(part.start, part.stop)
    sums, pairs = np.zeros((q.shape[1], len(live))), None
    if alive is not None:
        alive[0] += sums.size
    for s, (lo, hi) in enumerate(zip(steps[:-1], steps[1:], strict=True)):
        if pairs is None:
            sums += q[lo:hi].T @ (c[lo:hi, part] if len(live) == part.stop - part.start else c[lo:hi, live])
            may = sums + np.outer(q_rest[s], c_rest[s, live]) >= bound[:, None]
            left = int(may.sum())
            if 100 * left < SPARSE * may.size or hi == steps[-1]:
                i, at = np.nonzero(may)
                pairs, score = (i, live[at]), sums[i, at]
            else:
                some = may.any(axis=0)
                if some.sum() < 0.8 * len(live):
                    live, sums = live[some], sums[:, some]
        else:
            i, j = pairs
            for d in range(lo, hi):
                score += q[d, i] * c[d, j]
            keep = score + q_rest[s, i] * c_rest[s, j] >= bound[i]
            pairs, score = (i[keep], j[keep]), score[keep]
            left = len(score)
        if alive is not None:
            alive[s + 1] += left
    return (*pairs, score) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _whole(batch_values: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the vectors that take part, and (dimensions, vectors) of floor(scale * x)."""
    lengths = np.array([len(v) if v.is_valid else -1 for v in batch_values])
    flat = batch_values.flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(lengths, 0))
    good = lengths > 0
    bad = np.flatnonzero(~np.isfinite(values))
    good[np.searchsorted(ends, bad, side="right")] = False
    which = np.flatnonzero(good)
    if not len(which):
        return which, np.zeros((0, 0))
    dims = lengths[which[0]]
    if (lengths[which] != dims).any():
        raise ValueError("vectors of different lengths")
    at = (ends - lengths)[which][:, None] + np.arange(dims)
    return which, np.floor(scale * values[at]).T


def _pack(batches: Iterator[pa.RecordBatch], scale: float, role: int) -> Iterator[pa.RecordBatch]:
    """(part, vec_id, embedding), ordered by part, to rows of packed columns."""
    for batch in batches:
        which, values = _whole(batch.column(2), scale)
        parts, ids = batch.column(0).to_numpy()[which], batch.column(1).to_numpy()[which]
        for p in np.unique(parts):
            some = parts == p
            yield pa.RecordBatch.from_arrays([pa.array([role], pa.int32()), pa.array([int(p)], pa.int32()), pa.array([ids[some].astype(np.int64).tobytes()], pa.binary()), pa.array([np.ascontiguousarray(values[:, some]).tobytes()], pa.binary())], ["role", "part", "ids", "axes"])


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: float) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows of `vectors` (vec_id, embedding) but itself.

    Vectors that are null, empty, or hold null, NaN or infinite components take no part, nor do rows without a vec_id.
    An empty table, or no query, gives no rows; with fewer than k candidates all are returned; repeated rows are
    candidates each, but one query (that of the least vector); other columns are ignored. Integers whose products could pass 2^53 raise TooLarge.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), is_query.alias("query"))
    rows = rows.where(~F.exists("e", lambda x: x.isNull()))
    rows = materialise(rows, "vectors")
    n, m = rows.count(), rows.where("query").count()
    cores = spark.sparkContext.defaultParallelism
    parts = max(-(-n // CANDIDATES), min(cores, -(-n // 1024)), 1)
    blocks = max(-(-m // QUERIES), 1)

    def dealt(some: DataFrame, role: int, count: int) -> DataFrame:
        keyed = some.select(F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int").alias("part"), "vec_id", "e").repartition(count, "part").sortWithinPartitions("part")
        return keyed.mapInArrow(lambda it: _pack(it, scale, role), "role int, part int, ids binary, axes binary")

    # each part meets each block: rows here are packed batches
    c = dealt(rows, 1, parts).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = rows.where("query").groupBy("vec_id").agg(F.min("e").alias("e"))
    q = dealt(asked, 0, blocks).withColumn("block", F.col("part")).drop("part").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(key, group):
        sides = []
        for role in (0, 1):
            own = group[group["role"] == role]
            ids = [np.frombuffer(x, np.int64) for x in own["ids"]]
            axes = [np.frombuffer(x, np.float64).reshape(-1, len(i)) for x, i in zip(own["axes"], ids, strict=True)]
            sides.append((np.concatenate(axes, axis=1), np.concatenate(ids)) if ids else None)
        import pandas as pd

        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        if None in sides:
            return empty
        (qa, qi), (ca, ci) = sides
        if len(qa) != len(ca):
            raise ValueError("vectors of different lengths")
        if np.abs(qa).max(initial=0) * np.abs(ca).max(initial=0) * len(qa) >= 2.0**53:
            raise TooLarge(TooLarge.__doc__)
        i, j, score = search(qa, qi, ca, ci, k)
        return pd.DataFrame({"query_id": qi[i], "vec_id": ci[j], "score": score.astype(np.int64)})

    both = q.select("role", "block", "part", "ids", "axes").unionByName(c.select("role", "block", "part", "ids", "axes"))
    found = both.groupBy("block", "part").applyInPandas(run, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20, 64.0)
