import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.llm import topk


def brute(rows, every, k, scale):
    ok = [(i, [math.floor(scale * x) for x in e]) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, e in {i: min(f for j, f in ok if j == i) for i, _ in ok if i % every == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(e, f)), i) for i, f in ok if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(16, 8192, 32768, 256, 4096), (3, 5, 17, 4, 8)])
def test_equals_brute_force(spark, monkeypatch, sizes):
    for name, size in zip(("DIMS", "QUERIES", "CANDIDATES", "TILE_Q", "TILE_C"), sizes):
        monkeypatch.setattr(topk, name, size)
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 1) for _ in range(20)]) for k in range(150)]
    rows += [(k + 200, [rng.choice([0.0, 0.5]) for _ in range(20)]) for k in range(60)] + [(k + 300, rows[3][1]) for k in range(40)]
    rows += [(400, None), (401, []), (402, [None] * 20), (403, [math.nan] * 20), (404, [math.inf] * 20), (None, rows[0][1]), (405, [0.0] * 20), rows[10], rows[10]]
    rows = [(i, e and [None if x is None else float(np.float32(x)) for x in e]) for i, e in rows]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<float>, part int")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 10 == 0, 7, 64.0).collect()))
    assert got == brute(rows, 10, 7, 64)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0, 7, 64.0).count() == 0
    few = df.where("vec_id IN (0, 1, 2)")
    assert topk.top_k(few, F.col("vec_id") % 10 == 0, 7, 64.0).count() == 2
    assert topk.top_k(few, F.col("vec_id") == -1, 7, 64.0).count() == 0


def test_bounds_drop_candidates_without_changing_results():
    rng = np.random.default_rng(0)
    c = np.floor(64 * rng.normal(size=(64, 3000)) * np.exp(-np.arange(3000) / 300))
    q = c[:, :20]
    i, j, s = topk.search(q, np.arange(20), c, np.arange(3000), 5)
    full = q.T @ c
    full[np.arange(20), np.arange(20)] = -np.inf
    for k in range(20):
        want = np.lexsort((np.arange(3000), -full[k]))[:5]
        assert j[i == k].tolist() == want.tolist() and s[i == k].tolist() == full[k][want].tolist()


def test_bounds_drop_most_pairs_of_the_given_embeddings():
    """Vectors without a short axis: after three quarters of the dimensions few pairs are left."""
    import pyarrow.parquet as pq

    vectors = pq.read_table("/root/testdata/sf0.1/embeddings.parquet", columns=["vec_id", "embedding"]).to_pydict()
    ids, c = np.array(vectors["vec_id"]), np.floor(64 * np.array(vectors["embedding"], float)).T
    own = ids % 20 == 0
    alive = np.zeros(5, np.int64)
    topk_tile, topk.TILE_C = topk.TILE_C, 512
    try:
        i, j, s = topk.search(c[:, own], ids[own], c, ids, 20, alive)
    finally:
        topk.TILE_C = topk_tile
    assert (np.diff(alive) <= 0).all() and alive[3] < 0.5 * alive[0] and alive[4] < 0.05 * alive[0]
    full = c[:, own].T @ c
    full[ids[own][:, None] == ids[None]] = -np.inf
    for k in range(full.shape[0]):
        want = np.lexsort((ids, -full[k]))[:20]
        assert j[i == k].tolist() == want.tolist() and s[i == k].tolist() == full[k][want].tolist()
