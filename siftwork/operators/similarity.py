"""All pairs whose cosine reaches a threshold, exactly."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.tables import materialise

#: Rows a block of the dense search, about; tasks that the pairs of blocks are dealt to, at most.
BLOCK, TASKS = 2048, 20_000
#: Items and feature rows a block where all pairs are wanted, about; blocks that fewer items are dealt to; pairs worked on together.
WIDE, LONG, SOME, TILE = 8192, 2_000_000, 8, 1 << 20


def _packed(vectors: DataFrame, id_: str, vec: str, blocks: int) -> DataFrame:
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ids": [pdf["id"].tolist()], "dims": [x.shape[1]], "x": [x.tobytes()]})

    rows = vectors.where(F.col(vec).isNotNull() & F.col(id_).isNotNull()).select(F.pmod(F.xxhash64(id_), F.lit(blocks)).cast("int").alias("block"), F.col(id_).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    return rows.groupBy("block").applyInPandas(pack, f"block int, ids array<{dict(rows.dtypes)['id']}>, dims int, x binary")


def dense_pairs(vectors: DataFrame, threshold: float, id_: str = "id", vec: str = "vec", metric: str = "cosine") -> DataFrame:
    """(a, b, sim), a < b, of dense vectors with sim >= threshold; a zero vector is similar to nothing.

    Blocks of about BLOCK vectors are multiplied as matrices, each unordered pair of blocks in one task; rows that
    travel are whole blocks. metric "euclidean" gives pairs at a distance of at most `threshold`, and `sim` is the
    distance.
    """
    return _block_products(vectors, threshold, id_, vec, metric, False)


def dense_links(vectors: DataFrame, threshold: float, id_: str = "id", vec: str = "vec", metric: str = "cosine") -> DataFrame:
    """(a, b) links that connect what the pairs of dense_pairs connect: each block product gives out a spanning forest of its
    pairs, at most a link a vector, so a group of like vectors does not give out its square."""
    return _block_products(vectors, threshold, id_, vec, metric, True).select("a", "b")


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The places of pairs (i, j) of n vertices that join what the ones before them have not joined."""
    least, kept = np.arange(n), []
    left = np.arange(len(i))
    while len(left):
        x, y = least[i[left]], least[j[left]]
        left = left[x != y]
        x, y = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]
        # one pair for each component that joins a smaller one
        y, first = np.unique(y, return_index=True)
        kept.append(left[first])
        least[y] = x[first]
        while (least[least] != least).any():
            least = least[least]
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _block_products(vectors: DataFrame, threshold: float, id_: str, vec: str, metric: str, links: bool) -> DataFrame:
    n = vectors.count()
    blocks = max(1, -(-n // BLOCK))
    packed = materialise(_packed(vectors, id_, vec, blocks), "blocks")
    left = packed.select(F.col("block").alias("i"), "ids", "dims", "x").withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(blocks - 1))))
    right = packed.select(F.col("block").alias("j"), F.col("ids").alias("ids2"), F.col("x").alias("x2"))
    kind = dict(vectors.dtypes)[id_]

    def multiply(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x, y = (np.frombuffer(v, np.float64).reshape(-1, r.dims) for v in (r.x, r.x2))
                a, b = np.asarray(r.ids), np.asarray(r.ids2)
                if metric == "cosine":
                    nx, ny = (np.sqrt((v * v).sum(axis=1)) for v in (x, y))
                    sim = (x / np.where(nx > 0, nx, 1)[:, None]) @ (y / np.where(ny > 0, ny, 1)[:, None]).T
                    ok = sim >= threshold
                    ok[nx == 0] = False
                    ok[:, ny == 0] = False
                else:
                    sim = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T, 0))
                    ok = sim <= threshold
                i, j = np.nonzero(ok)
                keep = a[i] < b[j] if r.i == r.j else a[i] != b[j]
                i, j = i[keep], j[keep]
                if links:
                    some = _forest(i, j if r.i == r.j else j + len(a), len(a) + len(b))
                    i, j = i[some], j[some]
                yield pd.DataFrame({"a": np.minimum(a[i], b[j]), "b": np.maximum(a[i], b[j]), "sim": sim[i, j]})

    return left.join(right, "j").select("i", "j", "dims", "ids", "x", "ids2", "x2").repartition(max(1, min(TASKS, blocks * (blocks + 1) // 2)), "i", "j").mapInPandas(multiply, f"a {kind}, b {kind}, sim double")


def shrink(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def grow(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


def pairs_of_blocks(items: DataFrame, n: int, rows: int, pack: Callable, packed: str, multiply: Callable[..., Iterator[pd.DataFrame]], out: str, name: str) -> DataFrame:
    """What multiply(x, y, same) gives for each unordered pair of blocks of the items (id, alike, ...), each in one task.

    pack makes one row (`packed`, which holds block) of a block's items; n items and `rows` of theirs decide how many blocks
    there are. Only blocks travel, never pairs of items. Items with the same `alike` share a block, unless they would fill
    much of it: pack is to put them side by side, so that equal results stand together, which files hold in less room.
    """
    blocks = max(-(-n // WIDE), -(-rows // LONG), min(SOME, -(-n // 512)), 1)
    many = items.select("id", "alike").distinct().groupBy("alike").count().where(F.col("count") > max(1, n // blocks // 8)).select("alike", F.lit(True).alias("many"))
    by = F.when(F.col("many"), F.xxhash64("id")).otherwise(F.xxhash64("alike"))
    dealt = items.join(many, "alike", "left").withColumn("block", F.pmod(by, F.lit(blocks)).cast("int")).drop("many")
    whole = materialise(dealt.groupBy("block").applyInPandas(pack, packed), name)
    columns = [c for c in whole.columns if c != "block"]
    left = whole.withColumnRenamed("block", "i").withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(blocks - 1))))
    right = whole.select(F.col("block").alias("j"), *(F.col(c).alias(f"{c}_2") for c in columns))

    def run(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                yield from multiply({c: r[c] for c in columns}, {c: r[f"{c}_2"] for c in columns}, r["i"] == r["j"])

    tasks = min(TASKS, blocks * (blocks + 1))
    return left.join(right, "j").repartition(tasks, "i", "j").mapInPandas(run, out)


def ordered(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the places (i, j) of ids x and y to keep, so that no pair stands twice, and the lesser and greater ids of those.
    Pairs whose lesser id is of x come first, so that in either part an id stays for many rows."""
    a, b = x[i], y[j]
    less, more = np.flatnonzero(a < b), np.flatnonzero(a > b)[: 0 if same else None]
    return np.concatenate([less, more]), np.concatenate([a[less], b[more]]), np.concatenate([b[less], a[more]])


def count_products(counts: DataFrame, least: float | None, name: str = "sim") -> DataFrame:
    """(a, b, name), a < b, of all items of long-form counts (id, feature, value) that share a feature: the dot product over both
    norms, where it is at least `least`, if given. Features may be of any number; a null one counts in the norm only."""
    counts = materialise(counts.where("id IS NOT NULL").select("id", F.col("feature").cast("string").alias("feature"), F.col("value").cast("double").alias("value")), "counts")
    kind = dict(counts.dtypes)["id"]
    size = counts.agg(F.count_distinct("id").alias("n"), F.count("*").alias("rows")).first()
    counts = counts.join(counts.groupBy("id").agg(F.bit_xor(F.xxhash64("feature", "value")).alias("alike")), "id")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, first, at = np.unique(pdf["id"].to_numpy(), return_index=True, return_inverse=True)
        order = np.argsort(pdf["alike"].to_numpy()[first], kind="stable")
        ids, at = ids[order], np.argsort(order)[at]
        norms = np.sqrt(np.bincount(at, pdf["value"].to_numpy() ** 2, len(ids)))
        some = pdf["feature"].notna().to_numpy()
        words, word = np.unique(pdf["feature"].to_numpy()[some].astype(object), return_inverse=True)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ids": [ids.tolist()], "norms": [shrink(norms)], "words": [words.tolist()], "at": [shrink(at[some].astype(np.int32))], "word": [shrink(word.astype(np.int32))], "value": [shrink(pdf["value"].to_numpy()[some])]})

    def multiply(x, y, same):
        place = {w: k for k, w in enumerate(set(x["words"]) & set(y["words"]))}
        if not place:
            return

        def read(z):
            to = np.array([place.get(w, -1) for w in z["words"]], np.int64)[grow(z["word"], np.int32)]
            by = np.flatnonzero(to >= 0)
            by = by[np.argsort(to[by], kind="stable")]
            return np.asarray(z["ids"]), grow(z["norms"], np.float64), grow(z["at"], np.int32)[by], to[by], grow(z["value"], np.float64)[by]

        (a, na, ra, wa, va), (b, nb, rb, wb, vb) = read(x), read(y)
        width = 512
        step = max(1, (TILE if len(place) <= width else 4 * TILE) // len(b))

        def spread(r, w, v, n, lo):
            p = slice(*np.searchsorted(w, [lo, lo + width]))
            held = np.zeros((n, min(width, len(place) - lo)))
            held[r[p], w[p] - lo] = v[p]
            return held

        other = spread(rb, wb, vb, len(b), 0)
        for top in range(0, len(a), step):
            n = min(step, len(a) - top)
            own = (ra >= top) & (ra < top + n)
            r, w, v = ra[own] - top, wa[own], va[own]
            dots = spread(r, w, v, n, 0) @ other.T
            for lo in range(width, len(place), width):
                dots += spread(r, w, v, n, lo) @ spread(rb, wb, vb, len(b), lo).T
            if least is None:
                i, j = np.nonzero(dots)
                sim = dots[i, j] / (na[top + i] * nb[j])
            else:
                # a little less at first, as the quotient is taken another way below
                with np.errstate(divide="ignore", invalid="ignore"):
                    i, j = np.nonzero(dots / na[top : top + n, None] / nb[None] >= least - 1e-9)
                sim = dots[i, j] / (na[top + i] * nb[j])
                i, j, sim = i[sim >= least], j[sim >= least], sim[sim >= least]
            keep, low, high = ordered(a, b, top + i, j, same)
            yield pd.DataFrame({"a": low, "b": high, name: sim[keep]})

    packed = f"block int, ids array<{kind}>, norms binary, words array<string>, at binary, word binary, value binary"
    return pairs_of_blocks(counts, size["n"], size["rows"], pack, packed, multiply, f"a {kind}, b {kind}, {name} double", "counts")


def sparse_pairs(features: DataFrame, threshold: float, id_: str = "construct_id") -> DataFrame:
    """(a, b, sim), a < b, of long-form counts with a cosine of at least `threshold` (above 0).

    Equal vectors are joined once, through the least id of each (`classes` tells them apart). Features are ordered from
    rare to frequent; a vector offers only its prefix up to where the rest's norm falls below the threshold, which two
    similar vectors must share a feature of. Candidates are then scored exactly. Where features are so few or frequent that
    prefixes would meet in about as many rows as there are pairs, all pairs are scored in blocks, and none travels.
    """
    norms = features.groupBy(id_).agg(F.sqrt(F.sum(F.col("value") * F.col("value").cast("double"))).alias("norm"))
    scaled = features.where("value <> 0").join(norms, id_).select(F.col(id_).alias("id"), "feature", (F.col("value") / F.col("norm")).alias("x"))
    scaled = materialise(scaled, "scaled")
    df = scaled.groupBy("feature").agg(F.count("*").alias("df"))
    rare = W.partitionBy("id").orderBy("df", "feature")
    rest = scaled.join(df, "feature").withColumn("before", F.coalesce(F.sum(F.col("x") * F.col("x")).over(rare.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    prefix = rest.where(1 - F.col("before") >= threshold * threshold - 1e-9).select("id", "feature")
    prefix = materialise(prefix, "prefix")
    met = prefix.groupBy("feature").agg(F.count("*").cast("double").alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1)).alias("rows")).first()["rows"] or 0
    n = scaled.select("id").distinct().count()
    if 4 * met >= n * (n - 1):
        return count_products(features.where("value <> 0").select(F.col(id_).alias("id"), "feature", "value"), threshold - 1e-12)
    candidates = prefix.withColumnRenamed("id", "a").join(prefix.withColumnRenamed("id", "b"), "feature").where("a < b").select("a", "b").distinct()
    x, y = scaled.withColumnsRenamed({"id": "a"}), scaled.withColumnsRenamed({"id": "b", "x": "y"})
    return candidates.join(x, "a").join(y, ["b", "feature"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("sim")).where(F.col("sim") >= threshold - 1e-12)


def vector_classes(features: DataFrame, id_: str = "construct_id") -> DataFrame:
    """(id_, representative): the least id of those with the same feature values."""
    key = features.where("value <> 0").groupBy(id_).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\x1f", "feature", "value"))), "\x1e"), 256).alias("_key"))
    return key.join(key.groupBy("_key").agg(F.min(id_).alias("representative")), "_key").select(id_, "representative")


def similar_links(features: DataFrame, threshold: float, id_: str = "construct_id") -> DataFrame:
    """(a, b) links that connect all pairs at the threshold: each copy with its representative, and similar representatives."""
    classes = materialise(vector_classes(features, id_), "classes")
    pairs = sparse_pairs(features.join(classes.select(F.col("representative").alias(id_)).distinct(), id_, "left_semi"), threshold, id_)
    return pairs.select("a", "b").unionByName(classes.where(F.col(id_) != F.col("representative")).select(F.col("representative").alias("a"), F.col(id_).alias("b")))
