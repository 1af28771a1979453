"""Sharding: best-fit-decreasing bin packing of indivisible groups.

Groups of rows that must stay together enter, from the largest down, the shard whose remaining capacity is the
tightest that still holds them; a balanced tree over remaining capacities finds it. With `capacity` given, as few
shards as the method needs are opened; with `shards` given, the smallest capacity for which the method needs no more
shards is bisected, so that sizes come out near equal.

What the driver packs is bounded whatever the input: groups of at least 1/250 of a mean shard one by one (at most
250 a shard, as their sizes sum to the total), and all smaller groups in bundles by hash, in three widths so that
small bundles remain to level the shards at the end (at most 192 bundles a shard).

Edge cases: a null text is an empty one (size 16, crc32 0) and groups with the empty texts; repeated rows are all
placed, each with a slot of its own; a null doc_id is placed by its text like any other; an empty table gives no
rows; other columns are ignored. A group larger than the capacity sets the capacity (`shards`) or gets a shard of its
own (`capacity`).
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, with_rank

#: Groups of at least 1/HEAVY of a mean shard are packed one by one.
HEAVY = 250
#: (parts a shard, share of the hash space) of the bundles of smaller groups.
TIERS = ((16, 0.6), (48, 0.3), (128, 0.1))


class CapacityTree:
    """Remaining capacities in a treap: expected O(log n) insert, delete and search for the least one of at least x."""

    def __init__(self, seed: int = 1):
        self.root = None
        self.rng = random.Random(seed)

    def insert(self, key: tuple[int, int]) -> None:
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, self.rng.random(), None, None]), right)

    def _split(self, node, key):
        """Nodes below key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            a, b = self._split(node[3], key)
            node[3] = a
            return node, b
        a, b = self._split(node[2], key)
        node[2] = b
        return a, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a if b is None else b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def pop_tightest(self, need: int) -> tuple[int, int] | None:
        """Remove and return the least (remaining, bin) with remaining >= need."""
        node, best = self.root, None
        while node is not None:
            if node[0][0] >= need:
                best, node = node[0], node[2]
            else:
                node = node[3]
        if best is not None:
            left, right = self._split(self.root, best)
            _, right = self._split(right, (best[0], best[1] + 1))
            self.root = self._merge(left, right)
        return best


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Bin of each size; None as soon as more than `most` bins would be needed. Ties go by position."""
    tree, bins, placed = CapacityTree(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.pop_tightest(sizes[i])
        if found is None:
            if bins == most:
                return None
            found = (max(capacity, sizes[i]), bins)
            bins += 1
        placed[i] = found[1]
        tree.insert((found[0] - sizes[i], found[1]))
    return placed


def level(sizes: list[int], shards: int) -> list[int]:
    """Bins of near equal sums: items above the mean get bins of their own, the others those of the smallest capacity, to
    1 part in 100,000, that best_fit_decreasing fills with no more than the bins left."""
    total, own, order = sum(sizes), 0, sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    while own < min(len(sizes), shards - 1) and sizes[order[own]] * (shards - own) > total:
        total -= sizes[order[own]]
        own += 1
    if own:
        placed = [0] * len(sizes)
        for b, i in enumerate(order[:own]):
            placed[i] = b
        for i, b in zip(order[own:], level([sizes[i] for i in order[own:]], shards - own), strict=True):
            placed[i] = own + b
        return placed
    if not sizes:
        return []
    low = max(max(sizes), -(-sum(sizes) // shards))
    best = best_fit_decreasing(sizes, low, shards)
    if best is not None:
        return best
    step = max(1, low // 10_000)
    high = low + step
    while (best := best_fit_decreasing(sizes, high, shards)) is None:
        low, step = high, step * 4
        high = low + step
    while high - low > max(1, high // 100_000):
        middle = (low + high) // 2
        if (placed := best_fit_decreasing(sizes, middle, shards)) is None:
            low = middle
        else:
            high, best = middle, placed
    return best


def _bundle(key, shards: int):
    """Bundle number of a group by its hash; the tiers take their shares of the hash space."""
    u = F.pmod(F.xxhash64(key, F.lit("bundle")), F.lit(1 << 20))
    tier = F.pmod(F.xxhash64(key, F.lit("tier")), F.lit(1000))
    out, base, edge = F.lit(None).cast("long"), 0, 0.0
    choices = []
    for parts, share in TIERS:
        edge += share
        choices.append((edge, F.lit(base) + F.floor(u * F.lit(shards * parts) / F.lit(1 << 20))))
        base += shards * parts
    out = choices[-1][1]
    for upto, value in reversed(choices[:-1]):
        out = F.when(tier < round(upto * 1000), value).otherwise(out)
    return out.cast("long")


def shard_groups(rows: DataFrame, key: str, size: str, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """`rows` with a column `shard`: rows of equal `key` share one. `key` and `size` must not be null."""
    spark = rows.sparkSession
    groups = materialise(rows.groupBy(key).agg(F.sum(size).cast("long").alias("_size")), "groups")
    total = groups.agg(F.sum("_size")).first()[0] or 0
    wanted = shards or max(1, -(-total // capacity))
    least = max(1, -(-total // (wanted * HEAVY)))
    heavy = groups.where(F.col("_size") >= least).orderBy(F.desc("_size"), key).collect()
    light = groups.where(F.col("_size") < least).groupBy(_bundle(F.col(key), wanted).alias("b")).agg(F.sum("_size").alias("s")).orderBy("b").collect()
    sizes = [r["_size"] for r in heavy] + [r["s"] for r in light]
    placed = level(sizes, shards) if shards else best_fit_decreasing(sizes, capacity)
    kind = dict(rows.dtypes)[key]
    heavy_map = spark.createDataFrame([(r[key], s) for r, s in zip(heavy, placed)], f"{key} {kind}, _heavy int")
    light_map = spark.createDataFrame([(r["b"], s) for r, s in zip(light, placed[len(heavy):])], "_b long, _light int")
    # both maps are bounded by HEAVY and TIERS times the number of shards
    out = rows.join(F.broadcast(heavy_map), key, "left").withColumn("_b", _bundle(F.col(key), wanted)).join(F.broadcast(light_map), "_b", "left")
    return out.withColumn("shard", F.coalesce("_heavy", "_light")).drop("_b", "_heavy", "_light")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("_key"),
    )
    rows = materialise(rows, "sizes")
    placed = shard_groups(rows, "_key", "size", shards=shards)
    slots = with_rank(placed, ["shard"], [F.col("doc_id"), F.col("_key")], "slot", rows.count())
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("int"), F.lit(None).cast("int").alias("grown_shard"))


def op9_best_fit_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
