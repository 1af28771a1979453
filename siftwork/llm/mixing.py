"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source with token share p gets a weight in proportion to p^a. The exponent a is bisected so that the weights have a
target entropy, or so that no source is repeated more than a limit (the least a from 0 to 1 that keeps the limit; at 1
all shares stay as they are). The weights times a token budget say how much of each source is used. A source's uses run through its documents
in passes, each pass in an order of its own, and end where the budget does; the uses of all sources are dealt to
blocks of BLOCK tokens such that each block has every source in its weight, and are ordered at random within it.

Token sums along a permutation are taken in two levels: within buckets of about BUCKET tokens of one source and pass,
and over the buckets' sums. So neither a source that holds a third of all rows nor a long table meets in one task. The
exponent is found by aggregations over the sources' sums, 15 exponents at a time (four bisections a job); the driver
sees 15 numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, materialise, table

#: Tokens of a block of the mixture, and of a bucket of one source and pass, about.
BLOCK, BUCKET = 1_000_000, 200_000
#: What mix() adds behind the columns kept, without places.
OUT = ("n_tokens", "pass_no", "block")
_SPACES = SPACE.decode()


def n_words(text: str = "text") -> Column:
    """Words of a text: what white space (0x20, 0x09 to 0x0D) separates. None for null."""
    inner = F.btrim(F.col(text), F.lit(_SPACES))
    return F.when(F.coalesce(inner, F.lit("")) == "", 0).otherwise(F.size(F.split(inner, "[ \\t\\n\\x0B\\f\\r]+"))).cast("long")


def _measures(sources: DataFrame, exponents: list[float], total: float, budget: float) -> list[tuple[float, float]]:
    """(entropy, most repeats) of the weights at each exponent."""
    p = F.col("tokens") / F.lit(float(total))
    aggregates = []
    for k, a in enumerate(exponents):
        x = F.pow(p, F.lit(a))
        aggregates += [F.sum(x).alias(f"z{k}"), F.sum(x * F.log(p)).alias(f"l{k}"), F.max(F.pow(p, F.lit(a - 1.0))).alias(f"r{k}")]
    row = sources.where("tokens > 0").agg(*aggregates).first()
    out = []
    for k, a in enumerate(exponents):
        z = row[f"z{k}"]
        out.append((math.log(z) - a * row[f"l{k}"] / z, row[f"r{k}"] / z * budget / total))
    return out


def find_exponent(sources: DataFrame, total: float, budget: float, entropy: float | None = None, repeats: float | None = None) -> float:
    """The exponent for a target entropy (nats) or a limit of repeats. A target out of reach gives the nearest exponent:
    0 for too high an entropy, 64 for too low a one, 1 for a limit below budget / total tokens."""
    low, high = (0.0, 64.0) if entropy is not None else (0.0, 1.0)

    def past(measured: tuple[float, float]) -> bool:
        """The exponent is large enough; true from some exponent on."""
        return measured[0] <= entropy if entropy is not None else measured[1] <= repeats

    if past(_measures(sources, [low], total, budget)[0]):
        return low
    for _ in range(8):
        grid = [low + (high - low) * k / 16 for k in range(1, 16)]
        first = next((k for k, m in enumerate(_measures(sources, grid, total, budget)) if past(m)), 15)
        low, high = ([low, *grid][first], [*grid, high][first])
    return high


def mix(docs: DataFrame, tokens: Column, budget: int | None = None, entropy: float | None = None, repeats: float | None = None, seed: int = 17, keep: tuple[str, ...] = ("doc_id", "source"), places: bool = True) -> DataFrame:
    """One row for each use of a document: columns `keep`, n_tokens, pass_no (from 0), block and place in the block.

    budget: tokens, all there are if not given. Every source gets its weight's part of it, to the nearest document;
    where that is more than it has, its documents are used again. A null source is a source; a source without tokens
    has no weight, and its documents are not used; a text without words counts no tokens and is used where it falls.
    Repeated rows are documents of their own; an empty table gives no rows. Without `places` the column place is left
    out, and with it one shuffle of all columns kept.
    """
    # columns kept may have any names; they travel under others
    held = [f"_keep{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(h) for c, h in zip(keep, held, strict=True)), F.coalesce(F.col("source"), F.lit("\0")).alias("_source"), tokens.cast("long").alias("_tokens"), F.xxhash64("doc_id", "text").alias("_id"))
    sources = materialise(rows.groupBy("_source").agg(F.sum("_tokens").alias("tokens")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        none = [F.col("_tokens").alias("n_tokens"), F.lit(0).alias("pass_no"), F.lit(0).cast("long").alias("block"), *([F.lit(0).alias("place")] if places else [])]
        return rows.select(*(F.col(h).alias(c) for c, h in zip(keep, held, strict=True)), *none).limit(0)
    budget = budget or total
    exponent = find_exponent(sources, total, budget, entropy, repeats)
    weight = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(exponent))
    z = sources.where("tokens > 0").agg(F.sum(weight)).first()[0]
    planned = sources.where("tokens > 0").select("_source", "tokens", (weight / F.lit(z)).alias("weight"))
    planned = planned.withColumn("goal", F.col("weight") * F.lit(float(budget))).withColumn("buckets", F.ceil(F.col("tokens") / F.lit(BUCKET)))
    planned = materialise(planned, "weights")
    uses = rows.join(planned, "_source").withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("goal") / F.col("tokens")) - 1, F.lit(0)).cast("int"))))
    uses = uses.withColumn("_draw", F.xxhash64(F.lit(seed), "_source", "pass_no", "_id").bitwiseAND(F.lit((1 << 52) - 1)))
    # the bucket takes the draw's high bits, so buckets follow one another in the order of the draws
    uses = uses.withColumn("_bucket", F.floor(F.col("_draw") * (F.col("buckets") / F.lit(float(1 << 52)))))
    group = ["_source", "pass_no", "_bucket"]
    sums = uses.groupBy(*group).agg(F.sum("_tokens").alias("_sum"))
    ahead = W.partitionBy("_source", "pass_no").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*group, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = W.partitionBy(*group).orderBy("_draw", "_id", held[0]).rowsBetween(W.unboundedPreceding, -1)
    placed = uses.withColumn("_inside", F.coalesce(F.sum("_tokens").over(inside), F.lit(0))).join(sums, group)
    start = F.col("pass_no") * F.col("tokens") + F.col("_ahead") + F.col("_inside")
    placed = placed.withColumn("_start", start).where(F.col("_start") < F.col("goal"))
    placed = placed.withColumn("block", F.floor(F.col("_start") / (F.col("weight") * F.lit(float(BLOCK)))).cast("long"))
    out = [*(F.col(h).alias(c) for c, h in zip(keep, held, strict=True)), F.col("_tokens").alias("n_tokens"), "pass_no", "block"]
    if not places:
        return placed.select(*out)
    order = W.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), "_draw"), "_source", "pass_no", "_id", held[0])
    return placed.withColumn("place", F.row_number().over(order) - 1).select(*out, "place")


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens of the table again as a mixture in which no source is used more than 1.25 times."""
    return mix(table(spark, sf_dir, "documents"), n_words(), repeats=1.25)
