"""Shared pieces of the corpus operators: tables in the cluster's shared folder, and ranks that no single task has to count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.tables import materialise, scratch, shared_dir, table, table_path

__all__ = ["SPACE", "materialise", "scratch", "shared_dir", "table", "table_path", "text_batches", "with_rank", "worker_memory"]

#: White space that ends a word: space and 0x09 to 0x0D. Any other character belongs to a word.
SPACE = b" \t\n\x0b\x0c\r"


_owner: list = ["", None]


def worker_memory(owner: str, clear: Callable[[], None] | None = None) -> None:
    """Called where a task starts in a Python worker: look-up tables that another operator's tasks left there are dropped."""
    if _owner[0] != owner:
        if _owner[1] is not None:
            _owner[1]()
        _owner[:] = owner, clear


def text_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Rows reach Python in batches of about so many bytes at most, from now on in this session: rows of text are long, and a
    batch of the usual count of them takes memory several times over, in the executor and its workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def with_rank(df: DataFrame, by: list[str], order: list[Column], to: str, rows: int) -> DataFrame:
    """Number the rows of each `by` group from 0 without gaps, in no stated order.

    Rows are dealt by a hash of `order` to buckets of about 100,000 rows of the whole table, ranked within
    (group, bucket), and moved up by the counts of the buckets before. A group of any size is thus split, and what
    is summed over a group are its bucket counts only. `rows` is the table's row count. `by` must not be null.
    """
    buckets = max(16, -(-rows // 100_000))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = dealt.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    offsets = counts.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = W.partitionBy(*by, "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_own", F.row_number().over(own))
    return ranked.join(offsets, [*by, "_bucket"]).withColumn(to, F.col("_before") + F.col("_own") - 1).drop("_bucket", "_own", "_before")
