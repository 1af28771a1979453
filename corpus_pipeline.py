"""A training-corpus pipeline: quality rules, language ID, near-dedup, mixing and packing, each on all that the one
before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.
An empty table passes through every stage; columns besides those of `documents`, of any names, pass through all but the
last. Between stages the rows are written to the shared folder and read again, so that a lost executor costs no earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm import language, mixing, near_dedup, packing, quality_rules
from siftwork.llm.common import materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the policy prose-1. Null and empty texts fail; repeated rows are judged each."""
    return quality_rules.filter_documents(docs, "prose-1")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the evidence agrees on; `lang` then names it. Null texts stay if they declare a known
    language; null labels and sources are evidence of their own; repeated rows are judged each."""
    found = language.identify_documents(docs)
    return found.where("_kept").select(*(F.col("_language").alias(c) if c == "lang" else F.col(c) for c in docs.columns))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the smallest doc_id.

    Where ids are null or repeat, rows are told apart by numbers of their own: one row of each component is left then, too,
    and, of texts without shingles, which are in none, one row of each doc_id.
    """
    if not docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty():
        return _dedup_rows(docs)
    out = near_dedup.dedup(docs).where(~F.col("kept")).select("doc_id").distinct()
    return near_dedup.by_id(docs, out, inside=False)


def _dedup_rows(docs: DataFrame) -> DataFrame:
    held = max(docs.columns, key=len) + "_"  # a name that no column has
    numbered = docs.withColumnRenamed("doc_id", held).withColumn("doc_id", F.monotonically_increasing_id())
    rows = materialise(numbered, "numbered")
    found = near_dedup.dedup(rows).join(rows.select("doc_id", F.col(held).alias("own")), "doc_id")
    bare = (F.col("n_shingles") == 0) & F.col("own").isNotNull()
    found = found.withColumn("comp", F.when(~bare, F.col("component_id"))).withColumn("same", F.when(bare, F.col("own")))
    least = found.groupBy("comp", "same").agg(F.min(F.struct(F.col("own").isNull().alias("_"), "own", "doc_id")).alias("least"))
    out = materialise(found.select("doc_id").join(least.select(F.col("least.doc_id").alias("doc_id")), "doc_id", "left_anti"), "removed")
    left = near_dedup.by_id(rows, out, inside=False).drop("doc_id").withColumnRenamed(held, "doc_id")
    return left.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many words as there are, mixed so that no source is used more than 1.25 times; a row for each use.

    The rows of a block of the mixture follow one another in its order at random, as they are to be read.
    """
    mixed = mixing.mix(docs, mixing.n_words(), repeats=1.25, keep=tuple(docs.columns), places=False)
    n = len(docs.columns)
    names = [*map(str, range(n)), *(f"m{k}" for k in range(len(mixed.columns) - n))]
    mixed = mixed.toDF(*names)
    block = names[n + mixing.OUT.index("block")]
    order = F.xxhash64(F.lit(18), *map(F.col, names[n:]), *map(F.col, names[:n]))
    return mixed.repartition(block).sortWithinPartitions(block, order).select(*names[:n]).toDF(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of 2048 tokens. A null or empty text is one piece, its end id; repeated rows
    are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("near_dedup", dedup_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can express neither the fitted language models nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
