"""Quality rules: a ledger of rule bitmasks.

Every rule is evaluated once a document. The ledger keeps the measurements and one bit for each failed rule; a policy
is a named, versioned mask over those bits, so a new policy, or what a policy would keep without one of its rules, is
bitwise arithmetic over the ledger and reads no text again.

Edge cases: a null or empty text has no words and fails TOO_FEW_WORDS; a null doc_id stays null; repeated rows give
repeated ledger rows; an empty table gives an empty ledger; other columns are ignored (`ledger`) or passed through
unread (`filter_documents`). Texts of any length are measured whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, materialise, table, text_batches, worker_memory

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Name -> failing condition, from a function that gives a measurement's column. A rule's bit is its place in this
#: list; only ever append.
RULES: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "TOO_FEW_WORDS": lambda m: m("n_words") < 10,
    "REPEATED_WINDOWS": lambda m: 100 * m("n_repeat_words") > 20 * m("n_words"),
    "SYMBOL_RATIO": lambda m: 100 * m("n_symbols") > 40 * m("n_words"),
    "DUPLICATE_LINES": lambda m: 100 * m("n_dup_lines") > 50 * m("n_lines"),
    "SHORT_WORDS": lambda m: m("word_chars") < 2 * m("n_words"),
    "LONG_WORDS": lambda m: m("word_chars") > 20 * m("n_words"),
}
BIT = {name: i for i, name in enumerate(RULES)}

#: Versioned policies: the rules that a kept document must not fail.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("TOO_FEW_WORDS", "REPEATED_WINDOWS"),
    "prose-1": tuple(RULES),
}


def mask_of(policy: str) -> int:
    return sum(1 << BIT[name] for name in POLICIES[policy])


class _Ids(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def _repeated(words: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document, how many of its words lie in a 5-word window that it holds twice or more.

    words, doc: the word number and the document number of each word, documents one after the other. Windows are
    compared by a 64-bit mix, and neighbours of equal mix then by their five words, so that no chance match counts.
    """
    out = np.zeros(n_docs, np.int64)
    n = len(words) - 4
    if n < 2:
        return out
    mixed = np.zeros(n, np.uint64)
    for k in range(5):
        mixed = (mixed ^ words[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed = (mixed ^ doc[:n].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    whole = np.flatnonzero(doc[:n] == doc[4:])
    keys = mixed[whole]
    ordered = np.sort(keys)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return out
    again = np.unique(again)
    at = np.searchsorted(again, keys)
    at[at == len(again)] = 0
    some = whole[again[at] == keys]
    some = some[np.argsort(mixed[some], kind="stable")]
    same = (mixed[some][1:] == mixed[some][:-1]) & (doc[some][1:] == doc[some][:-1])
    for k in range(5):
        same &= words[some + k][1:] == words[some + k][:-1]
    twice = np.zeros(len(some), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(words) + 1, np.int64)
    starts = some[twice]
    cover[starts] += 1
    np.add.at(cover, starts + 5, -1)
    return out + np.bincount(doc, weights=np.cumsum(cover)[:-1] > 0, minlength=n_docs).astype(np.int64)


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The MEASURES of each text."""
    out = {k: np.zeros(len(texts), np.int64) for k in MEASURES}
    ids, words = _Ids(), []
    for i, text in enumerate(texts):
        if not text:
            continue
        data = text.encode("utf-8", "surrogatepass")
        found = data.split()
        words.append(np.fromiter(map(ids.__getitem__, found), np.int64, len(found)))
        out["n_words"][i] = len(found)
        out["word_chars"][i] = len(text) - (len(data) - len(data.translate(None, SPACE)))
        out["n_symbols"][i] = len(data) - len(data.translate(None, SYMBOLS))
        lines = [x for x in data.split(b"\n") if x and not x.isspace()]
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
    if words:
        doc = np.repeat(np.arange(len(texts)), out["n_words"])
        out["n_repeat_words"] = _repeated(np.concatenate(words), doc, len(texts))
    return out


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_memory("quality_rules")
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for at in range(0, batch.num_rows, 512):
            got = measure(texts.slice(at, 512).to_pylist())
            yield pa.RecordBatch.from_arrays([ids.slice(at, 512), *(pa.array(got[k]) for k in MEASURES)], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and `fail_bits`: bit i is set if rule i of RULES fails."""
    text_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, " + ", ".join(f"{k} long" for k in MEASURES)
    measured = docs.select("doc_id", "text").mapInArrow(_measure_batches, schema)
    return measured.withColumn("fail_bits", fail_bits(F.col))


def fail_bits(m: Callable[[str], Column]) -> Column:
    bits = F.lit(0).cast("long")
    for name, failing in RULES.items():
        bits = bits.bitwiseOR(F.when(failing(m), F.lit(1 << BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def passes(policy: str, bits: str = "fail_bits"):
    """A column: no rule of the policy fails."""
    return F.col(bits).bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that only it rejects (kept without it).

    One count by distinct bitmask (at most 2^rules rows) is all that leaves the ledger.
    """
    mask = mask_of(policy)
    by_bits = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("b")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << BIT[r]).cast("long").alias("bit")) for r in POLICIES[policy]))
    each = by_bits.select("b", "n", F.explode(rules).alias("r")).where(F.col("b").bitwiseAND(F.col("r.bit")) != 0)
    return each.groupBy(F.col("r.rule").alias("rule")).agg(F.sum("n").alias("n_failed"), F.sum(F.when(F.col("b") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"))


def filter_documents(docs: DataFrame, policy: str = "prose-1") -> DataFrame:
    """The documents that the policy keeps, with all their columns. Null and repeated doc_ids are judged by their own text."""
    text_batches(docs.sparkSession)
    names = docs.columns
    at = names.index("text")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("quality_rules")
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                got = measure(part.column(at).to_pylist())
                yield part.append_column("_m", pa.StructArray.from_arrays([pa.array(got[k]) for k in MEASURES], list(MEASURES)))

    held = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]
    schema = T.StructType([*held, T.StructField("_m", T.StructType([T.StructField(k, T.LongType()) for k in MEASURES]))])
    rows = docs.toDF(*(f.name for f in held)).mapInArrow(measured, schema)
    kept = fail_bits(lambda k: F.col("_m").getField(k)).bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0
    return rows.where(kept).drop("_m").toDF(*names)


def op4_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is stored; policies are applied to what was stored."""
    rows = materialise(ledger(table(spark, sf_dir, "documents")), "ledger")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base-1")).alias("base_failed"), passes("prose-1").alias("kept"), "fail_bits")
