"""Token-id files: the ids of whole texts, in ascending doc_id order, as range-coded blocks with checksums.

A file is a Parquet table of chunks. A chunk holds whole documents: their doc_ids and lengths, the order-0 frequencies
of its ids, and blocks of ids, each coded from a fresh model and with its own crc32 (see range_coder, whose coder runs in
the JVM here, from RangeCoder.java). Chunks are ordered by (part, chunk): part is the range partition of doc_id that
wrote it. Spark's writer commits the files, so a lost executor leaves none half-written, and any store that Spark writes
to can hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans import jvm
from . import range_coder
from .common import table, table_path, text_batches
from .tokens import ByteBpe, loaded

#: A chunk is closed by the document that brings it to so many ids; a longer document makes a larger chunk of its own.
CHUNK = 2048 * 4096
#: Bytes of texts that are cut and looked up together, about, and of a batch that brings them: no other table of this
#: size is held meanwhile, and each distinct piece of them is looked up once.
TEXTS, BATCH = 16_000_000, 16 << 20
_DOCUMENTS = "part int, chunk int, n_ids long, doc_ids array<long>, doc_lengths array<long>"
_FIELDS = f"{_DOCUMENTS}, ids binary, freqs binary, block_bytes array<int>, block_crcs array<long>, payload binary"


def write_documents(docs: DataFrame, path: str, location: str, end: int = 0) -> None:
    """Write every text's ids (null: none), each followed by `end`, to `location`.

    A null doc_id comes first; repeated doc_ids follow one another, ordered by a hash of their texts; an empty table
    makes a file without chunks; other columns are ignored.
    """
    last = int(end).to_bytes(4, "little")
    text_batches(docs.sparkSession, BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = loaded(ByteBpe, path), TaskContext.get().partitionId()
        doc_ids, texts_ids, held, chunk = [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, texts_ids, held, chunk
            row = {"part": part, "chunk": chunk, "n_ids": held, "doc_ids": doc_ids, "doc_lengths": [len(x) // 4 for x in texts_ids], "data": b"".join(texts_ids)}
            doc_ids, texts_ids, held, chunk = [], [], 0, chunk + 1
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1), TEXTS), strict=True):
                doc_ids.append(i), texts_ids.append(data + last)
                held += len(data) // 4 + 1
                if held >= CHUNK:
                    yield close()
        if doc_ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    chunks = rows.mapInArrow(run, f"{_DOCUMENTS}, data binary")
    coder_functions(docs.sparkSession)
    coded = chunks.withColumn("coded", F.call_function("siftwork_range_encode", "data"))
    coded.select(*chunks.columns[:-1], "coded.*").write.parquet(location)


_ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("data", pa.binary())])


def coder_functions(spark: SparkSession) -> None:
    """The range coder and the documents' digests as functions of this session, in the JVM."""
    jvm.register(spark, resources.files(__package__).joinpath("RangeCoder.java").read_text(), "siftwork.RangeCoder")


def read_ids(chunk: dict) -> np.ndarray:
    """The ids of one chunk, without Spark; ValueError where a block does not match its checksum."""
    edges = np.cumsum([0, *chunk["block_bytes"]]).tolist()
    payloads = [chunk["payload"][a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return range_coder.decode(np.frombuffer(chunk["ids"], "<u4").astype(np.int64), np.frombuffer(chunk["freqs"], "<u4").astype(np.int64), payloads, chunk["block_crcs"], chunk["n_ids"])


def read_digests(spark: SparkSession, location: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it), n_tokens and the crc32 of its ids."""
    files = spark.read.schema(_FIELDS).parquet(location)
    # one sum a part, so the only window without a partition key has as many rows as the writer had tasks
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    whole = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("part_start"))
    within = W.partitionBy("part").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = files.select("part", "chunk", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("in_part")).join(parts, "part").select("part", "chunk", (F.col("in_part") + F.col("part_start")).alias("chunk_start"))
    coder_functions(spark)
    ids = F.call_function("siftwork_range_decode", "ids", "freqs", "block_bytes", "block_crcs", "n_ids", "payload")
    digests = F.call_function("siftwork_digests", ids, "doc_ids", "doc_lengths", "chunk_start")
    return files.join(starts, ["part", "chunk"]).select(F.inline(digests))


def op1_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    location = table_path(spark, "token-ids")
    write_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), location)
    return read_digests(spark, location)
