"""Best-fit packing of token pieces into sequences under three capacities.

A sequence has residual tokens, documents and attention cost (the sum of squared lengths). Pieces enter, longest
first, the sequence that the weighted residual norm or dot product prefers among those that hold them under every
capacity; if none does, new ones open.

Only the histogram of lengths (at most `tokens` rows, whatever the input) reaches the driver. Pieces of one length are
alike, and so are sequences of one residual vector, so the plan moves whole ranges: "pieces 70 to 90 of length 31 go to
sequences 500 to 520 at offset 1900". Pieces are then numbered within their length, in parallel, and find their range
by binary search.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, text_batches, with_rank
from .tokens import ByteBpe, loaded

_RANKS = 1 << 40


def plan(lengths: list[int], counts: list[int], tokens: int, docs: int, attention: int, weights=(1.0, 0.01, 0.01), rule: str = "norm") -> tuple[np.ndarray, int]:
    """Segments (length, first rank, pieces, first sequence, offset), and the number of sequences.

    rule: "norm" takes the least weighted norm of what would remain, "dot" the greatest weighted dot product of the
    piece and the residuals. Ties go to the sequences opened first.
    """
    cap = np.array([tokens, docs, attention], float)
    w = np.array(weights, float)
    res, size, base = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    segments, opened = [], 0
    for s, left in sorted(zip(lengths, counts, strict=True), reverse=True):
        need = np.array([s, 1, s * s])
        if (need > cap).any():
            raise ValueError(f"a piece of {s} tokens exceeds a capacity")
        rank = 0
        res, size, base = (x[res[:, 0] > 0] for x in (res, size, base))
        while left:
            fits = np.flatnonzero((res >= need).all(axis=1))
            if not len(fits):
                break
            if rule == "norm":
                g = fits[np.argmin((w * ((res[fits] - need) / cap) ** 2).sum(axis=1))]
            else:
                g = fits[np.argmax((w * (need / cap) * (res[fits] / cap)).sum(axis=1))]
            n = min(left, int(size[g]))
            segments.append((s, rank, n, base[g], tokens - res[g, 0]))
            if n < size[g]:  # the rest of these sequences stays as it is
                res, size, base = np.vstack([res, res[g]]), np.append(size, size[g] - n), np.append(base, base[g] + n)
            res[g], size[g] = res[g] - need, n
            rank, left = rank + n, left - n
        each = int(min(cap // need))
        for n, k in ((left // each, each), (1, left % each)):
            if n and k:
                segments += [(s, rank + j * n, n, opened, j * s) for j in range(k)]
                res = np.vstack([res, np.array([tokens, docs, attention]) - k * need])
                size, base = np.append(size, n), np.append(base, opened)
                rank, opened = rank + n * k, opened + n
    return np.array(segments, np.int64).reshape(-1, 5), opened


def pack(pieces: DataFrame, tokens: int, docs: int | None = None, attention: int | None = None, weights=(1.0, 0.01, 0.01), order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """`pieces` (with `length` from 1 to `tokens`) with `sequence_id` and `offset`; the better of the two rules is used.

    Capacities that are not given never bind. Repeated pieces are packed each; no pieces give no sequences.
    """
    spark = pieces.sparkSession
    docs, attention = docs or tokens, attention or tokens * tokens
    histogram = sorted(map(tuple, pieces.groupBy("length").count().collect()))
    lengths, counts = [r[0] for r in histogram], [r[1] for r in histogram]
    segments, _ = min((plan(lengths, counts, tokens, docs, attention, weights, rule) for rule in ("norm", "dot")), key=lambda x: x[1])
    segments = segments[np.lexsort((segments[:, 1], segments[:, 0]))]
    sent = spark.sparkContext.broadcast((segments[:, 0] * _RANKS + segments[:, 1], segments[:, 1], segments[:, 3], segments[:, 4]))
    ranked = with_rank(pieces, ["length"], [F.col(c) for c in order], "_rank", sum(counts))
    names = ranked.columns
    at, rank_at = names.index("length"), names.index("_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, sequence, offset = sent.value
        for batch in batches:
            rank = batch.column(rank_at).to_numpy()
            k = np.searchsorted(keys, batch.column(at).to_numpy() * _RANKS + rank, side="right") - 1
            arrays = [batch.column(i) for i in range(len(names)) if i != rank_at]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sequence[k] + rank - first[k]), pa.array(offset[k])], [*(x for x in names if x != "_rank"), "sequence_id", "offset"])

    from pyspark.sql import types as T

    return ranked.mapInArrow(place, T.StructType([*(f for f in ranked.schema.fields if f.name != "_rank"), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pieces_of(docs: DataFrame, path: str, tokens: int = 2048, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each document's pieces: its ids and an end id, cut only if there are
    more than `tokens`, into pieces of `tokens` of which the first may be shorter."""
    last = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(ByteBpe, path)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encoder.encode_all(batch.column(1))):
                data = ids + last
                n = len(data) // 4
                a = 0
                for k, b in enumerate(range(n % tokens or tokens, n + 1, tokens)):
                    row.append(i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(data[4 * a : 4 * b]))
                    a = b
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, path: str, tokens: int = 2048, most_docs: int | None = None, most_attention: int | None = None) -> DataFrame:
    """Documents as pieces in sequences.

    A null or empty text is one piece, the end id alone; a null doc_id stays null; repeated rows are packed each; an
    empty table gives no rows; other columns are ignored. Texts of any length are packed whole.
    """
    text_batches(docs.sparkSession)
    return pack(materialise(pieces_of(docs, path, tokens), "pieces"), tokens, most_docs, most_attention)


def op7_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
