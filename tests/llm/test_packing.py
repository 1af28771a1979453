import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftwork.llm import packing

BPE = public_tokenizers.path("byte_bpe_50k.json")


def filled(segments):
    """(sequence, offset, length) of each planned piece."""
    return sorted((seq + j, off, s) for s, _, n, seq, off in segments.tolist() for j in range(n))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80), st.integers(1, 9), st.integers(2500, 6000), st.sampled_from(["norm", "dot"]))
def test_plan_keeps_every_capacity_and_every_piece(lengths, docs, attention, rule):
    which, counts = np.unique(np.array(lengths, int), return_counts=True)
    segments, opened = packing.plan(which.tolist(), counts.tolist(), 50, docs, attention, rule=rule)
    places = filled(segments)
    assert sorted(s for _, _, s in places) == sorted(lengths)
    for k in range(opened):
        own = [(o, s) for q, o, s in places if q == k]
        assert own and len(own) <= docs and sum(s * s for _, s in own) <= attention
        ends = np.cumsum([0, *(s for _, s in own)])
        assert ends[-1] <= 50 and [o for o, _ in own] == ends[:-1].tolist()
    for s in which.tolist():
        ranks = sorted(r + j for x, r, n, _, _ in segments.tolist() if x == s for j in range(n))
        assert ranks == list(range(lengths.count(s)))


def test_plan_is_near_the_lower_bound():
    rng = np.random.default_rng(3)
    lengths = np.minimum(2048, np.exp(rng.normal(5.5, 1, 20_000)).astype(int) + 1)
    which, counts = np.unique(lengths, return_counts=True)
    _, opened = packing.plan(which.tolist(), counts.tolist(), 2048, 2048, 2048**2)
    assert opened <= -(-lengths.sum() // 2048) + 1


def test_documents_round_trip(spark):
    library = Tokenizer.from_file(BPE)
    long = "word  and more\n" * 3000
    rows = [(1, None, 1), (2, "", 1), (None, "a b", 1), (3, long, 1), (3, long, 1), (4, "x y z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack_documents(docs, BPE, 2048).toPandas()
    for doc_id, text, copies in ((1, "", 1), (2, "", 1), (3, long, 2), (4, "x y z", 1)):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        own = got[got.doc_id == doc_id].sort_values(["piece", "sequence_id"])
        want = [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip([0, *range(len(ids) % 2048 or 2048, len(ids), 2048)], range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)))]
        assert list(zip(own.piece, own.start, own.length, own.ids_crc32)) == [x for x in want for _ in range(copies)]
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == np.cumsum([0, *own.length])[:-1].tolist() and own.length.sum() <= 2048
    assert got.sequence_id.nunique() == -(-int(got.length.sum()) // 2048)
    assert packing.pack_documents(docs.limit(0), BPE).count() == 0
