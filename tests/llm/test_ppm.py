import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from siftwork.llm import ppm


def brute(train, texts):
    """PPM with explicit context dictionaries and exclusion sets."""
    spelt = lambda t: b" ".join((t or "").encode().lower().split()) + b"\n"
    trie = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    for t in train:
        data = b"\n" * ppm.ORDER + spelt(t)
        for i in range(ppm.ORDER, len(data)):
            for j in range(ppm.ORDER + 1):
                trie[j][data[i - j : i]][data[i]] += 1
    out = []
    for t in texts:
        data, total = b"\n" * ppm.ORDER + spelt(t), 0.0
        for i in range(ppm.ORDER, len(data)):
            excluded = set()
            for j in range(ppm.ORDER, -1, -1):
                seen = trie[j].get(data[i - j : i])
                if not seen:
                    continue
                left = {b: c for b, c in seen.items() if b not in excluded}
                if data[i] in left:
                    total += math.log10((2 * left[data[i]] - 1) / (2 * sum(left.values())))
                    break
                if left:
                    total += math.log10(len(left) / (2 * sum(left.values())))
                excluded |= set(seen)
            else:
                total -= math.log10(256 - len(excluded))
        out.append(total)
    return out


TEXTS = ["the cat sat on the mat. The cat", "a dog sat there; the dog barked", "Über straße café the", "", "zzz qqq unseen ☃ words", "the the the the the", "x", "dog cat mat " * 300]


@pytest.mark.parametrize("shard, run, hot", [(10_000_000, 3 << 19, 1 << 18), (40, 60, 0), (4, 300, 50)])
def test_scores_equal_brute_force(spark, monkeypatch, shard, run, hot):
    """Small shards cut contexts of many grams by their third byte; small runs make many questions to each shard."""
    monkeypatch.setattr(ppm, "SHARD", shard)
    monkeypatch.setattr(ppm, "RUN", run)
    monkeypatch.setattr(ppm, "HOT", hot)
    monkeypatch.setattr(ppm, "ASKED", 1 if run == 60 else 4096)
    monkeypatch.setattr(ppm, "PIECE", 8 if run == 60 else 1 << 14)
    train = [*TEXTS[:3], None, "", "cats and dogs are on the mats"]
    docs = spark.createDataFrame([(t, 0) for t in train], "text string, score int")
    model = ppm.train(docs)
    assert (model.tries > 1) == (shard <= 40) and (model.parts.max() > 1) == (shard == 4)
    rows = [(k, t) for k, t in enumerate([*TEXTS, None, TEXTS[0]])]
    got = ppm.score(spark.createDataFrame(rows, "doc_id long, text string"), model, {"doc_id": "long"}).toPandas().sort_values("doc_id")
    assert np.allclose(got.score, brute(train, [t for _, t in rows]), rtol=1e-9)
    counts = Counter(w for t in train for w in (t or "").encode().lower().split())
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    for (_, t), row in zip(rows, got.itertuples(), strict=True):
        words = (t or "").encode().lower().split()
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((len(train) + 1) / (n + v + 1))
        assert row.train_tokens == n and row.n_tokens == len(words) + 1 and row.n_known == sum(w in counts for w in words) + 1
        assert row.base_score == pytest.approx(base)


def test_chances_sum_to_one(spark):
    trie_input = [b"abcab", b"abd", b"bca ab"]
    g, starts = ppm.grams([t + b"\n" for t in trie_input])
    own = ppm._own(g, starts, np.array([len(t) + 1 for t in trie_input]))
    k, n = np.unique(own, return_counts=True)
    trie = ppm.Trie(k, n, ppm._totals(k & np.uint64(0xFFFF), n))
    for context in (b"\n\n\n\n\n", b"\n\nabc", b"xyzab", b"qqqqq", b"a ab\n"):
        base = int.from_bytes(context, "big") << 8
        every = np.array([base + b for b in range(256)], np.uint64)
        assert (10 ** trie.log10(every)).sum() == pytest.approx(1)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = ppm.train(none)
    one = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    row = ppm.score(one, model, {"doc_id": "long"}).first()
    assert row.score == pytest.approx(-3 * math.log10(256)) and row.n_known == 0 and row.train_tokens == 0
    assert ppm.score(none, model, {"doc_id": "long"}).count() == 0


def test_query_does_better_than_the_base_on_held_out_texts(spark):
    got = ppm.op2_ppm_scores(spark, "/root/testdata/sf0.1").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 7 == 2) for i, h in zip(got.doc_id, got.held_out))
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()
