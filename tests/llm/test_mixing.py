import math
import random

import pytest

from siftwork.llm import mixing


def exponent(tokens, budget, entropy=None, repeats=None):
    total = sum(tokens)

    def measured(a):
        w = [(t / total) ** a for t in tokens]
        z = sum(w)
        w = [x / z for x in w]
        return -sum(x * math.log(x) for x in w if x), max(x * budget / t for x, t in zip(w, tokens))

    past = (lambda a: measured(a)[0] <= entropy) if entropy is not None else (lambda a: measured(a)[1] <= repeats)
    low, high = 0.0, 64.0 if entropy is not None else 1.0
    if past(low):
        return low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if past(mid) else (mid, high)
    return high


@pytest.mark.parametrize("goal", [{"entropy": 1.2}, {"entropy": 0.5}, {"repeats": 1.5}, {"entropy": 9.0}, {"repeats": 99.0}])
def test_exponent_equals_plain_bisection(spark, goal):
    tokens = [5000, 900, 600, 300, 40]
    sources = spark.createDataFrame([(str(k), t) for k, t in enumerate(tokens)] + [("none", 0)], "_source string, tokens long")
    got = mixing.find_exponent(sources, sum(tokens), sum(tokens), **goal)
    assert got == pytest.approx(exponent(tokens, sum(tokens), **goal), abs=1e-6)


def test_mixture_keeps_weights_budgets_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 500)
    monkeypatch.setattr(mixing, "BUCKET", 150)
    rng = random.Random(4)
    rows = [(k, "w " * rng.randrange(1, 30), rng.choice(["a"] * 8 + ["b", "b", None]), 1, "x") for k in range(600)]
    rows += [(900, None, "a", 1, "x"), (901, "", "b", 1, "x"), (902, None, "void", 1, "x"), (None, "q q", "b", 1, "x"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, block int, place string")
    got = mixing.mix(docs, mixing.n_words(), repeats=1.6).toPandas()
    words = lambda t: len((t or "").split())
    tokens = {}
    for _, t, s, *_ in rows:
        tokens[s] = tokens.get(s, 0) + words(t)
    del tokens["void"]
    total = sum(tokens.values())
    a = exponent(list(tokens.values()), total, repeats=1.6)
    z = sum((t / total) ** a for t in tokens.values())
    for s, t in tokens.items():
        goal = (t / total) ** a / z * total
        own = got[got.source.isna() if s is None else got.source == s]
        assert abs(own.n_tokens.sum() - goal) <= 30
        for p in range(int(goal // t)):  # whole passes use every document once
            assert len(own[own.pass_no == p]) == sum(1 for r in rows if r[2] == s)
        assert own[own.pass_no == 0].groupby(["doc_id", "n_tokens"]).size().max() <= 3
        for b in range(int(total // 500) - 1):
            assert abs(own[own.block == b].n_tokens.sum() - 500 * goal / total) <= 60
    for _, own in got.groupby("block"):
        assert sorted(own.place) == list(range(len(own)))
    assert mixing.mix(docs.limit(0), mixing.n_words(), repeats=1.5).count() == 0
    assert mixing.mix(docs.where("doc_id = 902"), mixing.n_words(), repeats=1.5).count() == 0


def test_word_counts(spark):
    texts = ["", None, " a", "a b\n", "\t\n ", "a\x0bb\x0cc\rd", "é　x y"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in docs.select(mixing.n_words()).collect()] == [0, 0, 1, 2, 0, 4, 2]


def test_sources_of_very_many_buckets(spark, monkeypatch):
    """As many buckets as a source of 600 million tokens would have."""
    monkeypatch.setattr(mixing, "BUCKET", 1)
    docs = spark.createDataFrame([(k, "w " * 10, "a") for k in range(300)], "doc_id long, text string, source string")
    assert mixing.mix(docs, mixing.n_words(), repeats=1.5).count() == 300
