import random

import numpy as np
import pytest

from siftwork.llm import near_dedup


def brute(rows):
    """doc_id -> (n_shingles, smallest doc_id linked with it)."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    to = {i: i for i in sets}

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            s, t = sets[x], sets[y]
            if x < y and s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((root(x), root(y)))
                to[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, groups, copies, words=60, edits=4):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(500)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        texts.append(base + passage * (rng.random() < 0.3))
        for _ in range(rng.randrange(copies)):
            new = list(base)
            for _ in range(rng.randrange(edits)):
                new[rng.randrange(words)] = rng.choice(vocabulary)
            texts.append(new)
    rng.shuffle(texts)
    return [(k * 3 + 1, " ".join(t)) for k, t in enumerate(texts)]


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.dedup(docs).collect()}
    assert got == brute(rows)


def template(seed, n, words=400, edits=8):
    """Texts made from one by edits of their own: many pairs lie just below the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    texts = []
    for _ in range(n):
        new = list(base)
        for _ in range(edits):
            new[rng.randrange(words)] = f"w{rng.randrange(500)}"
        texts.append(new)
    return [(k * 3 + 1, " ".join(t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize("depth, widest", [(6, 2), (2, 4)])
def test_alike_texts_in_blocks_equal_brute_force(spark, monkeypatch, depth, widest):
    for k, v in {"SMALL": 32, "BLOCK": 32, "DEPTH": depth, "WIDEST": widest, "CENTRE": 8, "PAIRS": 50}.items():
        monkeypatch.setattr(near_dedup, k, v)
    check(spark, template(3, 200) + [(10_000 + i, t) for i, t in corpus(4, 10, 5)])


def test_each_pair_across_components_meets_once(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    comps = [0] * 40 + [1] * 3 + list(range(2, 30))
    rows = spark.createDataFrame([(9, k, comps[k], len(comps)) for k in range(len(comps))], "node long, c long, comp long, m long")
    met = {}
    for r in near_dedup.block_pairs(rows).collect():
        met.setdefault(r.node, []).append(r)
    pairs = [tuple(sorted((a.c, b.c))) for t in met.values() for a in t for b in t if a.c < b.c and a.comp != b.comp and (a.side != b.side or a.side == 2)]
    assert sorted(pairs) == [(a, b) for a in range(len(comps)) for b in range(a + 1, len(comps)) if comps[a] != comps[b]]
    assert max(map(len, met.values())) < 4 * 8


def test_rows_of_an_alike_group_follow_its_size(spark, monkeypatch):
    """What the trees give out for one group, few of whose texts are linked: a bounded number of rows a class."""
    monkeypatch.setattr(near_dedup, "SMALL", 64)
    monkeypatch.setattr(near_dedup, "BLOCK", 256)
    for n in (500, 2000):
        sets = near_dedup.shingle_sets([t for _, t in template(6, n)])
        signatures = near_dedup.minwise(sets)[:, : near_dedup.BRANCHING]
        classes = spark.createDataFrame([(k, bytearray(x.tobytes()), k) for k, x in enumerate(signatures)], "c long, signature binary, comp long")
        small, large = near_dedup.nodes(classes, near_dedup.TREES)
        assert large.count() < 1.4**3 * near_dedup.TREES * n  # 1.4 children a class and level at most, three levels
        assert small.count() + near_dedup.block_pairs(large).count() < 1.4**3 * (near_dedup.WIDEST + 2) * near_dedup.TREES * n


def test_pairs_are_all_pairs_of_each_run(monkeypatch):
    monkeypatch.setattr(near_dedup, "PAIRS", 7)
    edges, sizes = np.array([0, 4, 5, 11]), np.array([4, 1, 6, 2])
    got = [(int(a), int(b)) for i, j in near_dedup._pairs(edges, sizes) for a, b in zip(i, j)]
    assert sorted(got) == [(e + a, e + b) for e, m in zip(edges, sizes) for a in range(m) for b in range(a + 1, m)]


@pytest.mark.parametrize("small", [48, 4])
def test_components_equal_brute_force(spark, monkeypatch, small):
    """With tiny nodes the large ones branch to the greatest depth and are then compared in blocks."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", 2 * small)
    monkeypatch.setattr(near_dedup, "DEPTH", 3 if small == 48 else 1)
    rows = corpus(1, 40, 7) + [(1000, None), (1001, ""), (1002, "One two"), (1003, "one TWO"), (1004, " \n"), (1005, "one two three"), (1006, "word " * 30_000)]
    check(spark, rows)


def test_repeated_and_null_ids_and_empty_tables(spark):
    text = "a b c d e f g h i j"
    docs = spark.createDataFrame([(7, text), (7, text), (None, text), (None, None), (9, text + " k")], "doc_id long, text string")
    got = sorted(map(tuple, near_dedup.dedup(docs).collect()), key=str)
    assert got == sorted([(7, 6, 7, True), (7, 6, 7, True), (None, 6, None, True), (None, 0, None, True), (9, 7, 7, False)], key=str)
    assert near_dedup.dedup(docs.limit(0)).count() == 0


def test_long_chains_become_one_component(spark):
    n = 200
    order = list(range(n))
    random.Random(5).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    got = near_dedup.components(links).toPandas()
    assert len(got) == n - 1 and (got.comp == 0).all()


def test_minwise_tokens_estimate_similarity():
    rng = np.random.default_rng(0)
    common, x, y = (rng.integers(0, 2**63, 300).astype(np.uint64) for _ in range(3))
    a, b = np.concatenate([common, x[:50]]), np.concatenate([common, y[:50]])
    s = near_dedup.minwise([a, b])
    assert abs((s[0] == s[1]).mean() - 0.75) < 0.25


def test_a_group_that_several_nodes_hold_is_confirmed_once(spark, monkeypatch):
    text = " ".join(f"w{k}" for k in range(60))
    texts = {1: text, 2: text + " x", 9: "y " + text, 30: " ".join(f"v{k}" for k in range(60))}
    sets = near_dedup.shingle_sets([*texts.values()])
    brief = {c: x.astype(np.uint8).tobytes() for c, x in zip(texts, near_dedup.minwise(sets), strict=True)}
    rows = [(node, c, c, 2, len(s), brief[c]) for node in range(7) for c, s in zip(texts, sets, strict=True)]
    found = near_dedup.compare(spark.createDataFrame(rows, "node long, c long, comp long, side int, n long, brief binary"))
    assert found.count() == 21 and {r.c for r in found.collect()} == {1, 2, 9}
    kept = []
    whole = near_dedup.materialise
    monkeypatch.setattr(near_dedup, "materialise", lambda df, name, *a: (kept.append(out) if name == "rows" else None, out)[1] if (out := whole(df, name, *a)) is not None else None)
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    links = near_dedup.confirm_nodes(found, docs).collect()
    assert kept[0].count() == 3 and len(links) == 2


def test_pairs_meet_once_in_stars_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "STAR", 8)
    pairs = [(0, b) for b in range(100, 300)] + [(k, k + 50) for k in range(1, 40)]
    met = {}
    for r in near_dedup.stars(spark.createDataFrame(pairs, "a long, b long")).collect():
        assert r.comp == r.c
        met.setdefault(r.node, set()).add(r.c)
    assert max(map(len, met.values())) < 4 * 8
    assert sorted((min(t), b) for t in met.values() for b in t - {min(t)}) == sorted(pairs)


def test_no_table_holds_sets_and_joined_components_are_not_sought_again(spark, monkeypatch):
    """Near copies are confirmed from texts that meet in nodes; the second round's labels start from the first's."""
    monkeypatch.setattr(near_dedup, "SMALL", 32)
    tables, sought = [], []
    whole, labels = near_dedup.materialise, near_dedup.components
    monkeypatch.setattr(near_dedup, "materialise", lambda df, *a, **k: (tables.append(df.columns), whole(df, *a, **k))[1])
    monkeypatch.setattr(near_dedup, "components", lambda links: (sought.append((links.count(), labels(links))), sought[-1][1])[1])
    check(spark, corpus(7, 60, 8, edits=12))
    assert not any("tokens" in columns for columns in tables)
    if len(sought) > 1:  # the first's members, one link each, and the links between components
        assert sought[1][0] <= 2 * sought[1][1].count()
