import re

from hypothesis import given, settings
from hypothesis import strategies as st

from siftwork.llm import quality_rules as q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


word = st.sampled_from(["a", "b", "é", "漢", "#*", "\x1f", "\x85", "x&y", "　"])
space = st.sampled_from([" ", "\n", "\t", "  ", "\r\n", "\x0b"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.lists(word | space, max_size=60).map("".join), max_size=4))
def test_measures_equal_brute_force(texts):
    got = q.measure(texts)
    assert [{k: int(v[i]) for k, v in got.items()} for i in range(len(texts))] == [brute(t) for t in texts]


def test_ledger_policies_and_ablation(spark):
    clean = " ".join(f"word{i}" for i in range(50))
    rows = [(1, clean), (2, "few words"), (3, "a b c d e " * 20), (4, " ".join(["sym###"] + [f"w{i}$$$" for i in range(30)])), (5, None), (None, ""), (6, "\n".join(["one line here"] * 3 + ["again and again this"] * 9)), (1, clean), (7, clean * 3000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fail_bits int, _m string")
    ledger = q.ledger(docs)
    got = {r.doc_id: r.fail_bits for r in ledger.collect() if r.doc_id}
    assert got[1] == 0 and got[2] == 1 << q.BIT["TOO_FEW_WORDS"] and got[4] == 1 << q.BIT["SYMBOL_RATIO"] and got[5] == 1
    assert got[3] >> q.BIT["REPEATED_WINDOWS"] & 1 and got[6] >> q.BIT["DUPLICATE_LINES"] & 1
    kept = [r.doc_id for r in ledger.where(q.passes("prose-1")).collect()]
    assert sorted(kept) == sorted(i for i, b in got.items() for _ in range(1 + (i == 1)) if not b)
    out = {r.rule: (r.n_failed, r.n_only) for r in q.ablation(ledger, "prose-1").collect()}
    bits = [r.fail_bits for r in ledger.collect()]
    for rule, bit in q.BIT.items():
        failed = sum(b >> bit & 1 for b in bits)
        assert out.get(rule, (0, 0)) == (failed, sum(b == 1 << bit for b in bits))
    same = q.filter_documents(docs)
    assert same.columns == docs.columns and sorted(r.doc_id for r in same.collect()) == sorted(kept)
    assert q.ledger(docs.limit(0)).count() == 0 and q.filter_documents(docs.limit(0)).count() == 0
