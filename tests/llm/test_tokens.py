import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftwork.llm import tokens

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
library = Tokenizer.from_file(BPE)
model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
fast = tokens.ByteBpe(BPE)
counts = tokens.PieceCounts(PIECES)

parts = st.sampled_from([" ", "  ", "\n", " \n", "\n ", "\t", "　", "\xa0", "\x1c", "\x85", "a", "the", "don't", "'s", "12", "...", "é", "ß", "漢字", "😀", "<|endoftext|>", "<|", "▁", "\0", "<s>", "</s>", "x" * 40, "Ġ"])
texts = st.lists(parts | st.text(max_size=3), max_size=25).map("".join)


def ids(text):
    import numpy as np

    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=400, deadline=None)
@given(st.lists(texts, max_size=4))
def test_byte_bpe_equals_the_library_on_whole_texts(several):
    assert list(fast.encode_all(several)) == [ids(t) for t in several]


@settings(max_examples=400, deadline=None)
@given(st.lists(texts, max_size=4))
def test_piece_counts_equal_the_library_on_whole_texts(several):
    assert counts.count_all(several) == [len(model.encode(t)) for t in several]


def test_tables_start_afresh_without_changing_results(monkeypatch):
    several = ["one two three  four", "five\nsix seven", "one eight nine ten eleven"]
    monkeypatch.setattr(tokens, "TABLE_ENTRIES", 3)
    small, pieces = tokens.ByteBpe(BPE), tokens.PieceCounts(PIECES)
    for several in (several, ["two three new words here"], [*several, "two three six, seven\neight"]):
        assert list(small.encode_all(several)) == [ids(t) for t in several]
        assert pieces.count_all(several) == [len(model.encode(t)) for t in several]


def test_every_proved_string_is_one_token():
    some = sorted(counts.one)[::97]
    assert some and all(len(model.encode(p)) == 1 for p in some)


def test_count_tokens_edge_cases(spark):
    rows = [(1, None, 9), (2, "", 9), (None, "a b", 9), (3, "word " * 5000, 9), (3, "word " * 5000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted(map(tuple, tokens.count_tokens(docs, PIECES).collect()), key=str)
    long = len(model.encode("word " * 5000))
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (None, 3, len(model.encode("a b")), False), *[(3, 25000, long, True)] * 2], key=str)
    assert tokens.count_tokens(docs.limit(0), PIECES).count() == 0


@pytest.mark.parametrize("name", ["documents"])
def test_real_texts(name):
    import pyarrow.parquet as pq

    some = pq.read_table(f"/root/testdata/sf0.001/{name}.parquet")["text"].to_pylist()
    assert list(fast.encode_all(some)) == [ids(t) for t in some]
    assert counts.count_all(some) == [len(model.encode(t)) for t in some]


@pytest.mark.parametrize("at_once", [1, 40, 10_000_000])
def test_ids_do_not_depend_on_how_many_texts_are_looked_up_together(at_once):
    texts = ["a1, b1,", "привет, мир", "x \n\n y,", "", None, "\n,a", "élan, ÉLAN.", "a,b c,d", ",", "  lead", "trail  ", "word, word. word", "\ta, b\t"] * 3
    encoder = tokens.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(texts, at_once)]
    assert got == [encoder.library.encode(t or "", add_special_tokens=False).ids for t in texts]
