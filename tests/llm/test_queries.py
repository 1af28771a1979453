"""The registered queries on the smallest tables, against the libraries, DuckDB and plain sums."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from siftwork.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return queries.QUERIES[name](spark, SF).toPandas()


@pytest.fixture(scope="module")
def ids(texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}


def test_op1(spark, ids):
    got, start = run(spark, "op1_range_coded_ids").sort_values("doc_id"), 0
    for r, i in zip(got.itertuples(), sorted(ids), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids[i]), zlib.crc32(ids[i].tobytes()))
        start += len(ids[i])


def test_op3(spark, texts):
    got = run(spark, "op3_temperature_mixing")
    total = sum(len(t.encode().split()) for t in texts.values())
    assert set(got.doc_id) <= set(texts) and abs(got.n_tokens.sum() - total) < 0.25 * total
    assert got.groupby("doc_id").size().max() <= 2
    assert all(sorted(own.place) == list(range(len(own))) for _, own in got.groupby("block"))


@pytest.mark.parametrize("name", ["op4_rule_ledger", "op6_branch_and_bound", "op8_chosen_path_dedup"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = run(spark, name)[list(want.columns)]
    rows = lambda df: sorted(map(str, df.astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_op5(spark, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = run(spark, "op5_whole_token_counts")
    assert sorted(zip(got.doc_id, got.n_bytes, got.n_tokens, got.over_limit)) == sorted((i, len(t.encode()), n, n > 4096) for i, t in texts.items() for n in [len(model.encode(t))])


def test_op7(spark, ids):
    got = run(spark, "op7_vector_best_fit")
    for i, own in got.sort_values("piece").groupby("doc_id"):
        assert own.length.sum() == len(ids[i]) and (len(own) == 1) == (len(ids[i]) <= 2048)
        assert all(zlib.crc32(ids[i][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own.itertuples())
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 2048
    assert set(got.doc_id) == set(ids) and got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 2


def test_op9(spark, texts):
    got = run(spark, "op9_best_fit_sharding")
    assert {r.doc_id: (r.size, r.text_crc32) for r in got.itertuples(index=False)} == {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts.items()}
    assert set(got["law"]) == {"bytes"} and got.shard.between(0, 39).all() and got.grown_shard.isna().all()
    assert all(sorted(own.slot) == list(range(len(own))) for _, own in got.groupby("shard"))
    assert got.groupby("text_crc32").shard.nunique().max() == 1


def test_op10(spark, texts):
    got = run(spark, "op10_bayesian_language")
    docs = got[got.doc_id.notna()]
    assert set(docs.doc_id) == set(texts) and (docs[docs.kept].language == docs[docs.kept].declared).mean() > 0.97
    assert got[got.doc_id.isna()].page_id.notna().all()
