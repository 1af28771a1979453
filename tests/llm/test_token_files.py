import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftwork.llm import range_coder, token_files
from siftwork.llm.common import table_path

BPE = public_tokenizers.path("byte_bpe_50k.json")


def back(e):
    return range_coder.decode(e["ids"], e["freqs"], e["payloads"], e["crcs"], e["n_ids"])


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 9000), st.sampled_from([1, 2, 300, 50_000, 1 << 28]), st.integers(0, 9))
def test_round_trip(n, ids, seed):
    rng = np.random.default_rng(seed)
    some = np.minimum(rng.integers(0, ids, n), rng.integers(0, ids, n))
    some[n // 2 :] = some[: n - n // 2]
    assert (back(range_coder.encode(some)) == some).all()


def test_repetition_is_cheap_and_damage_is_found():
    some = np.resize(np.random.default_rng(0).integers(0, 50_000, 50), 6000)
    e = range_coder.encode(some)
    assert sum(map(len, e["payloads"])) < 6000
    e["payloads"][1] = e["payloads"][1][:10] + b"\x01\x02" + e["payloads"][1][12:]
    with pytest.raises(ValueError, match="checksum"):
        back(e)


def test_blocks_are_independent():
    some = np.random.default_rng(0).integers(0, 99, 2 * range_coder.BLOCK)
    e = range_coder.encode(some)
    alone = range_coder.decode(e["ids"], e["freqs"], e["payloads"][1:], e["crcs"][1:], range_coder.BLOCK)
    assert (alone == some[range_coder.BLOCK :]).all()


def test_files(spark, monkeypatch):
    library = Tokenizer.from_file(BPE)
    long = "many words in here\n" * 4000
    rows = [(5, None, 1), (2, "", 1), (None, "a b", 1), (3, long, 1), (3, long, 1), (-4, "x y z", 1), *((k, f"row {k}", 1) for k in range(10, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(4)
    where = table_path(spark, "test-ids")
    token_files.write_documents(docs, BPE, where)
    got = token_files.read_digests(spark, where).toPandas().sort_values("start")
    want, start = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [(None if x != x else x, *r) for x, *r in got.itertuples(index=False)] == want
    empty = table_path(spark, "test-none")
    token_files.write_documents(docs.limit(0), BPE, empty)
    assert token_files.read_digests(spark, empty).count() == 0


def test_the_jvm_codes_the_same_bytes(spark):
    rng = np.random.default_rng(0)
    token_files.coder_functions(spark)
    words = np.resize(rng.integers(0, 50_000, 700), 9000)
    some = [np.zeros(1), np.arange(5000), np.resize([7, 7, 9], 4096), rng.zipf(1.3, 30_000) % 50_000, words, np.append(words, (1 << 28) - 1), rng.integers(0, 1 << 28, 70_000)]
    some = [s.astype("<u4") for s in some]
    got = spark.createDataFrame([(k, s.tobytes()) for k, s in enumerate(some)], "k int, data binary").selectExpr("k", "siftwork_range_encode(data) c").select("k", "c.*")
    back = got.selectExpr("k", *got.columns[1:], "siftwork_range_decode(ids, freqs, block_bytes, block_crcs, array(1, 5000, 4096, 30000, 9000, 9001, 70000)[k], payload) data")
    for row in back.collect():
        want = range_coder.encode(some[row.k])
        assert bytes(row.ids) == want["ids"].astype("<u4").tobytes() and bytes(row.freqs) == want["freqs"].astype("<u4").tobytes()
        assert row.block_bytes == list(map(len, want["payloads"])) and row.block_crcs == want["crcs"]
        assert bytes(row.payload) == b"".join(want["payloads"]) and bytes(row.data) == some[row.k].tobytes()


def test_files_are_coded_and_read_in_the_jvm(spark):
    docs = spark.createDataFrame([(k, f"row {k} " * 300) for k in range(40)], "doc_id long, text string").repartition(2)
    where = table_path(spark, "test-plain")
    token_files.write_documents(docs, BPE, where)
    digests = token_files.read_digests(spark, where)
    assert "MapInArrow" not in digests._jdf.queryExecution().toString() and digests.count() == 40
    ids = Tokenizer.from_file(BPE)
    want = [i for k in range(40) for i in (*ids.encode(f"row {k} " * 300, add_special_tokens=False).ids, 0)]
    chunks = sorted(spark.read.parquet(where).collect(), key=lambda r: (r.part, r.chunk))
    assert np.concatenate([token_files.read_ids(c.asDict()) for c in chunks]).tolist() == want
    # a block that is damaged is found
    bad = spark.read.parquet(where).selectExpr("*", "concat(substring(payload, 1, 9), x'0102', substring(payload, 12)) p").drop("payload").withColumnRenamed("p", "payload")
    other = table_path(spark, "test-damaged")
    bad.write.parquet(other)
    with pytest.raises(Exception, match="checksum"):
        token_files.read_digests(spark, other).collect()


def test_applications_in_one_process_have_the_coder_each():
    code = """
from pyspark.sql import SparkSession
from siftwork.llm import token_files
for _ in range(2):
    spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
    token_files.coder_functions(spark)
    data = spark.sql("SELECT siftwork_range_encode(x'0700000007000000') c").selectExpr("siftwork_range_decode(c.ids, c.freqs, c.block_bytes, c.block_crcs, 2, c.payload)")
    assert bytes(data.repartition(2).first()[0]) == bytes([7, 0, 0, 0] * 2)
    spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[2], timeout=120)
