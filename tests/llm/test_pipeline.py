import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftwork.llm import mixing, near_dedup, queries
from tests.llm.test_near_dedup import brute as exact_components
from tests.llm.test_quality_rules import brute as measures

SF = "/root/testdata/sf0.001"


def test_stages_on_all_that_was_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_dedup", "source_mixing", "best_fit_packing"]

    kept = stages["quality_rules"](spark, docs, SF)
    assert kept.columns == docs.columns

    def clean(text):
        m = measures(text)
        n = m["n_words"]
        return n >= 10 and 5 * m["n_repeat_words"] <= n and 5 * m["n_symbols"] <= 2 * n and 2 * m["n_dup_lines"] <= m["n_lines"] and 2 * n <= m["word_chars"] <= 20 * n

    good = {i for i, r in rows.items() if clean(r.text)}
    assert {r.doc_id for r in kept.collect()} == good

    named = stages["language_id"](spark, kept, SF)
    assert named.columns == docs.columns
    out = {r.doc_id: r for r in named.collect()}
    assert len(out) >= 0.99 * len(good) and sum(out[i].lang == rows[i].lang for i in out) >= 0.98 * len(out)
    assert all(out[i].text == rows[i].text for i in out)

    single = stages["near_dedup"](spark, named, SF)
    want = exact_components([(i, r.text) for i, r in out.items()])
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in want.items() if c == i}

    mixed = stages["source_mixing"](spark, single, SF)
    assert mixed.columns == docs.columns
    total, new = (x.agg(F.sum(mixing.n_words())).first()[0] for x in (single, mixed))
    assert abs(new - total) < 0.25 * total
    assert max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 2

    packed = stages["best_fit_packing"](spark, mixed, SF).toPandas()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packed.length.sum() == sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


def test_run_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns[:2] and got.count() > 100


def test_odd_rows_pass_through_every_stage(spark):
    text = " ".join(f"word{i} of text number" for i in range(40))
    rows = [(1, text, "en", "s", 9, "x"), (1, text, "en", "s", 9, "x"), (None, text + " more", "en", None, None, None), (2, None, None, None, None, None), (3, "", "en", "s", 0, "y"), (4, text.upper() + " words" * 9000, "en", "s", 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _m string").withColumn("kept", F.lit(0)).withColumn("block", F.lit("b"))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = near_dedup.materialise(out, "odd")
    assert docs.count() > 0


def test_registry():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_dedup_leaves_one_row_of_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{w}{i} of text number" for i in range(40)) for w in "abc")
    rows = [(7, a), (7, a), (8, a + " more"), (None, a), (None, b), (None, b), (7, c), (9, None), (9, None), (10, None), (5, b + " z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.dedup_stage(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(7, a), (5, b + " z"), (7, c), (9, None), (10, None)]))
