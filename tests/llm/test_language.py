import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.llm import language


def test_trigrams_stay_within_texts():
    codes, sizes = language.trigram_buckets(["abcd", None, "", "ab", "ABC", "xyz"])
    assert sizes.tolist() == [2, 0, 0, 0, 1, 1] and len(codes) == 4
    assert codes[0] == codes[2]
    assert language.trigram_buckets([None, ""])[0].tolist() == []


def brute(rows, languages, chances):
    """Posteriors by plain loops. rows: (text, declared, host, suffix)."""
    logs = []
    for text, *_ in rows:
        codes, _ = language.trigram_buckets([text])
        logs.append(language.TEMPER * chances.astype(np.float32)[codes].astype(float).sum(axis=0))
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    p = np.array([soft(x) for x in logs])
    n, out = len(languages), []
    kinds = len({r[1] for r in rows})
    for i, (_, d, h, s) in enumerate(rows):
        others = [j for j in range(len(rows)) if j != i]
        part = lambda test: p[[j for j in others if test(rows[j])]].sum(axis=0)
        of_all, of_s, of_h, of_d = part(lambda r: True), part(lambda r: r[3] == s), part(lambda r: r[2:] == (h, s)), part(lambda r: r[1] == d)
        overall = (of_all + 1) / (len(rows) - 1 + n)
        suffix = (of_s + language.PULL * overall) / (of_s.sum() + language.PULL)
        host = (of_h + language.PULL * suffix) / (of_h.sum() + language.PULL)
        out.append(soft(logs[i] + np.log(host) + np.log((of_d + 1) / (of_all + kinds + 1))))
    return np.array(out)


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return language.fit(docs)


def test_posteriors_equal_brute_force(spark, model):
    rows = [("the", "en", "h1", "com"), ("und der", "de", "h1", "com"), ("de la", None, "h2", "fr"), ("de", "fr", "h2", "fr"), ("le la les des", "fr", "h2", "fr"), (None, "fr", "h2", "fr"), ("", None, None, None), ("x", "xx", None, "com"), ("the of and", "de", "h3", "com"), ("the of and", "de", "h3", "com")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, declared string, host string, suffix string")
    got = language.identify(df, *model).toPandas().sort_values("doc_id")
    want = brute(rows, *model)
    assert np.allclose(got.posterior, want.max(axis=1), rtol=1e-6)
    assert got.language.tolist() == [model[0][k] for k in want.argmax(axis=1)]
    assert not got.kept.iloc[6]
    assert language.identify(df.limit(0), *model).count() == 0


def test_foreign_text_is_rejected_and_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(language.document_evidence(docs).withColumn("declared", F.lit(None).cast("string")), *model)
    both = got.select("doc_id", "language", "kept", "n_trigrams").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    long = both[both.n_trigrams > 50]
    assert (long.language == long.lang).mean() > 0.99 and long.kept.mean() > 0.99
    odd = spark.createDataFrame([(1, "漢字仮名交じり文" * 80, None, None, None)], "doc_id long, text string, declared string, host string, suffix string")
    assert not language.identify(odd, *model).first().kept


def test_unlabelled_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some text", None, "a.de", 5, "q")], "doc_id long, text string, lang string, source string, host int, language string")
    out = language.identify_documents(docs)
    assert out.columns == [*docs.columns, "_language", "_kept"] and not out.first()._kept
    labelled = spark.createDataFrame([(k, "some text of words", "en", "a.de", 5, "q") for k in range(5)] + [(9, None, "en", None, 1, None)], docs.schema)
    rows = language.identify_documents(labelled).collect()
    assert len(rows) == 6 and all(r._kept and r._language == "en" and r.language in ("q", None) for r in rows)


def test_markup_evidence(spark):
    html = "<!DOCTYPE html><html class=x LANG='De-at'><script>var t = '<p>no</p>'</script><p>ja <b>und</b> nein</p><!-- no --></html>"
    pages = spark.createDataFrame([(1, "HTTPS://user@News.Example.AT:80/x?y", html, "t"), (2, None, None, "t"), (3, "no url", "plain", "t")], "page_id long, url string, html string, text string")
    got = language.markup_evidence(pages).collect()
    assert got[0][1].split() == ["ja", "und", "nein"] and got[0][2:] == ("de", "news.example.at", "at")
    assert got[1][1:] == (None, None, None, None) and got[2][2:] == (None, None, None)


def test_query_covers_documents_and_pages(spark):
    sf = "/root/testdata/sf0.001"
    got = language.op10_bayesian_language(spark, sf).toPandas()
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)', 1).alias("lang")).toPandas()
    of_pages = got[got.page_id.notna()].merge(pages, on="page_id")
    assert len(of_pages) == len(pages) and (got.doc_id.notna() ^ got.page_id.notna()).all()
    named = of_pages[of_pages.lang != ""]
    assert (named.declared == named.lang).all() and (named.language == named.lang).mean() > 0.8
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(got.doc_id.dropna()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_rare_labels_have_models_or_stand(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 20)
    rows = [(k, f"the words of an english text number {k} and more of the same words", "en", "s") for k in range(400)] + [(1000 + k, "漢字仮名交じり文" * 80 + str(k), "JA", "s") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert language.fit(docs)[0] == ["en", "ja"]
    for most in (64, 1):
        monkeypatch.setattr(language, "LANGUAGES", most)
        got = language.identify_documents(docs).where("doc_id >= 1000").collect()
        assert [(r._language, r._kept) for r in got] == [("ja", True)] * 3
