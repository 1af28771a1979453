"""Language ID by Bayesian evidence fusion.

Four kinds of evidence on a document's language are multiplied: the likelihood of its text under each language's
byte-trigram model; the language it declares, by how often documents of each language declare it; and a prior by its
host, smoothed towards the prior of its address suffix, itself smoothed towards that of all documents. The priors and
the declarations' reliability are sums of text posteriors over all documents, by grouped aggregation; each document's
own part is taken out of its prior, so that no document confirms itself.

The trigram models are fitted on a bounded sample of labelled rows (about SAMPLE of each language, those with the least
hash; all where there are fewer); everything else covers all rows and whole texts. A document whose label has no model
keeps its label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, text_batches, worker_memory

#: Labelled rows of a language that its text model is fitted on, about, at most; buckets of trigrams; languages with a model, at most (the most
#: frequent ones; two-letter codes are 183). It bounds the model; documents with another label keep that.
SAMPLE, BUCKETS, LANGUAGES = 1000, 1 << 16, 256
#: Power of the text likelihood (trigrams are not independent), and weight of the next wider prior in documents.
TEMPER, PULL = 0.3, 10.0
#: A text of so many trigrams that every language makes less likely than evenly drawn buckets is in none of them.
ENOUGH = 200


def trigram_buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all lower-cased byte trigrams of the texts, and how many each text has."""
    data = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([max(0, len(d) - 2) for d in data])
    b = np.frombuffer(b"".join(d for d in data if len(d) > 2), np.uint8).astype(np.uint32)
    if not len(b):
        return np.zeros(0, np.int64), sizes
    codes = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(16)
    own = np.ones(len(b), bool)
    ends = np.cumsum(sizes[sizes > 0] + 2)
    own[ends - 1] = own[ends - 2] = False
    return codes[own[: len(codes)]].astype(np.int64), sizes


def fit(docs: DataFrame, label: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, in lower case, and log chances (BUCKETS, languages), from about SAMPLE labelled rows of each at most, of
    whole texts; equal rows count once."""
    labelled = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull()).select(F.xxhash64("doc_id", "text").alias("h"), F.lower(label).alias(label), "text")
    sizes = labelled.groupBy(label).agg(F.approx_count_distinct("h", 0.02).alias("n")).orderBy(F.desc("n"), label).limit(LANGUAGES).collect()
    if not sizes:
        return [], np.zeros((BUCKETS, 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            codes, sizes = trigram_buckets(batch.column(1).to_pylist())
            per = np.repeat(langs, sizes)
            for one in np.unique(langs):
                k, n = np.unique(codes[per == one], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(k), pa.string()), pa.array(k), pa.array(n.astype(np.int64))], ["lang", "k", "n"])

    share = F.create_map(*(F.lit(x) for r in sizes for x in (r[label], SAMPLE / r["n"] if r["n"] > SAMPLE else 2.0)))
    drawn = labelled.where(F.col("h").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52)) < share[F.col(label)])
    sample = drawn.groupBy(label, "h").agg(F.first("text").alias("text")).select(label, "text")
    top = [r[label] for r in sizes]
    # LANGUAGES * BUCKETS rows at most
    got = sample.mapInArrow(count, "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(top)
    counts = np.full((BUCKETS, len(languages)), 0.1)
    counts[got["k"].to_numpy(np.int64), got["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)] += got["n"].to_numpy()
    return languages, np.log(counts / counts.sum(axis=0))


def _likelihoods(rows: DataFrame, chances: np.ndarray) -> DataFrame:
    """rows (…, text) without text, with n_trigrams and loglik, an array by language."""
    sent = rows.sparkSession.sparkContext.broadcast(chances.astype(np.float32))
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("language")
        table = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                codes, sizes = trigram_buckets(part.column(len(names)).to_pylist())
                sums = np.zeros((part.num_rows, table.shape[1]))
                full = np.flatnonzero(sizes)
                if len(full):
                    starts = np.cumsum(sizes[full]) - sizes[full]
                    for k in range(table.shape[1]):
                        sums[full, k] = np.add.reduceat(table[:, k][codes].astype(np.float64), starts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * table.shape[1]), pa.array(sums.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(sizes.astype(np.int64)), lists], [*names, "n_trigrams", "loglik"])

    types = dict(rows.dtypes)
    return rows.select(*names, "text").mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names) + ", n_trigrams long, loglik array<double>")


def _posterior(rows: DataFrame, logs: Column, to: str) -> DataFrame:
    """rows with the posteriors of an array of log weights."""
    rows = rows.withColumn("_logs", logs).withColumn("_top", F.array_max("_logs"))
    rows = rows.withColumn("_powers", F.transform("_logs", lambda x: F.exp(x - F.col("_top"))))
    rows = rows.withColumn("_all", F.aggregate("_powers", F.lit(0.0), lambda a, x: a + x))
    return rows.withColumn(to, F.transform("_powers", lambda x: x / F.col("_all"))).drop("_logs", "_top", "_powers", "_all")


def identify(rows: DataFrame, languages: list[str], chances: np.ndarray) -> DataFrame:
    """rows: text, declared, host, suffix (each may be null) and others, which must not start with an underscore. Returns
    the others with declared, language, posterior, n_trigrams, mean_loglik (a trigram's, under the language) and kept.

    A row is kept unless it has no trigram of text and declares no known language, or its best posterior is below 0.5,
    or a text of ENOUGH trigrams is in no language. Without languages nothing is kept. Null host, suffix and
    declaration are values of their own; repeated rows are judged each; an empty table gives no rows.
    """
    ids = [c for c in rows.columns if c not in ("text", "declared", "host", "suffix")]
    if not languages:
        return rows.select(*ids, "declared", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("posterior"), F.lit(0).cast("long").alias("n_trigrams"), F.lit(None).cast("double").alias("mean_loglik"), F.lit(False).alias("kept"))
    scored = materialise(_scored(rows, chances), "likelihoods")
    return _fused(scored, ids, languages, _priors(scored, len(languages)))


def _scored(rows: DataFrame, chances: np.ndarray) -> DataFrame:
    """rows without text, with the text's log likelihoods and posteriors, and evidence without nulls."""
    ids = [c for c in rows.columns if c not in ("text", "declared", "host", "suffix")]
    known = lambda c, out: F.coalesce(F.col(c), F.lit("\0")).alias(out)
    scored = _likelihoods(rows.select(*ids, "declared", known("declared", "_d"), known("host", "_h"), known("suffix", "_s"), "text"), chances)
    return _posterior(scored, F.transform("loglik", lambda x: x * TEMPER), "_p")


def _priors(scored: DataFrame, n: int) -> tuple:
    """Text posteriors summed by host, suffix, declaration and over all, and the number of declarations."""
    sums = lambda to: F.array(*(F.sum(F.get("_p", F.lit(k))) for k in range(n))).alias(to)
    again = lambda c, to: F.array(*(F.sum(F.get(c, F.lit(k))) for k in range(n))).alias(to)
    # written out, as their sizes then decide how they are joined
    by_host = materialise(scored.groupBy("_s", "_h").agg(sums("_host")), "hosts")
    by_suffix = materialise(by_host.groupBy("_s").agg(again("_host", "_suffix")), "suffixes")
    by_declared = materialise(scored.groupBy("_d").agg(sums("_declares")), "declarations")
    whole = by_suffix.agg(again("_suffix", "w")).first()["w"]
    whole = [x or 0.0 for x in whole]
    return by_host, by_suffix, by_declared, whole, by_declared.count()


def _fused(scored: DataFrame, ids: list[str], languages: list[str], priors: tuple) -> DataFrame:
    n = len(languages)
    by_host, by_suffix, by_declared, whole, kinds = priors
    at = lambda c, k: F.get(F.col(c), k)
    full = scored.join(by_host, ["_s", "_h"]).join(by_suffix, "_s").join(by_declared, "_d")
    of_all = F.array(*map(F.lit, whole))

    def log_weight(k: Column) -> Column:
        own = at("_p", k)
        less = lambda c: F.greatest(at(c, k) - own, F.lit(0.0))
        size = lambda c: F.greatest(F.aggregate(c, F.lit(-1.0), lambda a, x: a + x), F.lit(0.0))
        rest = F.greatest(F.get(of_all, k) - own, F.lit(0.0))
        overall = (rest + 1.0) / F.lit(max(0.0, sum(whole) - 1.0) + n)
        suffix = (less("_suffix") + PULL * overall) / (size("_suffix") + PULL)
        host = (less("_host") + PULL * suffix) / (size("_host") + PULL)
        declares = (less("_declares") + 1.0) / (rest + F.lit(float(kinds + 1)))
        return at("loglik", k) * TEMPER + F.log(host) + F.log(declares)

    fused = _posterior(full, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), log_weight), "_q")
    out = fused.withColumn("posterior", F.array_max("_q")).withColumn("_at", (F.array_position("_q", F.col("posterior")) - 1).cast("int"))
    out = out.withColumn("mean_loglik", F.get("loglik", F.col("_at")) / F.nullif(F.col("n_trigrams"), F.lit(0)))
    evidence = (F.col("n_trigrams") > 0) | F.coalesce(F.col("declared").isin(languages), F.lit(False))
    foreign = (F.col("n_trigrams") >= ENOUGH) & (F.coalesce(F.col("mean_loglik"), F.lit(0.0)) < -float(np.log(BUCKETS)))
    kept = (F.col("posterior") >= 0.5) & evidence & ~foreign
    return out.select(*ids, "declared", F.get(F.array(*map(F.lit, languages)), F.col("_at")).alias("language"), "posterior", "n_trigrams", "mean_loglik", kept.alias("kept"))


def markup_evidence(pages: DataFrame) -> DataFrame:
    """Evidence of web pages (…, url, html): text without tags and scripts, the lang attribute, host and suffix.

    Null or malformed url or html give null evidence.
    """
    bare = F.regexp_replace(F.regexp_replace("html", "(?is)<(script|style)[^>]*>.*?</\\1>|<!--.*?-->", " "), "<[^>]*>", " ")
    blank = lambda c: F.nullif(c, F.lit(""))
    host = blank(F.lower(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)))
    declared = blank(F.lower(F.regexp_extract("html", "(?is)<html[^>]*?\\blang\\s*=\\s*[\"']?([a-z]+)", 1)))
    others = [c for c in pages.columns if c not in ("html", "url", "text", "declared", "host", "suffix")]
    return pages.select(*others, bare.alias("text"), declared.alias("declared"), host.alias("host"), F.substring_index(host, ".", -1).alias("suffix"))


def _document_evidence() -> list[Column]:
    suffix = F.when(F.col("source").contains("."), F.lower(F.substring_index("source", ".", -1)))
    return [F.col("text"), F.lower("lang").alias("declared"), F.col("source").alias("host"), suffix.alias("suffix")]


def document_evidence(docs: DataFrame) -> DataFrame:
    """Evidence of documents: their text, `lang` as what they declare and `source` as host; a source has no address suffix
    unless it is written like a host name."""
    return docs.select("doc_id", *_document_evidence())


def _labels_kept(found: DataFrame, languages: list[str]) -> DataFrame:
    """found of documents; those that declare a language without a model, which no text can deny, are kept with it."""
    own = F.coalesce(F.col("declared").isNotNull() & ~F.col("declared").isin(languages), F.lit(False))
    changed = {"language": F.when(own, F.col("declared")).otherwise(F.col("language")), "kept": own | F.col("kept")}
    return found.withColumns(changed | {c: F.when(~own, F.col(c)) for c in ("posterior", "mean_loglik")})


def identify_documents(docs: DataFrame) -> DataFrame:
    """All columns of documents, with _language and _kept. Columns of any names pass through."""
    text_batches(docs.sparkSession)
    held = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*(F.col(c).alias(h) for c, h in zip(docs.columns, held, strict=True)), *_document_evidence())
    languages, chances = fit(docs)
    if languages:  # priors from the narrow evidence; texts are then scored once more, on their way through
        priors = _priors(materialise(_scored(docs.select(*_document_evidence()), chances), "likelihoods"), len(languages))
        found = _fused(_scored(rows, chances), held, languages, priors)
    else:
        found = identify(rows, languages, chances)
    found = _labels_kept(found, languages)
    return found.select(*(F.col(h).alias(c) for c, h in zip(docs.columns, held, strict=True)), F.col("language").alias("_language"), F.col("kept").alias("_kept"))


def op10_bayesian_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (doc_id) and web pages (page_id), by the models of the labelled documents. Priors are those of either
    table: a document's label and a page's markup are not equally reliable."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = fit(docs)
    of_pages = identify(markup_evidence(pages), *model)
    return _labels_kept(identify(document_evidence(docs), *model), model[0]).unionByName(of_pages, allowMissingColumns=True)
