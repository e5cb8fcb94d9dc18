"""Language of web pages by fusing evidence.

* Text: naive Bayes over hashed byte trigrams of the page's visible text.  Counts come from all documents and
  their language column by grouped aggregation; per language there are ``BUCKETS`` of them, however large the
  corpus.  A page's log-likelihood counts as that of at most ``trust`` trigrams, since they depend on each other.
* Declared markup language and address suffix: how often pages that read as a language (posterior of the text
  alone) carry the value, smoothed with the value's overall share.
* Host prior: shares of the languages among the other pages of the host, smoothed with those of its domain,
  these with those of all pages.  A page's own reading is taken out of each count.

All counts are sums over groups, combined before the shuffle; a hot host is one row by then.  The tables of hosts,
domains, suffixes and declared values are joined back, never collected.

A page is read in one pass, so very long and hostile pages take time in proportion to their length; a comment, script or tag
that is not closed reaches to the end.

Results for odd input: null html is empty text, without a declaration; an address without a host has an empty one,
which is a host like any other; a page without any text goes by the other evidence; null and repeated ids are
rows like any other; documents without a language are not learned from; without any there is one language, null;
an empty table of pages gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wonted.llm.common import read, saved
from wonted.llm.hashing import BYTE_VALUES, FOLDED_VALUES, chunks, text_bytes
from wonted.llm.main_text import lines

BITS = 15
BUCKETS = 1 << BITS
VALUES = [np.roll(FOLDED_VALUES, 17 * i) ^ BYTE_VALUES[i] for i in range(3)]

HTML_TAG = re.compile(r"(?i)<html(?=[\s/>])")
META_TAG = re.compile(r"(?i)<meta(?=[\s/])")
LANG = re.compile(r"""(?i)(?<![\w:-])(?:xml:)?lang\s*+=\s*+["']?\s*+([a-z]++)""")
CONTENT = re.compile(r"""(?i)(?<![\w:-])content\s*+=\s*+["']?\s*+([a-z]++)""")


def grams(data: np.ndarray) -> np.ndarray:
    """Bucket of the byte trigram that starts at each byte but the last two."""
    h = VALUES[0][data[:-2]] + VALUES[1][data[1:-1]] + VALUES[2][data[2:]]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over the whole texts of all documents with a language."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in set(langs):
                counts = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for i in np.flatnonzero(langs == lang):
                    counts += np.bincount(grams(data[offsets[i] : offsets[i + 1]]), minlength=BUCKETS) if offsets[i + 1] - offsets[i] > 2 else 0
            if len(held) > 64:
                yield from emitted(held)
                held = {}
        yield from emitted(held)

    def emitted(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["lang", "bucket", "n"])

    rows = docs.filter("lang is not null").select(F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(work, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def gram_model(docs: DataFrame, alpha: float = 0.5) -> tuple[list[str], np.ndarray]:
    """The languages in order and log-probabilities, one row per language; bounded by languages times buckets."""
    found = gram_counts(docs).toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    counts = np.zeros((max(1, len(langs)), BUCKETS))
    if langs:
        row = np.searchsorted(langs, found.column("lang").to_numpy(zero_copy_only=False).astype(str))
        counts[row, found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return langs or [None], np.log((counts + alpha) / (counts + alpha).sum(1, keepdims=True))


def visible(html: str) -> str:
    """The page's text, character references decoded; one pass, linear in the length of the page."""
    return " ".join(x.text for x in lines(html))


def declared(html: str) -> str | None:
    """Language of the html element (lang or xml:lang), else of a content-language declaration in a meta element."""
    m = HTML_TAG.search(html)
    if m:
        end = html.find(">", m.end())
        found = LANG.search(html[m.end() : end if end >= 0 else len(html)])
        if found:
            return found[1].lower()
    at = 0
    while (m := META_TAG.search(html, at)) is not None and (end := html.find(">", m.end())) >= 0:
        tag, at = html[m.end() : end], end
        if "content-language" in tag.lower() and (found := CONTENT.search(tag)):
            return found[1].lower()
    return None


def read_pages(pages: DataFrame, model: tuple[list[str], np.ndarray], trust: float = 30.0) -> DataFrame:
    """page_id, host, domain, suffix, declared, ll (log-likelihood by language), reading (posterior of the text alone)."""
    table = model[1].T.copy()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lls, marks = [], []
            for html in batch.column(2):
                html = html.as_py()
                marks.append(declared(html))
                g = grams(np.frombuffer(visible(html).encode(), np.uint8)) if len(html) > 2 else np.zeros(0, np.int64)
                lls.append(table[g].sum(0) * min(1.0, trust / max(1, len(g))))
            ll = np.array(lls).reshape(-1, table.shape[1])
            p = np.exp(ll - ll.max(1, keepdims=True)) if len(ll) else ll
            p = p / p.sum(1, keepdims=True)
            arrays = [batch.column(0), batch.column(1), pa.array(marks, pa.string()), pa.array(list(ll), pa.list_(pa.float64())), pa.array(list(p), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "host", "declared", "ll", "reading"])

    address = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("host")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host, F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    found = rows.mapInArrow(work, "page_id long, host string, declared string, ll array<double>, reading array<double>")
    labels = F.split("host", r"\.")
    return found.withColumn("suffix", F.element_at(labels, -1)).withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))


def _sums(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Pages per language and value of ``key``: an array named like the key with _n."""
    total = F.array(*[F.sum(F.col("reading")[i]) for i in range(n)])
    return rows.groupBy(key).agg(total.alias(f"{key}_n"))


def _joined(rows: DataFrame, key: str, n: int) -> DataFrame:
    sums = _sums(rows, key, n).withColumnRenamed(key, "key_")
    return rows.join(sums, rows[key].eqNullSafe(sums["key_"])).drop("key_")


def fused(pages: DataFrame, model: tuple[list[str], np.ndarray], alpha: float = 1.0, weight: float = 4.0) -> DataFrame:
    """page_id, lang, score (posterior), text_lang, declared, host."""
    langs, n = model[0], len(model[0])
    rows = saved(read_pages(pages, model))
    spread = rows
    for key in ("declared", "suffix", "domain", "host"):
        spread = _joined(spread, key, n)
    whole = rows.agg(F.array(*[F.coalesce(F.sum(F.col("reading")[i]), F.lit(0.0)) for i in range(n)]).alias("all_n"))
    spread = spread.join(F.broadcast(whole))  # one row

    def at(name: str, i: int) -> Column:
        """Count without the page's own reading, never below zero."""
        return F.greatest(F.col(name)[i] - F.col("reading")[i], F.lit(0.0))

    def total(name: str) -> Column:
        return F.greatest(sum((F.col(name)[j] for j in range(n)), F.lit(0.0)) - 1, F.lit(0.0))

    def log_posterior(i: int) -> Column:
        general = (at("all_n", i) + alpha) / (total("all_n") + alpha * n)
        domain = (at("domain_n", i) + weight * general) / (total("domain_n") + weight)
        prior = (at("host_n", i) + weight * domain) / (total("host_n") + weight)
        out = F.col("ll")[i] + F.log(prior)
        for mark in ("declared", "suffix"):  # share of the value among pages of the language
            overall = (total(f"{mark}_n") + alpha) / (total("all_n") + alpha * n)
            out = out + F.log((at(f"{mark}_n", i) + alpha * overall) / (at("all_n", i) + alpha))
        return out

    logs = F.array(*[log_posterior(i) for i in range(n)])
    names = F.array(*[F.lit(x).cast("string") for x in langs])
    result = spread.select("page_id", "host", "declared", "reading", logs.alias("logs"))
    top = F.array_position("logs", F.array_max("logs")).cast("int")
    score = F.expr("1 / aggregate(logs, double(0), (a, x) -> a + exp(x - array_max(logs)))")
    text_top = F.array_position("reading", F.array_max("reading")).cast("int")
    return result.select("page_id", names[top - 1].alias("lang"), score.alias("score"), names[text_top - 1].alias("text_lang"), "declared", "host")


def query(spark, folder: str) -> DataFrame:
    return fused(read(spark, folder, "pages"), gram_model(read(spark, folder, "documents")))
