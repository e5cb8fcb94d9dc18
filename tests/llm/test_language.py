"""Language of pages: against plain Python, and against what the pages declare."""

import time
from collections import defaultdict

import numpy as np
import pytest
from cases import CLASHING, SCHEMA, plain
from pyspark.sql import functions as F

from wonted.llm import language
from wonted.llm.common import read

PAGES = "page_id long, url string, html string"


def documents(spark):
    rows = [(1, "the cat and the dog and the bird in the house", "en", "s", 1), (2, "le chat et le chien et les oiseaux dans la maison", "fr", "s", 1)]
    rows += [(3, None, "fr", None, None), (4, "", "en", "", 0), (5, "der Hund", None, None, None), (None, "the house", "en", None, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def page_rows():
    rows = [(i, f"https://{'www' if i % 2 else 'm'}.site{i % 3}.example.{'fr' if i % 3 else 'com'}/x?y", f"<html lang='{'FR-ca' if i % 3 else 'en'}'><style>p{{}}</style><p>{'le chien dans la maison' if i % 3 else 'the dog in the house'} <!-- the --></p>") for i in range(30)]
    rows += [(40, None, None), (41, "", ""), (42, "no host", "<p>la"), (43, "//user@Host.Example.FR:80/a", "<html LANG=fr><p>the cat</p><script>the the the</script>"), (None, "http://a.fr", "x"), (44, "http://a.fr", "the " * 20_000)]
    return rows + [rows[3]] * 4


def brute(rows, model, trust=30.0, alpha=1.0, weight=4.0):
    langs, table = model
    n, pages = len(langs), []
    for i, url, html in rows:
        html, url = html or "", url or ""
        host = url.split("//", 1)[1].split("/")[0].split("?")[0].split("@")[-1].split(":")[0].lower() if "//" in url else ""
        raw = language.visible(html).encode()
        g = language.grams(np.frombuffer(raw, np.uint8)) if len(html) > 2 else []
        ll = sum((table[:, x] for x in g), np.zeros(n)) * min(1, trust / max(1, len(g)))
        p = np.exp(ll - ll.max())
        parts = host.split(".")
        pages.append((i, host, ".".join(parts[-2:]), parts[-1], language.declared(html), ll, p / p.sum()))
    sums = [defaultdict(lambda: np.zeros(n)) for _ in range(5)]
    for _, host, domain, suffix, mark, _, p in pages:
        for s, key in zip(sums, (host, domain, suffix, mark, "all")):
            s[key] += p
    out = []
    for i, host, domain, suffix, mark, ll, p in pages:
        own = [np.maximum(s[k] - p, 0) for s, k in zip(sums, (host, domain, suffix, mark, "all"))]
        count = [max(s[k].sum() - 1, 0) for s, k in zip(sums, (host, domain, suffix, mark, "all"))]
        general = (own[4] + alpha) / (count[4] + alpha * n)
        prior = (own[0] + weight * (own[1] + weight * general) / (count[1] + weight)) / (count[0] + weight)
        logs = ll + np.log(prior)
        for j in (2, 3):
            logs = logs + np.log((own[j] + alpha * (count[j] + alpha) / (count[4] + alpha * n)) / (own[4] + alpha))
        q = np.exp(logs - logs.max())
        out.append((i, langs[int(logs.argmax())], 1 / q.sum(), host, mark))
    return sorted(out, key=repr)


def test_entities_declarations_and_hostile_pages():
    assert language.visible("<p>caf&eacute; &amp; th&#233;</p><script>x</script>") == "café & thé"
    cases = {
        "<html xml:lang='pt-BR'>": "pt", "<HTML class=x data-lang=zz LANG = de>": "de", "<html data-lang='xx'><p>": None, "<html": None, "": None,
        "<html><meta http-equiv='Content-Language' content='it'>": "it", "<htmlx lang=fr>": None, "<html lang=en><meta http-equiv=content-language content=fr>": "en",
    }
    assert {h: language.declared(h) for h in cases} == cases
    for unit in ("<script>", "<!--", "<html ", "<meta ", "<html lang", "<p>x", "&amp", "<style>a</style"):
        page = unit * (1_000_000 // len(unit))
        start = time.process_time()
        language.visible(page), language.declared(page)
        assert time.process_time() - start < 8


@pytest.fixture(scope="module")
def model(spark):
    return language.gram_model(documents(spark))


def test_counts_cover_whole_texts(spark):
    counts = language.gram_counts(documents(spark)).groupBy("lang").agg(F.sum("n")).collect()
    assert dict(map(tuple, counts)) == {"en": 43 + 7, "fr": 47}


def test_fusion_against_plain_python(spark, model):
    got = language.fused(spark.createDataFrame(page_rows(), PAGES).repartition(3), model)
    got = sorted(((r["page_id"], r["lang"], r["score"], r["host"], r["declared"]) for r in got.collect()), key=repr)
    want = brute(page_rows(), model)
    key = lambda r: (repr(r[0]), r[3], repr(r[4]))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[0] == w[0] and g[1] == w[1] and g[3:] == w[3:] and g[2] == pytest.approx(w[2], abs=1e-9)


def test_odd_tables(spark, model, folder_of):
    df = spark.createDataFrame(page_rows(), PAGES)
    wide = df.select("*", *[F.lit("x").alias(c) for c in (*CLASHING, "host", "lang", "declared", "reading")])
    assert plain(language.fused(wide, model).select("page_id", "lang")) == plain(language.fused(df, model).select("page_id", "lang"))
    assert plain(language.fused(df.limit(0), model)) == []
    none = language.query(spark, folder_of(pages=df, documents=documents(spark).limit(0))).collect()
    assert len(none) == len(page_rows()) and {r["lang"] for r in none} == {None}


def test_agrees_with_declared_languages(spark):
    rows = language.query(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == read(spark, "/root/testdata/sf0.01", "pages").count()
    known = [r for r in rows if r["declared"] in ("en", "fr", "de", "es")]
    assert np.mean([r["lang"] == r["declared"] for r in known]) >= 0.95
