"""Main text of pages: pages with a known article, odd and hostile markup."""

import html
import re
import time

import pyarrow.parquet as pq
import pytest
from cases import CLASHING, plain
from pyspark.sql import functions as F

from wonted.llm import main_text as mt

LONG = "This sentence of the article is long enough to count as running text, with several clauses, and it ends here."
SCHEMA = "page_id long, url string, html string"


def by_rule(page):
    """The test pages declare their article: its text, cut at block tags."""
    article = re.search(r"(?s)<article>(.*?)(</article>|$)", page)[1]
    cut = (" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]*>", re.sub("</?b>", "", article)))
    return "\n".join(x for x in cut if x)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_whole_table_equals_the_declared_article(spark, folder):
    got = {r["page_id"]: r for r in mt.query(spark, f"/root/testdata/{folder}").collect()}
    rows = pq.read_table(f"/root/testdata/{folder}/pages.parquet").to_pylist()
    assert len(got) == len(rows)
    for r in rows:
        want = by_rule(r["html"])
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])


def soup(title="A heading"):
    menu = "".join(f"<div><a href='/{i}'>Section number {i} of the site</a></div>" for i in range(12))
    body = f"<div>{title}</div><div>{LONG} One.</div><div>Short.</div><div>{LONG} Two &amp; <i>more</i>.</div><div>{LONG} Three.</div>"
    tail = "".join(f"<div><a href=/{i}>Other story {i}</a></div>" for i in range(9)) + "<div>© 2020 somebody. All rights reserved.</div>"
    return f"<html><body>{menu}{body}{tail}</body></html>", f"{title}\n{LONG} One.\nShort.\n{LONG} Two & more.\n{LONG} Three."


def test_without_any_declaration_the_distribution_decides():
    page, want = soup()
    assert mt.main_text(page) == want


def test_surge_and_dive():
    assert mt.between([0, 0, 0, 0, 100, 5, 90, 0, 0, 0, 0, 8]) == [(4, 7)]
    assert mt.between([90, 0, 0, 0, 0, 0, 95]) == [(0, 1), (6, 7)]
    assert mt.between([900, 0, 0, 0, 0, 0, 95]) == [(0, 1)]
    assert mt.between([3, 4]) == [(0, 2)] and mt.between([0, 0]) == [] and mt.between([]) == []


@pytest.mark.parametrize(
    "noise",
    [
        "<nav><ul><li><a href=/x>menu</a> NOISE</li></ul></nav>", "<header><h2>NOISE</h2></header>", f"<footer>NOISE {LONG}</footer>", f"<aside>NOISE {LONG}</aside>",
        f"<div class='cookie-notice'><p>NOISE {LONG}</p></div>", f'<div id="ad-top">NOISE {LONG}</div>', f"<form>NOISE {LONG}<select><option>NOISE</select></form>",
        f"<script>var x = '<p>NOISE {LONG}</p>';</script>", f"<STYLE>p {{ }} NOISE {LONG}</STYLE >", f"<!-- NOISE <p>{LONG}</p> -->", f"<section id=comments><article><p>NOISE {LONG}</p></article></section>",
        f"<ol class=commentlist><li>NOISE {LONG}</ol>", f"<div role=complementary>NOISE {LONG}</div>", "<button>NOISE</button>", f"<noscript>NOISE {LONG}</noscript>", f"<div hidden>NOISE {LONG}</div>",
    ],
)
@pytest.mark.parametrize("holder", ["article", "main", "div class=content", "div"])
def test_noise_before_within_and_after(noise, holder):
    inner = f"<h1>The title</h1><p>{LONG} &lt;1&gt;<p>{LONG}  <b>two</b>\n&nbsp; words{noise}<p>{LONG} 3."
    page = f"<body>{noise}<{holder}>{inner}</{holder.split()[0]}>{noise}</body>"
    assert mt.main_text(page) == f"The title\n{LONG} <1>\n{LONG} two words\n{LONG} 3."


def test_article_header_keeps_its_title():
    page = f"<body><header><h1>Site</h1></header><article><header><h1>Title</h1><p>By somebody</p></header><p>{LONG}</p></article></body>"
    assert mt.main_text(page) == f"Title\n{LONG}"
    assert mt.main_text("<article><p>tiny</article>") == "tiny" and mt.main_text("<p>tiny</p><p>page") == "tiny\npage"
    assert mt.main_text(f"<body class='has-sidebar'><div class='has-sidebar'><p>{LONG}</p></div>") == LONG
    assert mt.main_text(f"<nav><ul><li><a>x</a><article><p>{LONG}</article>") == LONG


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("   ", ""), ("plain words only", "plain words only"), ("a < b & c", "a < b & c"), ("<p>1<br>2<br><br>3</p>", "1 2\n3"), ("<p>x</p", "x"), ("<p title='a>b'>x</p>", "x"),
        ("<p>caf&eacute; &#233;&#xE9; &#99999999999; &#0000000000065; &nosuch; &amp;lt;</p>", "café éé � A &nosuch; &lt;"), ("</p></div>x", "x"), ("<p>one<!-- open", "one"), ("<script>never closed <p>x", ""),
        ("<p>a</p>\r\n<P>B</P>", "a\nB"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), (" <p> a 　b\t</p>", "a b"),
    ],
)
def test_odd_pages(page, want):
    assert mt.main_text(page) == want


@pytest.mark.parametrize("unit", ["<script>", "<!--", "<html ", "<a '>", "<a \"'>", "<p>x", "<div>", "</div>", "<b ", "<x><", "<nav><article>", "<style>a</style", "<p><li>", "&#9", "&", "<div class='"])
def test_hostile_pages_take_linear_time(unit):
    def seconds(size):
        page = unit * (size // len(unit) + 1)
        start = time.process_time()
        mt.main_text(page)
        return time.process_time() - start

    assert seconds(1_000_000) < 8 and mt.main_text("&#" + "9" * 200_000 + ";") == "�"


def test_tables(spark):
    page, want = soup()
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "<p>" + "word " * 400_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = sorted([(1, "u", want), (1, "u", want), (2, None, ""), (None, "v", ""), (3, "w", ("word " * 400_000).strip())], key=repr)
    assert plain(mt.extract(df)) == expected
    assert plain(mt.extract(df.select("*", *[F.lit("other").alias(c) for c in CLASHING if c != "text"], F.lit("t").alias("text")))) == expected
    assert plain(mt.extract(spark.createDataFrame([], SCHEMA))) == []
