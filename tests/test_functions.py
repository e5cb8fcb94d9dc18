"""Scalar goldens."""

import random

import pytest
from brute import osa
from pyspark.sql import functions as F

from wonted.functions import domains as dm
from wonted.functions import stats as st
from wonted.functions import text as tx
from wonted.functions.domains import SuffixRules
from wonted.functions.position import id_of, position, time_of


def values(spark, inputs, *expressions):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    out = df.select("i", *[F.expr(e) if isinstance(e, str) else e for e in expressions]).orderBy("i")
    rows = [tuple(r)[1:] for r in out.collect()]
    return [r[0] for r in rows] if len(expressions) == 1 else rows


def test_normalize_address(spark):
    cases = {
        "Otto+tag@Example.COM": "otto@example.com",
        "o.t.to+x@gmail.com": "otto@gmail.com",
        "o.tto@fastmail.com": "o.tto@fastmail.com",
        " <A.B@GoogleMail.com> ": "ab@googlemail.com",
        "a.b@mail.gmail.com": "ab@mail.gmail.com",
        "x@.host.org.": "x@host.org",
        "no-at-sign": "no-at-sign",
        "odd@name@host.org": "odd@name@host.org",
    }
    assert values(spark, cases, tx.normalize_address("x")) == list(cases.values())


def test_registrable_domain_by_the_built_in_rules(spark):
    cases = {
        "mail.example.co.uk": "example.co.uk",
        "a.b.example.com": "example.com",
        "localhost": "localhost",
        "192.168.0.1": "192.168.0.1",
        "co.uk": "co.uk",
        " .WWW.Example.ORG. ": "example.org",
        "shop.example.com.au": "example.com.au",
        "printer.local": "printer.local",
        "xn--a.xn--p1ai": "xn--a.xn--p1ai",
        "münchen.städte.de": "städte.de",
        "": "",
    }
    assert values(spark, cases, dm.reg_domain("x")) == list(cases.values())


def test_registrable_domain_by_a_list(spark, tmp_path):
    path = tmp_path / "list.dat"
    path.write_text(
        "// comment\ncom\nuk\nco.uk\n*.ck\n!www.ck\na.b.c.com\n// ===BEGIN PRIVATE DOMAINS===\nblog.com\n"
    )
    rules = SuffixRules.from_file(spark, str(path), "t1")
    cases = {
        "x.y.co.uk": "y.co.uk",
        "x.y.uk": "y.uk",
        "shop.any.ck": "shop.any.ck",
        "a.shop.any.ck": "shop.any.ck",
        "any.ck": "any.ck",
        "a.www.ck": "www.ck",
        "me.blog.com": "blog.com",
        "q.z.a.b.c.com": "z.a.b.c.com",
        "x.y.unknown": "x.y.unknown",
    }
    assert values(spark, cases, dm.reg_domain("x", rules)) == list(cases.values())


def test_skeleton_folds_lookalikes(spark):
    texts = ["micros0ft.com", "microsoft.com", "pаypal.com", "Ångström", "ⅰBM", "exampel", "ﬁne Straße"]
    got = values(spark, texts, tx.skeleton("x"))
    assert got == ["microsoft.com", "microsoft.com", "paypal.com", "angstrom", "ibm", "exampel", "fine straße"]


def test_display_names(spark):
    texts = ['  "Mira   Holt" ', "Straße", "a\t b", '" "']
    assert values(spark, texts, tx.normalize_display_name("x")) == ["mira holt", "strasse", "a b", ""]
    assert values(spark, texts[:1], tx.display_name_ascii("x")) == ["mira holt"]


def test_osa_distance_against_brute_force(spark):
    r = random.Random(5)
    pairs = [("north-ford", "north-f0rd"), ("exampel", "example"), ("abcdef", "uvwxyz"), ("ca", "abc"), ("", "ab")]
    for _ in range(300):
        a = "".join(r.choice("abc") for _ in range(r.randint(0, 7)))
        b = list(a)
        for _ in range(r.randint(0, 3)):
            i = r.randint(0, len(b))
            b[i:i + r.randint(0, 2)] = r.choice(["", "a", "b", "c", "ba", "cb"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(F.expr(tx.osa_distance("a", "b"))).collect()]
    assert got == [min(osa(a, b), 3) for a, b in pairs]


def test_links_keep_domains_only(spark):
    text = (
        "see https://files.dropbox-share.net/dl/EVIL?token=secret123 and "
        "HTTP://example.com/page also https://sub.example.com/x <a href='http://u:p@10.0.0.1:80/'>"
    )
    assert values(spark, [text], dm.link_domain_list("x")) == [
        ["dropbox-share.net", "example.com", "example.com", "10.0.0.1"]
    ]


def test_freemail(spark):
    assert values(spark, ["gmail.com", "homestead.com"], dm.is_freemail("x")) == [True, False]


def test_header_fields(spark):
    header = "mx.org; SPF = SoftFail smtp; dkim=fail; dkim=pass; dmarc=none"
    assert values(spark, [header], *[tx.auth_verdict("x", m) for m in ("spf", "dkim", "dmarc", "arc")]) == [
        ("softfail", "fail", "none", None)
    ]
    assert values(spark, ["<a@b> x <c>", "none"], tx.message_id_list("x")) == [["<a@b>", "<c>"], []]
    assert values(spark, ["A.Tar.GZ", "plain", "x.abcdefghijklmnopqrst"], tx.file_extension("x")) == [
        "gz", "", "abcdefghijklmnop",
    ]
    assert values(spark, ["Jé@b.c.org <x+Y@z.com>", "at home"], tx.emails_in_text("x")) == [
        ["jé@b.c.org", "x+y@z.com"], [],
    ]


def test_sizes(spark):
    sizes = ["0", "1023", "1024", "1280", "1536", "1048576", "1310720"]
    assert values(spark, sizes, tx.format_size("bigint(x)")) == [
        "0 B", "1023 B", "1.0 KB", "1.2 KB", "1.5 KB", "1.0 MB", "1.2 MB",
    ]


@pytest.mark.parametrize(
    "header,expected",
    [
        ("Mon, 5 Jan 2026 09:30:00 -0500", (1767623400, 9, 0)),
        ("5 Jan 26 23:59 +0100", (1767653940, 23, 0)),
        ("Thu, 01 Jan 1970 00:00:00 GMT", (0, 0, 3)),
        ("Fri, 20 Mar 2026 03:12:00 +0000 (UTC)", (1773976320, 3, 4)),
        ("5 Jan 2026 09:30:00 EST", (1767623400, 9, 0)),
        ("Mon, 31 Feb 2026 09:30:00 -0500", (None, None, None)),
        ("Mon, 5 Jan 2026 25:30:00 -0500", (None, None, None)),
        ("garbage", (None, None, None)),
        (None, (None, None, None)),
    ],
)
def test_sender_local_time(spark, header, expected):
    assert tuple(values(spark, [header], st.sender_local_time("x"))[0]) == expected


def test_positions_order_like_pairs(spark):
    df = spark.sql("SELECT * FROM VALUES (0L, 5L), (-7L, 9223372036854775807L), (253402300799L, 0L) AS v(t, m)")
    df = df.selectExpr("t", "m", f"{position('t', 'm')} AS p")
    rows = df.selectExpr("t", "m", f"{time_of('p')}", f"{id_of('p')}", "p").orderBy("p").collect()
    assert [r[0] for r in rows] == [-7, 0, 253402300799]
    assert all((r[0], r[1]) == (r[2], r[3]) for r in rows)


def test_registry_version_follows_its_content():
    from wonted.config import DEFAULT_REGISTRY as d

    a, b = d.changed(weights={"auth_fail": 20.0}), d.changed(min_baseline=9)
    assert len({d.version, a.version, b.version}) == 3
    assert a.weights["auth_fail"] == 20.0 and a.weights["cold_links"] == d.weights["cold_links"]
    assert d.changed(min_baseline=9).version == b.version
