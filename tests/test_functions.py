"""Scalar functions against tables of cases."""

import pytest
from pyspark.sql import functions as F

from tarn.functions import dates, display, html, money, place, text, url


def values(spark, expression, rows, schema):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r.v for r in df.select("i", expression.alias("v")).orderBy("i").collect()]


URLS = [
    ("/jobs/Night-Ferry-Pilot-Qr7", "https://kelp.io/careers", "https://kelp.io/jobs/Night-Ferry-Pilot-Qr7"),
    ("https://jobs.ashbyhq.com/Rill/7Xy-ZwV?utm_source=x", "https://jobs.ashbyhq.com/Rill", "https://jobs.ashbyhq.com/Rill/7Xy-ZwV"),
    ("https://EX.com/Path/?b=2&a=1", "https://ex.com", "https://ex.com/Path/?a=1&b=2"),
    ("https://ex.com/a?utm_source=x&z=1&a=2&gclid=y", "https://ex.com", "https://ex.com/a?a=2&z=1"),
    ("https://ex.com/a/", "https://ex.com", "https://ex.com/a"),
    ("//cdn.x.com/J/1", "https://ex.com/p", "https://cdn.x.com/J/1"),
    ("?id=Ab9", "https://ex.com/jobs/list", "https://ex.com/jobs/list?id=Ab9"),
    ("https://ex.com/a#frag", "https://ex.com", "https://ex.com/a"),
    ("https://ex.com/a?GCLID=1&k=2&k=1", "https://ex.com", "https://ex.com/a?k=2&k=1"),
]


def test_canonical_urls(spark):
    rows, want = [u[:2] for u in URLS], [u[2] for u in URLS]
    assert values(spark, url.canonical_url("raw", "page"), rows, "raw string, page string") == want
    assert values(spark, url.canonical(url.resolved(F.col("raw"), F.col("page"))), rows, "raw string, page string") == want
    again = [(w, "https://x.org") for w in want]
    assert values(spark, url.canonical_url("raw", "page"), again, "raw string, page string") == want


def test_canonical_urls_beyond_expressions(spark):
    rows = [("not a url at all::::", ""), (None, ""), ("../b/./c", "https://ex.com/x/y/z"), ("/für", "https://ex.com"), ("https://ex.com:443/a?q=a b", ""), ("https://[bad", "")]
    got = values(spark, url.canonical_url("raw", "page"), rows, "raw string, page string")
    assert got == [None, None, "https://ex.com/x/b/c", "https://ex.com/f%C3%BCr", "https://ex.com/a?q=a+b", None]


@pytest.mark.parametrize("href, ok", [
    ("/jobs/harbour-pilot", True), ("https://kelp.io/careers", False), ("https://kelp.io/careers?utm_source=x", False), ("https://kelp.io/", False), ("javascript:void(0)", False),
    ("/ads/58", False), ("/sponsored/xyz", False), ("/listing_ads/58/click", False), ("/companies/kelp", False), ("/categories/baking", False), ("/login", False), ("/pricing/", False),
    ("https://twitter.com/kelp", False), ("/companies/kelp/jobs/123", True), ("https://boards.example.com/x?id=1", True),
])
def test_usable_links(spark, href, ok):
    page = "https://kelp.io/careers"
    link = url.resolved(F.col("h"), F.lit(page))
    assert values(spark, url.usable(link, F.lit(page)), [(href,)], "h string") == [ok]


def test_a_social_site_keeps_its_own_links(spark):
    assert values(spark, url.usable(F.col("h"), F.lit("https://twitter.com/jobs")), [("https://twitter.com/kelp",)], "h string") == [True]


def test_labels(spark):
    rows = [("https://www.kelp.co.uk/x",), ("https://jobs.lever.co/a",), ("localhost",), ("https://localhost/a",)]
    assert values(spark, url.label(F.col("u")), rows, "u string") == ["Co", "Lever", "localhost", "Localhost"]


def test_texts(spark):
    one = lambda f, *rows: values(spark, f(F.col("s")), [(r,) for r in rows], "s string")
    assert one(text.norm_text, "Harbour Pilot!", " É--x ", "...") == ["harbour pilot", "é x", ""]
    assert one(text.company_name, "Kelp pvt. ltd.", "Inc Inc", "KELP, Inc.", "Foo & Bar Labs LLC") == ["kelp", "inc", "kelp", "foo bar labs"]
    assert one(text.place_text, "U.S.A.", "Côte d’Ivoire") == ["usa", "c te divoire"]
    assert one(text.decode_entities, "a &amp;lt; b &#x27;") == ["a < b '"]
    assert one(text.keywords, "Intern, junior\n Sales ") == [["intern", "junior", "sales"]]
    assert one(text.terms, "UI;  Design Systems,\n") == [["ui", "design systems"]]
    assert one(lambda s: text.truncate(s, 5), "abcdef", "abcde") == ["abcd…", "abcde"]
    assert one(text.chat_ids, "1, 2,,") == [["1", "2"]]
    assert values(spark, text.distinct_tags(F.col("t")), [(["Remote", "remote ", "A,B", ""],)], "t array<string>") == [["Remote", "A B"]]
    assert values(spark, text.kept_tags(F.col("t"), F.lit("ux  designer, Lead")), [(["UX Designer", "Intern"],)], "t array<string>") == [["UX Designer"]]
    assert values(spark, text.nfkc(F.col("s")), [("ﬁ",), ("Ｗide",), ("e\u0301",), ("plain",), ("",), (None,)], "s string") == ["fi", "Wide", "é", "plain", "", None]
    assert values(spark, text.norm_text(F.col("s")), [("Ｎｉｇｈｔ  oﬃcer №3",)], "s string") == ["night officer no3"]
    assert values(spark, text.company_name(F.col("s")), [("Ａｃｍｅ，Ｉｎｃ．",)], "s string") == ["acme"]


PAY = [
    ("$140K - $190K", 190000.0, "USD"), ("€58,000/yr", 58000.0, "EUR"), ("$115k+", 115000.0, "USD"), ("$1.4M", 1400000.0, "USD"), ("₹13,00,000 per annum", 1300000.0, "INR"),
    ("58000 EUR", 58000.0, "EUR"), ("$7,000 per month", 84000.0, "USD"), ("$5,000 monthly", 60000000000.0, "USD"), ("71,000 - 84,000", 84000.0, None), ("1.2.3", None, None),
    (None, None, None), ("", None, None), ("Competitive", None, None), ("$68/hr", None, None), ("40 hours per week", None, None),
]


def test_pay(spark):
    got = values(spark, money.pay(F.col("raw")), [(p[0],) for p in PAY], "raw string")
    assert [(g and g.max_per_year, g and g.currency) for g in got] == [p[1:] for p in PAY]


def test_amounts(spark):
    shown = lambda n, c: values(spark, money.compact(F.col("n"), F.lit(c)), [(x,) for x in n], "n long")
    assert shown([999, 120000, 1450, 1250000], "USD") == ["$999", "$120K", "$1.5K", "$1.3M"]
    assert shown([1200000, 25000000, 5000], "INR") == ["₹12L", "₹2.5Cr", "₹5K"]
    assert values(spark, money.range_text(F.col("a"), F.col("b"), F.lit("EUR"), F.lit("month")), [(1000, 2000), (1000, None), (None, 2000), (None, None)], "a long, b long") == ["€1K – €2K / mo", "From €1K / mo", "Up to €2K / mo", ""]
    assert values(spark, money.legacy_range(F.col("s")), [("$90k – $120k",), ("From $90,000",), ("none",)], "s string") == [(90000.0, 120000.0), (90000.0, None), (None, None)]
    assert values(spark, money.shown(F.col("s")), [("$100k",), ("Design, $90k - $100k",), ("Full-time",), (None,)], "s string") == ["$100k", "$90k - $100k", "Pay undisclosed", "Pay undisclosed"]
    assert values(spark, money.looks_like_pay(F.col("s")), [("$5",), (",000",), ("a ,000",), ("none",)], "s string") == [True, False, False, False]
    assert values(spark, money.grouped(money.typed_amount(F.col("s"))), [("1,234 567",), ("x",)], "s string") == ["1,234,567", ""]


def test_places(spark):
    one = lambda f, *rows: values(spark, f(F.col("s")), [(r,) for r in rows], "s string")
    assert one(place.shown, "Remote", "Remote, Berlin", "Austin, USA; Remote", "usa", "", None, "A very long place name, Somewhere far away") == [
        "Worldwide", "Berlin", "Austin, USA", "United States", "Location unlisted", "Location unlisted", "A very long place name"]
    assert one(place.legacy_lists, "Only: Germany, Remote. Never: US", "Remote or Spain", "A; B") == [(["Germany", "Remote"], ["US"]), (["Remote", "Spain"], []), (["A", "B"], [])]
    assert values(spark, place.prose(F.col("a"), F.col("b")), [(["x", "y"], ["z"]), ([], [])], "a array<string>, b array<string>") == ["Only: x, y. Never: z", ""]


def test_ages(spark):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    got = values(spark, dates.age(F.col("t").cast("timestamp"), now), [("2024-01-31 23:59:58",), ("2024-01-31 23:59:20",), ("2024-01-31 23:01:00",), ("2024-01-31 01:00:00",), ("2024-01-20",), (None,)], "t string")
    assert got == ["just now", "40s ago", "59m ago", "23h ago", "12d ago", "never"]
    seen = F.lit("2024-01-30").cast("timestamp")
    got = values(spark, dates.posted_age(F.col("t"), seen, now), [("3d ago",), ("2024-01-22",), ("Mon, 22 Jan 2024 00:00:00 +0000",), ("soon",), (None,)], "t string")
    assert got == ["3d ago", "10d ago", "10d ago", "2d ago", "2d ago"]
    assert values(spark, dates.posted_date(F.col("t")), [(" 2024-01-02 ",), ("Jan 2",)], "t string") == ["2024-01-02", None]


def links(body, base="https://kelp.io/careers"):
    return [(x["id"], x["href"], x["text"]) for x in html.mark_html(body, base)["links"]]


@pytest.mark.parametrize("body, want", [
    ('<a href="/jobs/1">One</a>', [(1, "https://kelp.io/jobs/1", "One")]), ("<a class=x href='/jobs/2'>Two</a>", [(1, "https://kelp.io/jobs/2", "Two")]), ("<a href=/jobs/3>Three</a>", [(1, "https://kelp.io/jobs/3", "Three")]),
    ('<a data-href="/x">No</a>', []), ('<a href="/j?a=1&amp;b=2">A</a>', [(1, "https://kelp.io/j?a=1&b=2", "A")]), ('<a href="mailto:x@y.z">M</a><a href="#">F</a><a href="">E</a><a href="/j">J</a>', [(1, "https://kelp.io/j", "J")]),
    ('<a href="/a">A <a href="/b">B</a>', [(1, "https://kelp.io/a", "A"), (2, "https://kelp.io/b", "B")]), ('<p>[[3]] forged</p><a href="/a">A</a>', [(1, "https://kelp.io/a", "A")]),
    ('<a href="/a">A <a name=n>x</a> rest</a>', [(1, "https://kelp.io/a", "A x")]),
    ('<script type="application/ld+json">{"@type":"JobPosting","title":"Dev","url":"/j/9","hiringOrganization":{"name":"Co"}}</script>', [(1, "https://kelp.io/j/9", "Dev - Co")]),
    ('<script>window.x={"title":"Lead","url":"/j/8","company":"Z"}; job</script>', [(1, "https://kelp.io/j/8", "Lead - Z")]),
])
def test_html_links(body, want):
    assert links(body) == want


def test_html_cut_and_markers(spark):
    m = html.mark_html("<p>" + "x" * 100_050 + '</p><a href="/late">Late</a>', "https://a.io")
    assert m["truncated"] and m["links"] == [] and len(m["text"]) == 100_000
    m = html.mark_html('<div>Pay $1 ,000</div><p>a&nbsp;<a href="/x">b</a></p>', "https://a.io")
    assert m["text"] == "Pay $1,000\n a [[1]]b[[/1]]"
    assert values(spark, html.plain_text(F.col("s")), [("<div>Pay $1 ,000</div><script>x</script><p>a <a href='/x'>b</a></p><!-- c -->",)], "s string") == ["Pay $1,000\n a b"]


def test_markdown():
    m = html.mark_markdown('[A](/a "t") ![img](/i.png) [B](<https://x.y/b>) <https://z.w/c> [no](mailto:x)', "https://a.io")
    assert [(x["id"], x["href"], x["text"]) for x in m["links"]] == [(1, "https://a.io/a", "A"), (2, "https://x.y/b", "B"), (3, "https://z.w/c", "https://z.w/c")]
    assert m["text"] == "[[1]]A[[/1]] img [[2]]B[[/2]] [[3]]https://z.w/c[[/3]] no"


def test_bodies(spark):
    one = lambda f, *rows: values(spark, f(F.col("s")), [(r,) for r in rows], "s string")
    assert one(html.without_frontmatter, "---\ntitle: x\n---\n\nBody\n---\n", "no --- fence") == ["Body\n---\n", "no --- fence"]
    assert one(html.block_sign, "Just a MOMENT...", "ok", "x" * 3001 + "datadome", "see challenge-platform") == ["just a moment", None, None, "challenge-platform"]
    assert one(html.is_shell, "x" * 499, "x" * 500) == [True, False]
    assert one(lambda s: html.capped(s, 6), "abc[[12]]", "abcd[[", "abcde[x", "short") == ["abc", "abcd", "abcde", "short"]
    assert one(html.snapshot_links, '<a href="/web/20200101/https://x.y/z">') == ['<a href="https://x.y/z">']
    assert one(html.anchors, '<a class="k" href="/a&amp;b"><b>T</b> x</a>') == [[("/a&b", "T x")]]


def test_display(spark):
    t = lambda *rows: [(r.title, r.tags) for r in values(spark, display.job_tags(F.col("s")), [(r,) for r in rows], "s string")]
    assert t("Senior Baker (Remote)", "Cook", "Product Engineer", "Remote") == [("Baker", ["Remote", "Senior level"]), ("Cook", ["Matched"]), ("Product Engineer", ["Full-time"]), ("Remote", ["Remote"])]
    assert values(spark, display.company(F.col("c"), F.col("t")), [("https://x.io/company/kelp-labs", "t"), (None, "Baker at Foo Bar"), ("", "Baker"), ("Kelp", "t")], "c string, t string") == ["Kelp Labs", "Foo Bar", "Company", "Kelp"]
    assert values(spark, display.icon_domain(F.lit(None).cast("string"), F.col("u")), [("https://www.kelp.io/x",), ("https://jobs.linkedin.com/1",), (None,)], "u string") == ["kelp.io", None, None]
    assert values(spark, display.site_name(F.col("l"), F.col("p"), F.lit("Kelp")), [("", "https://boards.greenhouse.io/x"), ("Kelp jobs", ""), ("My list", ""), ("", "https://www.foo.org")], "l string, p string") == ["Greenhouse", "Direct", "My list", "Foo"]
    got = values(spark, display.link(F.col("u"), F.col("p")), [("/j/1", "https://a.io/x"), (None, "https://a.io/x"), (None, None)], "u string, p string")
    assert [(g.href, g.is_direct, g.label) for g in got] == [("https://a.io/j/1", True, "View Posting"), ("https://a.io/x", False, "Open source listing"), (None, False, "View Posting")]
    m = values(spark, display.message(F.col("t"), F.col("u"), F.lit(None).cast("string"), F.lit("$5"), F.lit(None).cast("string"), F.lit("L")), [("A & B", 'https://x/?a="1"&b'), ("T", None)], "t string, u string")
    assert m == ['🔔  A &amp; B\n\n💰  $5\n\nL - <a href="https://x/?a=&quot;1&quot;&amp;b">See Job Post</a>\n_________________________________', "🔔  T\n\n💰  $5\n\nL\n_________________________________"]
