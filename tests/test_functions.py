"""Column functions and parsers on literal cases."""

import pytest
from pyspark.sql import functions as F

from loomspan.functions import text as X
from loomspan.functions import urls as U
from loomspan.sources import feeds, html, layout


def one(spark, expr, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(expr.alias("x")).first().x


def test_normal_form_and_tokens():
    assert X.normal("  Straße\tＡＢＣ\n ﬁn ") == "strasse abc fin"
    assert X.tokens_of("Hello_World 12 東京 한국") == ["hello", "world", "12", "東", "京", "東京", "한", "국", "한국"]


def test_simhash_of_short_and_equal():
    assert X.simhash_of("") == X.simhash_of("") and X.simhash_of("abc") != X.simhash_of("abd")
    a = "the quick brown fox jumps over the lazy dog " * 8
    assert bin(X.simhash_of(a) ^ X.simhash_of(a.replace("lazy", "lazyy", 1))).count("1") < 12


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://Example.COM:80/a?utm_source=x&b=1&c=#top", "http://example.com/a?b=1&c="),
        ("https://h.org:443", "https://h.org/"),
        ("https://h.org:8443/?id=1", "https://h.org:8443/?id=1"),
        ("https://h.org/?q=a%20b&fbclid=9", "https://h.org/?q=a+b"),
        ("https://u:p@h.org/", None),
        ("ftp://h.org/", None),
        ("https://h.org/a b", None),
        ("https://h.org:x/", None),
        (None, None),
    ],
)
def test_canonical(url, want):
    assert U.canonical(url) == want


def test_links_are_joined():
    assert U.joined("https://h.org/a/b", "../c#d") == "https://h.org/c"
    assert U.joined("https://h.org/", "javascript:x") is None and U.joined("https://h.org/", "//k.org/x y") is None


def test_url_parts(spark):
    u = F.lit("https://User@Host.ORG:8443/p/q?x#y")
    assert one(spark, U.host(u)) == "host.org" and one(spark, U.port(u)) == 8443 and one(spark, U.path(u)) == "/p/q"
    assert not one(spark, U.plain_web(u))
    assert one(spark, U.scope_permits(F.lit("https://a.org/x"), ["a.org"])) and not one(spark, U.scope_permits(F.lit("https://a.org:81/x"), ["a.org"]))
    assert one(spark, U.origin(F.lit("http://a.org:80/x"))) == "http://a.org" and one(spark, U.origin(F.lit("http://a.org:81/"))) == "http://a.org:81"
    assert one(spark, U.under_path(F.lit("/a/b"), F.lit("/a"))) and not one(spark, U.under_path(F.lit("/ab"), F.lit("/a")))
    assert [one(spark, U.safe_path(F.lit(p))) for p in ("/a/b", "/a/../b", "/a%2Fb", "/%2e%2e/b", "/%252e")] == [True, False, False, False, False]
    assert not U.onion_name("abc.onion") and not U.onion_name("h.org")


def test_headers(spark):
    h = F.array(F.struct(F.lit("Location").alias("name"), F.lit("/x#y").alias("value")), F.struct(F.lit("cache-control").alias("name"), F.lit("private, No-Store").alias("value")))
    assert one(spark, U.redirect_target(F.lit("https://a.org/q"), h)) == "https://a.org/x"
    assert not one(spark, U.cacheable(h)) and one(spark, F.size(U.kept_headers(h, ["location"]))) == 1


@pytest.mark.parametrize("text, want", [("short", "short"), ("aaaa bbbb cccc", "aaaa bbbb"), ("aaaabbbbccccdddd", "aaaabbbbcc"), ("aaaabbbbcc dd", "aaaabbbbcc")])
def test_truncation(spark, text, want):
    assert one(spark, X.truncated_query(F.lit(text), 10)) == want


def test_scores_and_anchors(spark):
    assert one(spark, X.keyword_score(F.lit("Solar wind"), F.lit("http://a/b"), F.lit("the SOLAR age"))) == 1.0
    assert one(spark, X.keyword_score(F.lit("  "), F.lit("a"), F.lit("b"))) == 0.0
    a = X.scoring_anchor(F.lit("https://www.h.org/deep_space/2020/page.html?id=7"), F.lit("h.org"), F.lit("snip"))
    assert one(spark, a) == "h.org deep space page id snip"
    assert one(spark, X.scoring_anchor(F.lit("https://h.org/x"), F.lit("A title"), F.lit("snip"))) == "A title"
    got = one(spark, X.link_input(F.lit("https://h.org/abc?q=123"), F.lit("anchor text"), 24))
    assert got.text == "https://h.org/abc\nanchor" and got.cut == 11


def test_vectors(spark):
    assert one(spark, X.unit_vector(F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx([0.6, 0.8])
    assert one(spark, X.unit_vector(F.array(F.lit(0.0)))) is None


def test_occurrences_and_dates(spark):
    assert [one(spark, X.occurrence(F.lit("a.b a.b a.b"), F.lit("a.b"), F.lit(k))) for k in (0, 1, 2, 3)] == [0, 4, 8, None]
    d = one(spark, X.date_bounds(F.lit("2020-01-01"), F.lit(None).cast("string")))
    assert d.low.isoformat() == "2020-01-01" and d.unknown
    assert one(spark, X.date_bounds(F.lit("2020-1-1"), F.lit(None).cast("string"))).low is None
    now = F.lit("2020-01-01 00:00:00").cast("timestamp")
    assert one(spark, X.retry_after(F.lit("120"), now)) == 120 and one(spark, X.retry_after(F.lit("junk"), now)) is None
    assert one(spark, X.retry_after(F.lit("Wed, 01 Jan 2020 00:01:00 GMT"), now)) == 60
    assert X.retry_schedule()[:6] == [1, 2, 4, 8, 16, 30] and sum(X.retry_schedule()) <= 180
    assert one(spark, X.charset(F.lit('text/html; Charset="ISO-8859-1"'))) == "iso-8859-1"


PAGE = """<html lang="de"><head><title>T</title><meta property="og:title" content="Open"><meta name="author" content="A. U."><link rel="canonical" href="/c">
<meta property="article:published_time" content="2020-01-02"></head><body><nav><a href="/nav">n</a></nav><article><h1>Head</h1><p>First  para.<p>Second &amp; last, long enough to be read.
<a href="/x">one</a> <a href="/x#f">two</a> <a href="mailto:a">m</a></article><footer>foot</footer></body></html>"""


def test_page_reading():
    r = html.read(PAGE, "https://h.org/p")
    assert (r["title"], r["author"], r["published"], r["canonical"], r["declared_lang"]) == ("Open", "A. U.", "2020-01-02", "https://h.org/c", "de")
    assert r["text"].split("\n")[:3] == ["Head", "First para.", "Second & last, long enough to be read. one two m"]
    assert r["links"] == [{"target": "https://h.org/x", "anchor": "one"}] and "foot" not in r["text"]
    assert html.read("<p>thin", "https://h.org/") is None and html.plain("<p>thin<script>x</script>", "https://h.org/")["text"] == "thin"
    assert html.read("<base href=/b/><title>t</title><body>" + "long enough text to be read " * 3 + "<a href=x>l</a>", "https://h.org/p")["links"][0]["target"] == "https://h.org/x"
    assert html.read("<body>" + "text without any title " * 9, "https://h.org/") is None and html.read("<title>t</title><article></article><body>" + "words " * 30, "https://h.org/") is None
    cut = html.read(PAGE, "https://h.org/p", most_chars=10, most_links=0)
    assert len(cut["text"]) == 10 and cut["omitted_chars"] > 0 and cut["omitted_links"] == 1


@pytest.mark.parametrize(
    "value, want",
    [
        ("a.png", [("a.png", None, 1.0)]),
        ("a.png 1x, b.png 2x", [("a.png", None, 1.0), ("b.png", None, 2.0)]),
        ("a,b.png 300w,c.png 600w", [("a,b.png", 300, None), ("c.png", 600, None)]),
        ("a.png 900w 400h", [("a.png", 900, None)]),
        ("a.png 400h, b.png 0w, c.png 1q", []),
        ("a.png 1e0x", [("a.png", None, 1.0)]),
        ("a.png, b.png 2x", [("a.png", None, 1.0), ("b.png", None, 2.0)]),
        ("a.png 1x 2x", []),
        ("", []),
        ("a.png (1x, 2x) 1x, b.png 2x", [("b.png", None, 2.0)]),
        ("a.png ((1x), b.png 2x", [("b.png", None, 2.0)]),
        ("a.png (1x, b.png 2x", []),
    ],
)
def test_srcset(value, want):
    assert [(c["url"], c["width"], c["density"]) for c in html.srcset(value)] == want


RSS = b"""<rss version="2.0"><channel><item><title>A</title><link>/a</link><guid isPermaLink="false">x1</guid><enclosure url="/a.mp3"/><description>&lt;b&gt;hi&lt;/b&gt; you</description></item></channel></rss>"""
ATOM = b"""<feed xmlns="http://www.w3.org/2005/Atom" xml:base="https://b.org/d/"><entry xml:base="e/"><id>i</id><title type="html">&lt;i&gt;T&lt;/i&gt;</title><link href="f"/><summary>s</summary></entry></feed>"""


def test_feeds():
    kind, got, left = feeds.entries(RSS, "https://h.org/")
    assert kind == "rss" and got[0]["urls"] == ["https://h.org/a", "https://h.org/a.mp3"] and got[0]["text"] == "hi you" and left == 0
    kind, got, _ = feeds.entries(ATOM, "https://h.org/")
    assert kind == "atom" and got[0]["urls"] == ["https://b.org/d/e/f"] and got[0]["title"] == "T" and got[0]["text"] == "s"
    kind, got, left = feeds.entries(b'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://h.org/1</loc></url><url><loc>https://h.org/2</loc></url></urlset>', "https://h.org/")
    assert kind == "sitemap" and len(got) == 2 and left == 0
    kind, got, _ = feeds.entries(b'{"version":"https://jsonfeed.org/version/1.1","items":[{"id":1,"url":"/u","attachments":[{"url":"/v"}],"content_html":"<p>c</p>"}]}', "https://h.org/")
    assert kind == "json_feed" and got[0]["urls"] == ["https://h.org/u", "https://h.org/v"] and got[0]["text"] == "c"
    atom = b'<feed xmlns="http://www.w3.org/2005/Atom"><entry><link href="/1"/><link href="/2"/><link rel="enclosure" href="/3"/><summary>s</summary><content>c</content></entry></feed>'
    got = feeds.entries(atom, "https://h.org/")[1][0]
    assert got["urls"] == ["https://h.org/1", "https://h.org/3"] and got["text"] == "s"
    guid = b'<rss version="2.0"><channel><item><guid isPermaLink="yes">/g</guid></item><item><guid>/h</guid></item></channel></rss>'
    assert [x["urls"] for x in feeds.entries(guid, "https://h.org/")[1]] == [[], ["https://h.org/h"]]
    with pytest.raises(ValueError):
        feeds.entries(guid, "https://h.org/", 1)
    for bad in (b'<rss><channel/></rss>', b'<!DOCTYPE x><rss/>', b'<!doctype x [<!ENTITY a "b">]><rss/>', b"<html/>", b'{"a":1,"a":2}'):
        with pytest.raises(ValueError):
            feeds.entries(bad, "https://h.org/")


def test_json_mapping(spark):
    raw = ['{"data":{"hits":[{"doi":"10.1/a b","t":["x","y"]},{"doi":null},{"doi":7}]}}', '{"data":{}}', '{"a":1,"a":2}']
    df = spark.createDataFrame(list(enumerate(raw)), "id long, raw string")
    got = feeds.json_entries(df, "id", "raw", ["data", "hits"], ["doi"], ["t"], "https://d.org/{value}").orderBy("id", "ordinal").collect()
    assert [(r.ordinal, r.url, r.title, r.locator) for r in got if r.id == 0] == [(0, "https://d.org/10.1%2Fa%20b", "x y", "/data/hits/0")] or [r.url for r in got if r.id == 0][0] == "https://d.org/10.1%2Fa%20b"
    assert all(r.error for r in got if r.id > 0)
    assert feeds.pointer(["a/b", 0, "c~"]) == "/a~1b/0/c~0"


def test_reading_order():
    heading, left, right = (0, 0.0, 0.0, 1.0, 0.1), [(i, 0.0, 0.2 * i, 0.45, 0.2 * i + 0.15) for i in (1, 2, 3)], [(i, 0.55, 0.2 * (i - 3), 1.0, 0.2 * (i - 3) + 0.15) for i in (4, 5, 6)]
    assert layout.reading_order([heading, *right, *left]) == [0, 1, 2, 3, 4, 5, 6]
    assert layout.reading_order([*right, *left], right_to_left=True) == [4, 5, 6, 1, 2, 3]
    assert layout.reading_order([]) == []
    # A gap counts against the page, so a narrow one in a narrow region doesn't cut it.
    near = [(1, 0.0, 0.0, 0.1, 0.1), (2, 0.11, 0.05, 0.2, 0.15), (3, 0.0, 0.08, 0.1, 0.2), (4, 0.8, 0.0, 1.0, 0.2)]
    assert layout.reading_order(near, column_gap=0.05) == [1, 2, 3, 4] and layout.reading_order(near, column_gap=0.005) == [1, 3, 2, 4]
    for bad in ([(1, 0, 0, 1, 1), (1, 2, 0, 3, 1)], [(1, 1, 0, 0, 1)], [(1, float("nan"), 0, 1, 1)]):
        with pytest.raises(ValueError):
            layout.reading_order(bad)
