"""URLs, markup, encodings, addresses and injected markup on literal cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from relictum.functions import encoding as E
from relictum.functions import injection as I
from relictum.functions import markup as M
from relictum.functions import url as U
from relictum.functions.address import blocked_address_reason


def one(spark, column):
    return spark.range(1).select(column).first()[0]


BASE = "http://a.example/dir/page.html?q=1"
URLS = [
    ("x.gif", "http://a.example/dir/x.gif"), ("/x.gif", "http://a.example/x.gif"), ("../x", "http://a.example/x"), ("../../x", "http://a.example/x"), ("./", "http://a.example/dir/"), ("..", "http://a.example/"),
    ("?r=2", "http://a.example/dir/page.html?r=2"), ("#f", "http://a.example/dir/page.html?q=1#f"), ("", "http://a.example/dir/page.html?q=1"), ("//B.example:80/y", "http://b.example/y"), ("//b.example:8080/y", "http://b.example:8080/y"),
    ("HTTP://C.example", "http://c.example/"), ("https://c.example:443/a b", "https://c.example/a%20b"), ("http:\\\\d.example\\e", "http://d.example/e"), ("/für", "http://a.example/f%C3%BCr"), ("/a%20b", "http://a.example/a%20b"), ("/%2e%2e/x", "http://a.example/x"),
    ("  /t\n ab ", "http://a.example/t%20ab"), ("mailto:x@y", "mailto:x@y"), ("http://user:p@h.example/", "http://user:p@h.example/"), ("http://", None), ("http://a b/", None), ("http://h:99999/", None),
]


@pytest.mark.parametrize("raw,expected", URLS)
def test_resolution(raw, expected):
    assert U.join_url(raw, BASE) == expected


def test_resolution_in_columns(spark):
    df = spark.createDataFrame([(r, BASE) for r, _ in URLS] + [(None, BASE), ("x", None)], "r string, b string")
    assert [x.u for x in df.select(U.resolve_url(F.col("r"), F.col("b")).alias("u")).collect()] == [e for _, e in URLS] + [None, None]
    assert one(spark, U.capture_key(F.lit("HTTP://A.example#x"))) == "http://a.example/" and one(spark, U.capture_key(F.lit("no url"))) == "no url"


ODD = ("", "/", "//", "/a//b", "/./a", "/a/../b", "/a/.hidden", "/%2E./x", "a%2e/x", "a:b/c", "a?x:y", "a?x=1'2", "a#b'c", "?q", "#f", "a\\b", "/a`b", "a{b}", "/a?{`}", "/a#`", "x y", "x\ty", "x\n", "\nx", "ü", "/a?ü", "a|b^c[d]~e", ".x", "..", "a/.", "..a/b", "a/..", "http://h.example", "http://h.example/", "http://h.example/x\n", "http://H.example/", "http://h.example:80/", "http://h.example:8080/", "http://u@h.example/", "https://h.example/a/../b?c=/./d#e", "http:/x", "http:x", "https:x", "http:///x", "http://h_1.example/a%zz?b#c#d", "file:///x", "a%", "/<a>", 'q"r', "http://./a", "http://-/", "http://1.2.3/", "/" + "a" * 5000, "a" + "/b" * 5000)
ODD_BASES = (None, "", "nonsense", "http://a.example", "http://a.example/", "http://a.example/d/e/f?g/h#i/j", "https://a.example/d/../e/", "http://a.example:81/d/", "http://A.example/d", "mailto:x", "http://a.example/d e/f", "http://a.example/x?y=/.z/w", "http://a.example/x\n", "ftp://a.example/d/")


def test_plain_and_parsed_urls_agree(spark):
    """Wherever the patterns answer, they say what the parser says; on usual links they answer."""
    pieces = ("a", "B9", "/", "//", ".", "..", "%2e", "%", ":", "?", "#", "'", "`", "|", "\\", " ", "é", "http://", "HTTP:", "https://h.example", ":80", "@", "[", "]", "&", "{", "\n")
    rng = random.Random(3)
    made = ["".join(rng.choices(pieces, k=rng.randrange(1, 7))) for _ in range(3000)]
    pairs = [(r, b) for r in ODD for b in ODD_BASES] + [(r, rng.choice(ODD_BASES)) for r in made] + [(rng.choice(ODD), r) for r in made] + [(None, ODD_BASES[4])]
    got = spark.createDataFrame(pairs, "r string, b string").select("r", "b", U.plain_url(F.col("r"), F.col("b")).alias("p"), U.resolve_url(F.col("r"), F.col("b")).alias("u")).collect()
    assert [x for x in got if x.p is not None and x.p != U.join_url(x.r, x.b)] == []
    assert [x for x in got if x.u != U.join_url(x.r, x.b)] == []
    usual = [("img/a.gif", BASE), ("/b/c.html?d=1#e", BASE), ("http://h.example/", None), ("b.html", "http://a.example/")]
    assert all(x.p for x in spark.createDataFrame(usual, "r string, b string").select(U.plain_url(F.col("r"), F.col("b")).alias("p")).collect())


@pytest.mark.parametrize("url,path", [
    ("http://A.example/", "site/a.example/index.html"), ("http://a.example/b/c.gif", "site/a.example/b/c.gif"), ("http://a.example/b/c", "site/a.example/b/c/index.html"), ("http://a.example/..x/y!.png", "site/a.example/_x/y_.png"), ("nonsense", None),
])
def test_paths(spark, url, path):
    got = one(spark, U.local_path(F.lit(url)))
    assert got == path if path else got.startswith("site/_unparseable/")


def test_query_in_path(spark):
    got = one(spark, U.local_path(F.lit("http://a.example/x.cgi?a=1")))
    assert got.startswith("site/a.example/x__q") and got.endswith(".cgi") and len(got) == len("site/a.example/x__q12345678.cgi")


@pytest.mark.parametrize("address,reason", [("93.184.216.34", None), ("10.1.2.3", "private 10.0.0.0/8"), ("256.1.1.1", "unparseable IPv4 address"), ("::1", "loopback ::1"), ("::ffff:10.0.0.1", "private 10.0.0.0/8"), ("::ffff:a00:1", "private 10.0.0.0/8"), ("fe80::1%eth0", "link-local fe80::/10"), ("2606:2800::1", None), ("0:0:0:0:0:0:0:1", "loopback ::1"), ("0:0::0:0", "unspecified ::"), ("0:0:0:0:0:FFFF:7f00:0001", "loopback 127.0.0.0/8"), ("0::ffff:127.0.0.1", "loopback 127.0.0.0/8"), ("64:ff9b::1", "NAT64 64:ff9b::/96"), ("1:2:3:4:5:6:7:8", None), ("1::2::3", "not an IP address"), ("::ffff:300.0.0.1", "not an IP address"), ("host", "not an IP address")])
def test_addresses(spark, address, reason):
    assert one(spark, blocked_address_reason(F.lit(address))) == reason


def test_markup(spark):
    page = "<title>A &amp; B</title><!-- no --><script>x<y</script><p>One&nbsp;<b>Two</b></p><div> </div><P>One Two"
    assert one(spark, M.segments(F.lit(page))) == ["one two", "one two"]
    assert one(spark, M.attribute(F.lit("<a HREF = 'x&amp;y' >"), "href")) == "x&y" and one(spark, M.attribute(F.lit("<a name=x>"), "href")) is None
    assert one(spark, M.attribute(F.lit('<img data-src="d.gif" src="s.gif">'), "src")) == "d.gif"


@pytest.mark.parametrize("page,marker", [("<title>404 Not Found</title>", "404"), ("<h1>Page Not Found</h1>", "not found"), ("<p>404 not found</p>", None), ("<title>ok</title><h1>No such page</h1>", "no such page")])
def test_soft_404(spark, page, marker):
    assert one(spark, M.soft_404_marker(F.lit(page))) == marker


def test_one_template_has_one_fingerprint(spark):
    error = "<html><script>var a = '{0}';</script><body>Sorry, the page http://x.example/{0} or /{0} is not on this server 123</body></html>"
    a, b, c = (one(spark, M.error_fingerprint(F.lit(t))) for t in (error.format("one"), error.format("two"), "short"))
    assert a == b and a is not None and c is None


@pytest.mark.parametrize("page,target", [('<META content="5; URL=\'/next\'" http-equiv=refresh>', ("/next", "meta-refresh")), ("<script>self.location.replace('x.html')</script>", ("x.html", "script-location")), ("<p>location = 'y'</p>", None)])
def test_redirects(spark, page, target):
    got = one(spark, M.redirect_target(F.lit(page)))
    assert (got and tuple(got)) == target


BODIES = [
    (b"plain", None, "us-ascii", "detected", False), (b"\x93hi\x94", "text/html; charset=iso-8859-1", "windows-1252", "http-header", True), (b"\x93hi\x94", None, "windows-1252", "era-default", False),
    ("é".encode(), "text/html; charset=utf-8", "utf-8", "http-header", False), (b"caf\xe9", "text/html; charset=utf-8", "windows-1252", "era-default", False), (bytes.fromhex("93fa967b8cea"), "text/html; charset=x-sjis", "shift_jis", "http-header", False),
    (bytes.fromhex("c7d1b1b9beee"), None, "euc-kr", "detected", False), (b"\xef\xbb\xbfbom", None, "utf-8", "detected", False), (b"\xff\xfeh\x00", None, "utf-16le", "detected", False), (b"<meta charset=latin1>x\xe9", None, "iso-8859-1", "meta-charset", False),
]


@pytest.mark.parametrize("body,header,encoding,source,upgraded", BODIES)
def test_encodings(spark, body, header, encoding, source, upgraded):
    df = spark.createDataFrame([(bytearray(body), header)], "b binary, h string").select(E.decoded(F.col("b"), F.col("h")).alias("d"))
    d = df.first().d
    assert (d.kind, d.chosen_source, d.cp1252_upgrade) == ("text", source, upgraded)
    assert d.chosen_encoding == encoding or {d.chosen_encoding, encoding} == {"shift_jis", "euc-kr"}


@pytest.mark.parametrize("body,reason", [(b"\x89PNG\r\n\x1a\n....", "PNG signature"), (b"GIF89a", "GIF signature"), (b"ab\x00c", "NUL byte at offset 2")])
def test_binary_bodies(spark, body, reason):
    d = spark.createDataFrame([(bytearray(body),)], "b binary").select(E.decoded(F.col("b"), F.lit("text/html")).alias("d")).first().d
    assert d.kind == "binary" and d.binary_reason == reason and d.text is None


def test_plain_and_parsed_bodies_agree(spark):
    """Bodies decoded by built-in functions are what the decoder in Python makes of them."""
    bodies = [b"", b"plain", "é€".encode(), "日本語".encode(), bytes(range(1, 256)), bytes(range(0xA0, 256)), b"caf\xe9", b"\x80\x81\x8d\x8f\x90\x9d\x9f", b"\x93q\x94", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf4\x90\x80\x80", "\U0001f600�".encode(), "かな".encode("shift_jis"), b"\xef\xbb\xbfx", b"\xff\xfea\x00", b"a\xffb" * 50, None]
    labels = [None, "utf-8", "iso-8859-1", "us-ascii", "windows-1252", "shift_jis", "koi8-r", "no-such"]
    rows = [(i, bytearray(b) if b is not None else None, h, m, "meta-charset" if m else None) for i, (b, h, m) in enumerate((b, h, m) for b in bodies for h in labels for m in labels)]
    df = spark.createDataFrame(rows, "i int, b binary, h string, m string, s string").withColumn("mark", E.byte_mark(F.col("b")))
    of = [F.col(c) for c in ("b", "mark", "h", "m", "s")]
    got = df.select("i", "b", "h", E.plain_decoding(*of).alias("p"), E.decode_column(*of).alias("q")).collect()
    assert [x for x in got if x.p is not None and x.p != x.q] == []
    answered = {(bytes(x.b), x.h) for x in got if x.p is not None}
    assert {("é€".encode(), None), ("é€".encode(), "utf-8"), (b"caf\xe9", "iso-8859-1"), (b"\x93q\x94", "windows-1252")} <= answered and not any(b.startswith(b"\xef\xbb\xbf") for b, _ in answered)
    assert not any(x.p for x in got if x.h in ("shift_jis", "koi8-r", "no-such"))


def test_conflict_and_ratio(spark):
    d = spark.createDataFrame([(bytearray("<meta charset=utf-8>é".encode()), "text/html; charset=iso-8859-1")], "b binary, h string").select(E.decoded(F.col("b"), F.col("h")).alias("d")).first().d
    assert d.declaration_conflict and d.chosen_encoding == "iso-8859-1"
    assert one(spark, E.replacement_ratio(F.lit("a�" + "b" * 98))) == 0.01
    assert one(spark, E.replacement_ratio(F.lit(""))) == 0.0


PAGE = "<html><body><div id=main><div>text about the wayback machine</div></div></body></html>"
INSERTS = [
    I.TOOLBAR_BEGIN + "<div id='wm-ipp-base'><div>x</div></div>" + I.TOOLBAR_END, "<!-- FILE ARCHIVED ON 1999 -->", '<div id="wm-ipp"><div><div>deep</div></div></div>',
    '<script src="/_static/js/x.js"></script>', '<link rel=stylesheet href="/_static/c.css">', '<script>__wm.init("x");</script>', "<script>archive_analytics.v=1;</script>", '<script src="https://archive.org/includes/a.js"></script>',
]


@pytest.mark.parametrize("insert", INSERTS)
def test_injected_markup_goes(insert):
    clean, removed = I.strip(PAGE.replace("<body>", "<body>" + insert))
    assert clean == PAGE and len(removed) == 1 and removed[0][1] == len(insert)


def test_clean_and_open_pages_stay(spark):
    assert I.strip(PAGE) == (PAGE, [])
    broken = PAGE.replace("<body>", '<body><div id="wm-ipp">' + I.TOOLBAR_BEGIN)
    got = spark.createDataFrame([(broken,), (None,)], "t string").select(I.strip_injection(F.col("t")).alias("s")).collect()
    assert got[0].s.text == broken and got[0].s.residual == ["wm-ipp", "WAYBACK TOOLBAR INSERT"] and got[1].s.text is None


def test_validation(spark):
    check = lambda **k: one(spark, M.validation_failure(F.lit(k.get("text")).cast("string"), F.lit(k["relation"]), F.lit(None).cast("string"), F.lit(k.get("n", 5)), F.lit(k.get("cut", False)), F.lit(k.get("reason")).cast("string")))
    assert check(relation="page", text="fine") is None
    assert check(relation="page", text="x", cut=True).kind == "oversized-body" and check(relation="page", text="", n=0).kind == "empty-body"
    assert check(relation="page", text="job failed").kind == "archive-error-page" and check(relation="image", text=" <HTML>").kind == "content-type-mismatch"
    assert check(relation="frame", reason="PNG signature").kind == "content-type-mismatch" and check(relation="image", reason="PNG signature") is None
