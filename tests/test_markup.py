"""Hostile markup: linear scans give what plain patterns give, and a megabyte of any opening ends soon."""

from __future__ import annotations

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from relictum.functions import injection as I
from relictum.functions import markup as M
from relictum.functions.url import join_url
from relictum.operators.links import RULES, matches

BITS = ["<div ", "<div>", "</div>", "</div >", 'id="wm-ipp-x"', ">", "<script>", "<script src='/_static/a.js'>", "<script ", "</script>", "</script >", "</style>", "<style>", "<STYLE ", "<title>", "<title ", "</title>", " ", "\n", "__wm.", "<link rel=x href=/_static/a>", "<link ", "<!--", "-->", "<!-->", "FILE ARCHIVED ON", "text", "Word &nbsp;", "'", '"', "src=", "<p>", "<", "<meta ", "http-equiv=refresh ", "content='0;url=/x'>", "location = '/y'", "location.replace( '/z')", "\ufdd0", "\ufdd01", "a1.b", "http://x/y", "/p", "<h1>", "</h1>"]
OPENINGS = ["<script>", "<script src=' ", "<!--", "<link ", "<script src='/_static/'>   ", "<", "<title ", "location(   ", "a1"]
TAILS = ["", ">", "</script></title></style>-->'://x"]


def made(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 24))) for _ in range(n)]


# what the linear forms stand for, as plain patterns


def plain_strip(x):
    for pattern in (M.COMMENT, M.SCRIPT_OR_STYLE, M.TAG):
        x = F.regexp_replace(x, pattern, " ")
    return M.collapse(F.lower(x))


def plain_segments(x):
    for pattern in (M.COMMENT, M.SCRIPT_OR_STYLE, M.TITLE_ELEMENT):
        x = F.regexp_replace(x, pattern, " ")
    tagless = lambda s: F.lower(M.collapse(F.regexp_replace(F.regexp_replace(s, M.TAG, " "), "(?i)&nbsp;", " ")))
    return F.filter(F.transform(F.split(x, M.BLOCK_BOUNDARY), tagless), lambda s: s != "")


def plain_title(x, tag, most):
    return F.regexp_extract(x, rf"(?is)<{tag}\b[^>]*>(.{{0,{most}}}?)</{tag}\s*>", 1)


def plain_redirect(x):
    metas = F.regexp_extract_all(x, F.lit(r"""(?i)<meta\b[^>]*http-equiv\s*=\s*["']?refresh["']?[^>]*>"""), F.lit(0))
    content = F.transform(metas, lambda t: F.trim(F.regexp_extract(M.unquote(F.regexp_extract(t, M.REFRESH_CONTENT, 1)), M.REFRESH_URL, 1)))
    location = r"""(?i)(?:window|document|self|top)?\.?location(?:\.href|\.replace)?\s*(?:=|\(\s*)\s*["']([^"']+)["']"""
    scripts = F.transform(F.regexp_extract_all(x, F.lit(M.SCRIPT_BLOCK), F.lit(1)), lambda s: F.regexp_extract(s, location, 1))
    return F.coalesce(F.get(F.filter(content, lambda u: u != ""), 0), F.get(F.filter(scripts, lambda u: F.trim(u) != ""), 0))


def test_linear_forms_equal_plain_patterns(spark):
    t = F.col("t")
    valued = lambda tag, name: F.transform(F.regexp_extract_all(t, F.lit("(?i)" + tag), F.lit(0)), lambda found: M.attribute(found, name))
    plain_links = F.concat(*[valued(tag, name) for tag, name, _ in RULES])
    links = F.transform(F.concat(*[matches(t, n, *rule) for n, rule in enumerate(RULES)]), lambda x: x["raw_url"])
    scheme = lambda pattern: F.regexp_replace(F.lower(t), pattern, " ")
    pairs = {"strip": (M.strip_markup(t), plain_strip(t)), "segments": (M.segments(t), plain_segments(t)), "title": (M.element_text(t, "title", 400), plain_title(t, "title", 400)), "h1": (M.element_text(t, "h1", 5), plain_title(t, "h1", 5)), "redirect": (M.redirect_target(t)["raw"], plain_redirect(t)), "links": (links, plain_links), "scheme": (scheme(M.SCHEME), scheme(r"[a-z][a-z0-9+.-]*://\S+"))}
    df = spark.createDataFrame([(x,) for x in [*made(1, 6000), None, ""]], "t string").repartition(8)
    for name, (got, want) in pairs.items():
        wrong = df.select(t, got.alias("got"), want.alias("want")).where("not (got <=> want)").take(2)
        assert not wrong, (name, wrong)


@pytest.mark.parametrize("opening", OPENINGS)
def test_a_megabyte_of_an_opening(spark, opening):
    """Every form reads three pages of a megabyte each in seconds; a quadratic one would take minutes for each."""
    pages = [opening * ((1 << 20) // len(opening)) + tail for tail in TAILS]
    t = F.col("t")
    df = spark.createDataFrame([(x,) for x in pages], "t string").repartition(3)
    forms = [F.length(M.strip_markup(t)), F.size(M.segments(t)), F.length(M.title_text(t)), M.error_fingerprint(t), M.redirect_target(t)["raw"], M.soft_404_marker(t), F.size(F.concat(*[matches(t, n, *rule) for n, rule in enumerate(RULES)]))]
    begin = time.perf_counter()
    df.select(*[f.alias(f"f{i}") for i, f in enumerate(forms)]).write.format("noop").mode("overwrite").save()
    for page in pages:
        I.strip(page)
    assert time.perf_counter() - begin < 40


# the strip of injected markup against its rules as plain patterns

PLAIN = (
    ("wayback-toolbar-insert", re.escape(I.TOOLBAR_BEGIN) + r"[\s\S]*?" + re.escape(I.TOOLBAR_END), None),
    ("file-archived-comment", r"<!--[\s\S]*?-->", "FILE ARCHIVED ON"),
    ("wayback-toolbar-element", None, None),
    ("replay-static-script", r"""(?i)<script\b[^>]*\bsrc\s*=\s*["'][^"']*["'][^>]*>\s*</script>""", "/_static/"),
    ("replay-static-stylesheet", r"(?i)<link\b[^>]*>", "/_static/"),
    ("replay-analytics-script", r"""(?i)<script\b[^>]*\bsrc\s*=\s*["'][^"']*["'][^>]*>\s*</script>""", "archive.org/includes/"),
    ("replay-init-script", r"(?i)<script\b[^>]*>[\s\S]*?</script>", "__wm."),
    ("replay-analytics-inline-script", r"(?i)<script\b[^>]*>[\s\S]*?</script>", "archive_analytics"),
)


def plain_element(text):
    opening = re.search(r"""(?i)<div\b[^>]*\bid\s*=\s*["']?wm-ipp[\w-]*["']?[^>]*>""", text)
    depth = 1
    for edge in re.compile(r"(?i)<div\b|</div\s*>").finditer(text, opening.end()) if opening else ():
        depth += -1 if edge[0][1] == "/" else 1
        if not depth:
            return opening.start(), edge.end()
    return None


def plain_removal(text):
    removed = []
    for name, pattern, needs in PLAIN:
        if len(removed) >= 64:
            break
        if needs is None:
            for _ in range(64):
                span = plain_element(text) if pattern is None else (m.span() if (m := re.search(pattern, text)) else None)
                if span is None:
                    break
                removed.append((name, span[1] - span[0]))
                text = text[: span[0]] + text[span[1] :]
            continue
        spans, parts, at = [m.span() for m in re.finditer(pattern, text) if needs in m[0]][:64], [], 0
        for start, end in spans:
            parts.append(text[at:start])
            removed.append((name, end - start))
            at = end
        text = "".join([*parts, text[at:]])
    return text, removed


def test_strip_equals_its_rules():
    r = random.Random(7)
    bits = [*BITS, I.TOOLBAR_BEGIN, I.TOOLBAR_END, "archive_analytics", "archive.org/includes/", "<di", "v ", 'src="x/_static/>y"', "<div id=wm-ipp>", "<!-- BEGIN WAYBACK ", "TOOLBAR INSERT -->"]
    for _ in range(20_000):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 25)))
        assert I.strip(text) == plain_removal(text), text
    many = (I.TOOLBAR_BEGIN + I.TOOLBAR_END + "<div id=wm-ipp></div><script>__wm.</script>") * 90
    assert I.strip(many) == plain_removal(many)


def plain_whole(text):
    """All that the rules find, however many."""
    removed = []
    for name, pattern, needs in PLAIN:
        at = 0
        while True:
            span = plain_element(text) if pattern is None else next((m.span() for m in re.compile(pattern).finditer(text, at) if needs is None or needs in m[0]), None)
            if span is None:
                break
            removed.append((name, span[1] - span[0]))
            text = text[: span[0]] + text[span[1] :]
            at = span[0] if needs else 0
    return text, removed


def test_strip_takes_out_every_part(spark):
    """200 parts of each rule go, also from what removals put together; rules after one that found many still run."""
    r = random.Random(11)
    ends = ["<!-- BEGIN WAYBACK ", "TOOLBAR INSERT -->", I.TOOLBAR_BEGIN, I.TOOLBAR_END, I.TOOLBAR_BEGIN[:-1], "<di", "<d", "<", "v id=wm-ipp>", "iv id=wm-ipp>", "<div ", "<div id=wm-ipp>", "</div>", "<div>", ">", "x", ""]
    for _ in range(20_000):
        text = "".join(r.choice(ends) for _ in range(r.randint(1, 40)))
        assert I.strip(text, math.inf) == plain_whole(text), text
    parts = ("<!-- FILE ARCHIVED ON 1 -->", "<div id=wm-ipp>a<div></div></div>", "<script src='/_static/a.js'></script>", "<link href=/_static/a>", "<script src='//archive.org/includes/a.js'></script>", "<script>__wm.a</script>", "<script>archive_analytics</script>", I.TOOLBAR_BEGIN + "a" + I.TOOLBAR_END)
    pages = ["b".join([*[p] * 200, ""]) for p in parts]
    pages += ["c".join([*["".join(parts)] * 200, ""]), "<di" * 200 + parts[1] + "v id=wm-ipp></div>" * 200 + "d", I.TOOLBAR_BEGIN[:20] * 200 + parts[-1] + (I.TOOLBAR_BEGIN[20:] + I.TOOLBAR_END) * 200 + "e"]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, t string").select("id", I.strip_injection(F.col("t")).alias("s"), I.injection_removals(F.col("t")).alias("r"))
    for i, s, n in df.collect():
        text, removed = plain_whole(pages[i])
        assert (s.text, s.removed_nodes, s.removed_characters, s.residual) == (text, len(removed), sum(c for _, c in removed), []), i
        assert s.rules == n.rules == list(dict.fromkeys(rule for rule, _ in removed)) and n.removed_characters == s.removed_characters and len(text) in (200, 1), i


@pytest.mark.parametrize("part", [I.TOOLBAR_BEGIN + I.TOOLBAR_END, "<div id=wm-ipp></div>", "<script src='/_static/'></script>", "<link /_static/>", "<script>__wm.</script>", "<!--FILE ARCHIVED ON-->"])
def test_megabytes_of_removals(part):
    """Eight megabytes of parts go in seconds; a copy of the page for each would take minutes."""
    n = (8 << 20) // len(part)
    begin = time.perf_counter()
    text, removed = I.strip((part + "a") * n, math.inf)
    assert text == "a" * n and len(removed) == n and time.perf_counter() - begin < 40


def test_megabytes_of_removals_that_make_the_next():
    n = (8 << 20) // len("<div id=wm-ipp></div>")
    begin = time.perf_counter()
    text, removed = I.strip("<di" * n + "<div id=wm-ipp></div>" + "v id=wm-ipp></div>" * n, math.inf)
    assert text == "" and removed == [(I.ELEMENT, len("<div id=wm-ipp></div>"))] * (n + 1) and time.perf_counter() - begin < 40


PAGE = '<html><head><title>Demo</title><link rel="stylesheet" href="/style.css"></head><body><h1>Demo</h1><p>Text.</p></body></html>'
BAR = '<div id="wm-ipp-base"><div id="wm-ipp"><div id="x"></div></div></div>'
HEAD = '<script src="//archive.org/includes/a.js?c=true" type="text/javascript"></script><script>archive_analytics.x=1;</script><script type="text/javascript" src="//web.archive.org/_static/js/b.js" charset="utf-8"></script><script>__wm.init("x");</script><link rel="stylesheet" href="//web.archive.org/_static/c.css">'


def test_a_wrapped_page_is_what_it_was():
    wrapped = PAGE.replace("<head>", "<head>" + HEAD).replace("<body>", f"<body>{I.TOOLBAR_BEGIN}{BAR}{I.TOOLBAR_END}") + "<!--\n FILE ARCHIVED ON 12:00:00\n-->"
    text, removed = I.strip(wrapped)
    assert text == PAGE and {n for n, _ in removed} == set(I.ORDER) - {I.ELEMENT}
    assert I.strip(PAGE) == (PAGE, []) and I.strip(PAGE.replace("<body>", "<body>" + BAR)) == (PAGE, [(I.ELEMENT, len(BAR))])
    cut_off = PAGE + I.TOOLBAR_BEGIN + '<div id="wm-ipp">'
    assert I.strip(cut_off) == (cut_off, [])


def test_strip_of_a_column(spark):
    got = [r.s for r in spark.createDataFrame([(None,), (PAGE.replace("<body>", "<body>" + BAR),), (PAGE + I.TOOLBAR_BEGIN,)], "t string").coalesce(1).select(I.strip_injection(F.col("t")).alias("s")).collect()]
    assert (got[0].text, got[0].rules, got[0].removed_nodes) == (None, [], 0)
    assert (got[1].text, got[1].rules, got[1].removed_characters, got[1].residual) == (PAGE, [I.ELEMENT], len(BAR), []) and got[2].residual == ["WAYBACK TOOLBAR INSERT"]


def test_ports_of_any_length():
    assert [join_url(u, None) for u in ("http://a:" + "1" * 5000 + "/x", "http://a:٣/", "http://a:65536/", "http://a:0080/x", "http://a:/x", "http://a:000000443/", "http://a:0/")] == [None, None, None, "http://a/x", "http://a/x", "http://a:443/", "http://a:0/"]
