"""Untrusted markup read with patterns: tags, text, markers, redirects.

Pages are hostile until shown otherwise, so no search may start anew at every opening that never closes. Each helper first
cuts a page where nothing that closes is left, or sets aside openings that no closing follows; whatever a pattern then begins to
match, it matches, and the work is linear in the page.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from relictum.functions.url import sha256

MARKER_WINDOW = 4096
FINGERPRINT_CHARS, FINGERPRINT_LEAST = 2048, 24
# Markers, in the order in which the first match is reported.
ARCHIVE_ERROR_MARKERS = ("Wayback Machine has not archived that URL", "Got an HTTP 30", "This content is not available in the Wayback Machine", "The Wayback Machine has not archived that URL", "Hrm.", "job failed")
PARKED_MARKERS = ("this domain is for sale", "buy this domain", "this domain name is parked", "parked free, courtesy of", "this domain name has expired")
SOFT_404_MARKERS = ("404", "not found", "page cannot be found", "no such page")
INJECTION_MARKERS = ("wm-ipp", "/_static/", "WAYBACK TOOLBAR INSERT", "__wm.", "archive_analytics", "FILE ARCHIVED ON")
# Patterns of the markup that is read.
COMMENT = r"(?s)<!--.*?-->"
TAG = "<[^>]*>"
SCRIPT_OR_STYLE = r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>"
TITLE_ELEMENT = r"(?is)<(title)\b[^>]*>.*?</\1\s*>"
BLOCK_BOUNDARY = r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|tr|td|th|table|h[1-6]|blockquote|pre|section|article|header|footer|nav|aside|form|center|address)\b[^>]*>"
META = r"(?i)<meta\b[^>]*>"
REFRESH = r"""(?i)http-equiv\s*=\s*["']?refresh"""
REFRESH_CONTENT = r"""(?i)content\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""
REFRESH_URL = r"""(?i)url\s*=\s*["']?([^"';>]+)"""
SCRIPT_BLOCK = r"(?is)<script\b[^>]*>(.*?)</script\s*>"
SCRIPT_LOCATION = r"""(?i)(?:window|document|self|top)?\.?location(?:\.href|\.replace)?\s*[=(]\s*["']([^"']+)["']"""
SCHEME = r"(?<![a-z][0-9+.-]{0,64})[a-z][a-z0-9+.-]*+://\S+"
FRAMESET = r"(?i)<frameset\b"
HTML_HEAD = r"(?i)^\s*(?:<!doctype html|<html|<head|<body|<!--)"


#: Stands for "<" of openings that are set aside (a code point that is no character); doubled where a page itself has it.
ASIDE = "\ufdd0"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def to_last(text: Column, mark: str) -> Column:
    """The text up to its last `mark`, which is included; empty without one."""
    return F.substr(text, F.lit(1), F.length(text) - F.when(text.contains(mark), F.length(F.substring_index(text, mark, -1))).otherwise(F.length(text)))


def replace_closed(text: Column, pattern: str, closing: str) -> Column:
    """Matches of a pattern that ends in `closing`, and that every opening before the last `closing` completes, become a space."""
    return let(text, lambda t: let(to_last(t, closing), lambda h: F.concat(F.regexp_replace(h, pattern, " "), F.substr(t, F.length(h) + 1))))


def drop_comments(text: Column) -> Column:
    return replace_closed(text, COMMENT, "-->")


def drop_tags(text: Column) -> Column:
    return replace_closed(text, TAG, ">")


def set_aside(text: Column, tag: str) -> Column:
    """`text` with the "<" of each opening of an element that never closes replaced: those after the last end of a tag that a closing
    tag follows."""

    def split(t: Column) -> Column:
        live = to_last(F.regexp_extract(t, rf"(?is)^(.*)</{tag}\s*>", 1), ">")
        return let(live, lambda h: F.concat(h, F.regexp_replace(F.substr(t, F.length(h) + 1), rf"(?i)<(?={tag}\b)", ASIDE + "1")))

    return let(text, split)


def with_closed(text: Column, tags: tuple[str, ...], use: Callable[[Column], Column]) -> Column:
    """`use` of the text in which only openings of `tags` that close are left as they stand."""
    held = F.replace(text, F.lit(ASIDE), F.lit(ASIDE + "0"))
    for tag in tags:
        held = set_aside(held, tag)
    return use(held)


def put_back(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ASIDE + "1"), F.lit("<")), F.lit(ASIDE + "0"), F.lit(ASIDE))


def drop_elements(text: Column, pattern: str, *tags: str) -> Column:
    return with_closed(text, tags, lambda t: put_back(F.regexp_replace(t, pattern, " ")))


def closed_tags(text: Column, pattern: str) -> Column:
    """All tags that a pattern of the form <name...[^>]*> matches."""
    return let(text, lambda t: F.regexp_extract_all(to_last(t, ">"), F.lit(pattern), F.lit(0)))


def element_text(text: Column, tag: str, most: int) -> Column:
    """What the first `tag` element of at most `most` characters holds; empty without one. Openings that share an end share their
    fate, so each end of a tag is tried once."""
    pattern = rf"(?is)<{tag}\b[^>]*>(?:.{{0,{most}}}?</{tag}\s*>)?"
    closed = F.filter(closed_tags(text, pattern), lambda x: x.rlike(rf"(?i)</{tag}\s*>$"))
    return F.when(text.isNotNull(), F.coalesce(F.regexp_extract(F.get(closed, 0), rf"(?is)^<{tag}\b[^>]*>(.{{0,{most}}}?)</{tag}\s*>", 1), F.lit("")))


def first_marker(text: Column, markers: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(text.contains(m), F.lit(m)) for m in markers])


def head(text: Column) -> Column:
    return F.substring(text, 1, MARKER_WINDOW)


def archive_error_marker(text: Column) -> Column:
    return first_marker(head(text), ARCHIVE_ERROR_MARKERS)


def parked_marker(text: Column) -> Column:
    return first_marker(F.lower(head(text)), PARKED_MARKERS)


def has_injection(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(m) for m in INJECTION_MARKERS])


def injection_markers(text: Column) -> Column:
    return F.filter(F.array(*[F.when(text.contains(m), F.lit(m)) for m in INJECTION_MARKERS]), lambda x: x.isNotNull())


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_markup(text: Column) -> Column:
    return collapse(F.lower(drop_tags(drop_elements(drop_comments(text), SCRIPT_OR_STYLE, "script", "style"))))


def strip_tags(text: Column) -> Column:
    return F.lower(collapse(F.regexp_replace(drop_tags(text), "(?i)&nbsp;", " ")))


def blocks(text: Column) -> Column:
    """`text` split at the edges of blocks."""

    def split(t: Column, head: Column) -> Column:
        parts = F.split(head, BLOCK_BOUNDARY)
        return F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(F.concat(F.element_at(parts, -1), F.substr(t, F.length(head) + 1))))

    return let(text, lambda t: let(to_last(t, ">"), lambda h: split(t, h)))


def segments(text: Column) -> Column:
    """The visible blocks of a page, repeats included, in order."""
    bare = drop_elements(drop_elements(drop_comments(text), SCRIPT_OR_STYLE, "script", "style"), TITLE_ELEMENT, "title")
    return F.filter(F.transform(blocks(bare), strip_tags), lambda s: s != "")


def title_text(text: Column) -> Column:
    return strip_tags(element_text(text, "title", 400))


def error_fingerprint(text: Column) -> Column:
    """A hash of the letters of a page, without addresses and paths; null if too little is left. The text and its letters are worked
    out once, and addresses looked for where there may be one."""
    plain = let(strip_markup(text), lambda t: F.when(t.contains("://"), F.regexp_replace(t, SCHEME, " ")).otherwise(t))
    letters = F.substring(collapse(F.regexp_replace(F.regexp_replace(plain, r"/\S+", " "), "[^a-z ]+", " ")), 1, FINGERPRINT_CHARS)
    return let(letters, lambda x: F.when(F.length(x) >= FINGERPRINT_LEAST, sha256(x)))


def soft_404_marker(text: Column) -> Column:
    window = head(text)
    labels = [strip_markup(element_text(window, tag, 200)) for tag in ("title", "h1")]
    return F.coalesce(*[let(x, lambda label: first_marker(label, SOFT_404_MARKERS)) for x in labels])


def unquote(text: Column) -> Column:
    return F.regexp_replace(text, r"""^["']|["']$""", "")


def redirect_target(text: Column) -> Column:
    """The first refresh of a page, else the first location that a script assigns, as written; with the mechanism."""
    metas = F.filter(closed_tags(text, META), lambda t: t.rlike(REFRESH))
    content = F.transform(metas, lambda t: F.trim(F.regexp_extract(unquote(F.regexp_extract(t, REFRESH_CONTENT, 1)), REFRESH_URL, 1)))
    meta = F.get(F.filter(content, lambda u: u != ""), 0)
    found = with_closed(text, ("script",), lambda t: F.regexp_extract_all(t, F.lit(SCRIPT_BLOCK), F.lit(1)))
    scripts = F.transform(found, lambda s: F.regexp_extract(put_back(s), SCRIPT_LOCATION, 1))
    script = F.get(F.filter(scripts, lambda u: F.trim(u) != ""), 0)
    return F.when(meta.isNotNull(), F.struct(meta.alias("raw"), F.lit("meta-refresh").alias("mechanism"))).when(script.isNotNull(), F.struct(script.alias("raw"), F.lit("script-location").alias("mechanism")))


def decode_entities(value: Column) -> Column:
    """Five references, the ampersand first."""
    for pattern, plain in (("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("&#39;", "'")):
        value = F.regexp_replace(value, pattern, plain)
    return value


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value; null if the tag lacks it."""
    pattern = rf"""(?i)\b{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""
    return F.when(tag.rlike(pattern), F.trim(decode_entities(unquote(F.regexp_extract(tag, pattern, 1)))))


def validation_failure(text: Column, relation: Column, content_type: Column, byte_length: Column, truncated: Column, binary_reason: Column) -> Column:
    """(kind, message) of the first check that a body fails; null if it passes. `text` is null for a binary body."""
    # Kinds and messages, in the order in which they are tried.
    fail = lambda kind, *parts: F.struct(F.lit(kind).alias("kind"), F.concat(*parts).alias("message"))
    marker = archive_error_marker(text)
    return (
        F.when(truncated, fail("oversized-body", F.lit("body exceeded the response byte cap after "), byte_length.cast("string"), F.lit(" bytes")))
        .when(byte_length == 0, fail("empty-body", F.lit("response carried no bytes")))
        .when(marker.isNotNull(), fail("archive-error-page", F.lit('provider error document detected by marker "'), marker, F.lit('"')))
        .when(relation.isin("image", "media", "object") & text.rlike(HTML_HEAD), fail("content-type-mismatch", relation, F.lit(" URL returned markup instead of binary content (content-type "), F.coalesce(content_type, F.lit("absent")), F.lit(")")))
        .when(relation.isin("page", "frame") & binary_reason.isNotNull(), fail("content-type-mismatch", F.lit("page URL returned binary content ("), binary_reason, F.lit(")")))
    )
