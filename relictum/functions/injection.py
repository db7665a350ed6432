"""Markup that an archive's replay adds to a page, taken out again."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from relictum.functions.markup import INJECTION_MARKERS, has_injection

MOST_REMOVALS = 64  # the original's bound; no column or query has one
# The names of the rules, in their order, with the texts that a removed part holds.
TOOLBAR_BEGIN, TOOLBAR_END = "<!-- BEGIN WAYBACK TOOLBAR INSERT -->", "<!-- END WAYBACK TOOLBAR INSERT -->"
INSERT, ARCHIVED, ELEMENT = "wayback-toolbar-insert", "file-archived-comment", "wayback-toolbar-element"
STATIC_SCRIPT, STATIC_STYLE, ANALYTICS = "replay-static-script", "replay-static-stylesheet", "replay-analytics-script"
INIT, INLINE = "replay-init-script", "replay-analytics-inline-script"
HOLDS = {ARCHIVED: "FILE ARCHIVED ON", STATIC_SCRIPT: "/_static/", STATIC_STYLE: "/_static/", ANALYTICS: "archive.org/includes/", INIT: "__wm.", INLINE: "archive_analytics"}
# Pieces of markup that the scans look for.
OPENING = {tag: re.compile(rf"(?i)<{tag}\b") for tag in ("div", "script", "link")}
TOOLBAR_ID = re.compile(r"""(?i)\bid\s*=\s*["']?wm-ipp""")
DIV_EDGE = re.compile(r"(?i)<div\b|</div\s*>")
SOURCE = re.compile(r"""(?i)\bsrc\s*=\s*["']""")
QUOTE = re.compile("[\"']")
SCRIPT_END = re.compile("(?i)</script>")
EMPTY_END = re.compile(r"(?i)\s*</script>")

Span = tuple[int, int]


def inserts(text: str, at: int, tail: str) -> Span | None:
    """The next insert in `tail` and what follows from `at` on. One that begins in the tail starts as far before `at`."""
    joint = (tail + text[at : at + len(TOOLBAR_BEGIN) - 1]).find(TOOLBAR_BEGIN)
    start = at - len(tail) + joint if joint >= 0 else text.find(TOOLBAR_BEGIN, at)
    end = text.find(TOOLBAR_END, start + len(TOOLBAR_BEGIN)) if start >= 0 else -1
    return (start, end + len(TOOLBAR_END)) if end >= 0 else None


def elements(text: str, at: int, tail: str) -> Span | None:
    """The next toolbar element with all that it holds, as `inserts` gives it; None if there is none or it never closes. Openings that
    share the end of a tag share their fate, so each end is tried once."""
    joint = OPENING["div"].search(tail + text[at : at + len("<div")])
    start = at - len(tail) + joint.start() if joint and joint.start() < len(tail) else -1
    while True:
        if start < 0 and (opening := OPENING["div"].search(text, at)):
            start = opening.start()
        if start < 0 or (end := text.find(">", start + len("<div"))) < 0:
            return None
        at = end + 1
        if TOOLBAR_ID.search(text, start + len("<div"), end):
            break
        start = -1
    depth = 1
    for edge in DIV_EDGE.finditer(text, at):
        depth += -1 if edge[0][1] == "/" else 1
        if not depth:
            return start, edge.end()
    return None


def ending(text: str, kept: list[Span], reach: int) -> str:
    tail = ""
    for start, end in reversed(kept):
        if len(tail) == reach:
            break
        tail = text[max(start, end - reach + len(tail)) : end] + tail
    return tail


def without(text: str, scan: Callable[[str, int, str], Span | None], reach: int, most: float) -> tuple[str, list[int]]:
    """The text without what a scan finds, and the size of each part. After a removal the scan sees as much before it as an opening may
    reach that the two sides make together. Spans of the text are kept, so no removal copies it."""
    kept: list[Span] = []
    sizes: list[int] = []
    at = 0
    while len(sizes) < most and (found := scan(text, at, ending(text, kept, reach))):
        start, end = found
        sizes.append(end - start)
        if start > at:
            kept.append((at, start))
        over = at - start
        while over > 0:
            first, last = kept.pop()
            if last - first > over:
                kept.append((first, last - over))
            over -= last - first
        at = end
    return "".join([*(text[a:b] for a, b in kept), text[at:]]), sizes


def comments(text: str) -> Iterator[Span]:
    at = 0
    while (start := text.find("<!--", at)) >= 0 and (end := text.find("-->", start + 4)) >= 0:
        at = end + 3
        yield start, at


def tags(text: str) -> Iterator[Span]:
    at = 0
    while (opening := OPENING["link"].search(text, at)) and (end := text.find(">", opening.end())) >= 0:
        at = end + 1
        yield opening.start(), at


def scripts(text: str) -> Iterator[Span]:
    at = 0
    while (opening := OPENING["script"].search(text, at)) and (end := text.find(">", opening.end())) >= 0 and (close := SCRIPT_END.search(text, end + 1)):
        at = close.end()
        yield opening.start(), at


def sourced_scripts(text: str) -> Iterator[Span]:
    """Scripts with a quoted source and nothing inside. The value may hold the end of a tag; of several sources in one tag the last
    that fits counts. Openings that share the end of a tag share their sources."""
    at = 0
    ends: dict[int, int] = {}  # by the place after a tag, where an empty script ends; 0 if it does not
    while (opening := OPENING["script"].search(text, at)) and (edge := text.find(">", opening.end())) >= 0:
        at = edge + 1
        for source in reversed(list(SOURCE.finditer(text, opening.end(), edge))):
            quote = QUOTE.search(text, source.end())
            close = 0 if not quote else edge + 1 if quote.end() <= edge else text.find(">", quote.end()) + 1
            if not close:
                continue
            if close not in ends:
                found = EMPTY_END.match(text, close)
                ends[close] = found.end() if found else 0
            if ends[close]:
                at = ends[close]
                yield opening.start(), at
                break


AGAIN = {INSERT: (inserts, len(TOOLBAR_BEGIN) - 1), ELEMENT: (elements, len("<div") - 1)}
ONCE = {ARCHIVED: comments, STATIC_SCRIPT: sourced_scripts, STATIC_STYLE: tags, ANALYTICS: sourced_scripts, INIT: scripts, INLINE: scripts}
ORDER = (INSERT, ARCHIVED, ELEMENT, STATIC_SCRIPT, STATIC_STYLE, ANALYTICS, INIT, INLINE)


def strip(text: str, most: float = MOST_REMOVALS) -> tuple[str, list[tuple[str, int]]]:
    """The page without injected parts, and (rule, characters) of each removal. Every rule is one scan from left to right. A rule ends
    after `most` removals, and so does the list of rules; with `math.inf` all that any rule finds goes."""
    removed: list[tuple[str, int]] = []
    for name in ORDER:
        if len(removed) >= most:
            break
        if name in AGAIN:
            text, sizes = without(text, *AGAIN[name], most)
            removed.extend((name, n) for n in sizes)
            continue
        parts, at = [], 0
        for start, end in ONCE[name](text):
            if len(parts) == most:
                break
            if text.find(HOLDS[name], start, end) >= 0:
                parts.append(text[at:start])
                removed.append((name, end - start))
                at = end
        text = "".join([*parts, text[at:]])
    return text, removed


def injectable(text: Column) -> Column:
    """Whether a rule may find anything. Not every rule looks for one of the markers as it is written."""
    return has_injection(text) | text.contains(HOLDS[ANALYTICS]) | text.rlike("(?iu)wm-ipp")


STRIPPED = "text string, rules array<string>, removed_nodes int, removed_characters long, residual array<string>"


#: Pages that are text in Python at one time; a batch may hold thousands.
AT_ONCE = 64


def by_pieces(texts: pa.Array, row: Callable[[str | None], tuple], kinds: dict[str, pa.DataType]) -> pa.Array:
    """`row` of each text as a struct, a few texts at a time."""
    pieces = []
    for at in range(0, max(len(texts), 1), AT_ONCE):
        rows = [row(t) for t in texts.slice(at, AT_ONCE).to_pylist()]
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        pieces.append(pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds)))
    return pa.concat_arrays(pieces)


def strip_injection(text: Column) -> Column:
    """Vectorised; only pages that hold a marker need it, so callers test `has_injection` first."""

    def stripped(t: str | None) -> tuple:
        if t is None:
            return None, [], 0, 0, []
        clean, removed = strip(t, math.inf)
        return clean, list(dict.fromkeys(n for n, _ in removed)), len(removed), sum(c for _, c in removed), [m for m in INJECTION_MARKERS if m in clean]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = {"text": pa.string(), "rules": pa.list_(pa.string()), "removed_nodes": pa.int32(), "removed_characters": pa.int64(), "residual": pa.list_(pa.string())}
        for texts in batches:
            yield by_pieces(texts, stripped, kinds)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, STRIPPED)(text)


def injection_removals(text: Column) -> Column:
    """What `strip_injection` would remove, for those who do not need the page: rules and removed_characters."""

    def removals(t: str | None) -> tuple:
        removed = strip(t, math.inf)[1] if t is not None else []
        return list(dict.fromkeys(n for n, _ in removed)), sum(c for _, c in removed)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield by_pieces(texts, removals, {"rules": pa.list_(pa.string()), "removed_characters": pa.int64()})

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "rules array<string>, removed_characters long")(text)
