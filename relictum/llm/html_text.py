"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element, and every block of text below one, is a node with a hidden label: other, content, or mixed (an
element with blocks of both below it). A child's label depends on its parent's, by kind of node; a node's label explains
its observed features (tag and words of class and id, its parent's too, length, links, punctuation). Sum-product messages
pass from the leaves upward and from the root downward, which on a tree gives exact marginals; blocks whose marginal for
content is at least one half make the text. All tables are smoothed counts over labelled pages, added up by Spark.

Labelled pages are pairs of html and main text; a block is content if it is one of the blocks of the text, and labels of
elements follow from the blocks below. `sample_pages` makes such pairs by rule for use where none exist.

Defined cases: null and empty pages, and pages without text, give the empty text; broken markup is read as browsers do: an
open comment, script, style or tag holds the rest of the page, a head ends where content begins, a quotation mark that never
closes is part of a bare value; very long pages are read whole, in linear time; repeated rows give equal texts; columns
named like the added ones are replaced.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relictum.llm.common import text_udf

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
COMMENT_END = re.compile(r"-?>|--!?>")
STOP = re.compile(r"[>=]")
USUAL = re.compile(r"""(?:\s+[^\s"'=<>/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?+)*+\s*/?""")
SPACE, BARE = re.compile(r"\s*"), re.compile(r"[^\s>]*")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe object svg math head title select textarea button canvas audio video".split())
RAW = frozenset("script style title textarea noscript iframe template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot li dd dt legend figcaption summary".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
IN_HEAD = frozenset("html head meta title link script style base basefont bgsound template noscript noframes".split())
DEEP = 512
FENCE = frozenset("table ul ol dl div article section aside nav header footer main form body td th blockquote".split())


class Node:
    __slots__ = ("children", "features", "kind", "parent", "text")

    def __init__(self, parent: int, kind: str) -> None:
        self.parent, self.kind, self.features, self.text = parent, kind, [], None
        self.children: list[int] = []


def tag_end(page: str, at: int, open_ended: set[str]) -> int:
    """Place of the > that ends a tag whose attributes begin at `at`, or -1. Quoted values may hold one; a quotation mark that
    never closes is read as part of a bare value, and `open_ended` keeps such marks, so that they are looked for once."""
    first = page.find(">", at)
    if first < 0 or USUAL.fullmatch(page, at, first):
        return first
    while (m := STOP.search(page, at)) is not None:
        if m[0] == ">":
            return m.start()
        at = SPACE.match(page, m.end()).end()
        mark = page[at : at + 1]
        if mark in ("'", '"') and mark not in open_ended:
            if (close := page.find(mark, at + 1)) >= 0:
                at = close + 1
                continue
            open_ended.add(mark)
        at = BARE.match(page, at).end()
    return -1


def parse(page: str) -> list[Node]:
    """Elements and blocks in page order; a parent comes before its children. The time is linear in the page: elements
    below DEEP open ones are not nested further, though their text stays and their closing tags close nothing else."""
    nodes = [Node(-1, "root")]
    stack: list[tuple[str, int]] = [("", 0)]
    opened: defaultdict[str, int] = defaultdict(int)
    unnested: defaultdict[str, int] = defaultdict(int)
    pieces: list[str] = []
    linked = [0, 0]
    hidden = 0
    open_ended: set[str] = set()

    def flush() -> None:
        text = " ".join(html.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            owner = stack[-1][1]
            node = Node(owner, "block")
            node.text = text
            words, share = len(text.split()), linked[1] / max(1, linked[0] + linked[1])
            node.features = [f"words:{min(8, words.bit_length())}", f"links:{0 if not share else 1 if share < 0.3 else 2 if share < 0.8 else 3}", f"end:{'stop' if text[-1] in '.!?…:;' else 'letter' if text[-1].isalpha() else 'other'}", f"in:{nodes[owner].kind}"]
            nodes[owner].children.append(len(nodes))
            nodes.append(node)
        linked[:] = [0, 0]

    def shut(depth: int) -> None:
        nonlocal hidden
        if any(tag in BLOCK for tag, _ in stack[depth:]):
            flush()
        unnested.clear()
        for tag, _ in stack[depth:]:
            opened[tag] -= 1
            hidden -= tag in HIDDEN
        del stack[depth:]

    def innermost(wanted, fence) -> int:
        """Depth of the innermost open element of the wanted ones, 0 if a fence comes first or none is open."""
        if any(opened[t] > 0 for t in wanted):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in wanted:
                    return depth
                if stack[depth][0] in fence:
                    break
        return 0

    def leave_head() -> None:
        if opened["head"] and (depth := innermost(("head",), ())):
            shut(depth)

    def add(text: str) -> None:
        if stack[-1][0] == "head" and text and not text.isspace():
            leave_head()
        if text and not hidden:
            pieces.append(text)
            linked[opened["a"] > 0] += len(text.strip())

    at = 0
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        closing = page.startswith("</", lt)
        name = NAME.match(page, lt + 1 + closing)
        if not name:
            if page.startswith("<!--", lt):
                # the shortest comments end in their own opening mark
                end = COMMENT_END.match(page, lt + 4) or re.compile("--!?>").search(page, lt + 4)
                at = end.end() if end else len(page)
            elif closing or page[lt + 1 : lt + 2] in ("!", "?"):
                end = page.find(">", lt + 2)
                at = end + 1 if end >= 0 else len(page)
            else:
                add("<")
                at = lt + 1
            continue
        tag = name[0].lower()
        end = tag_end(page, name.end(), open_ended)
        if end < 0:  # a tag that never ends holds the rest of the page
            break
        attributes, at = page[name.end() : end], end + 1
        if closing:
            if tag == "br":
                add(" ")
            elif unnested[tag] > 0:
                unnested[tag] -= 1
                if tag in BLOCK:
                    flush()
            elif opened[tag] > 0 and (depth := innermost((tag,), () if tag in FENCE else FENCE)):
                shut(depth)
            continue
        if opened["head"] and tag not in IN_HEAD:
            leave_head()
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                add(" ")
            continue
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            end = page.find(">", found.end()) if found else -1
            at = end + 1 if end >= 0 else len(page)
            continue
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in BLOCK:
            flush()
        if opened["p"] > 0 and tag in CLOSES_P and (depth := innermost(("p",), FENCE)):
            shut(depth)
        if tag in SAME and (depth := innermost(SAME[tag], ("table", "ul", "ol", "dl"))):
            shut(depth)
        if len(stack) >= DEEP and (hidden or tag not in HIDDEN):
            unnested[tag] += 1
            continue
        if tag in BLOCK:
            node = Node(stack[-1][1], tag)
            words = [w.lower() for a in ATTRIBUTE.finditer(attributes) for w in WORD.findall(a[2] or a[3] or a[4] or "")]
            node.features = [f"tag:{tag}", *(f"name:{w}" for w in dict.fromkeys(words))]
            nodes[node.parent].children.append(len(nodes))
            nodes.append(node)
            stack.append((tag, len(nodes) - 1))
        else:
            stack.append((tag, stack[-1][1]))
        opened[tag] += 1
        hidden += tag in HIDDEN
    flush()
    return without_chains(nodes)


def without_chains(nodes: list[Node]) -> list[Node]:
    """An element that is its parent's only child and says nothing that the parent does not (the same tag, no names) becomes one
    with it, so that beliefs do not fade along wrappers within wrappers."""
    kept: list[Node] = []
    place: list[int] = []
    for node in nodes:
        up = nodes[node.parent] if node.parent >= 0 else None
        if up is not None and node.text is None and len(up.children) == 1 and node.features == up.features and len(node.features) == 1:
            place.append(place[node.parent])
            continue
        place.append(len(kept))
        if up is not None:
            node.parent = place[node.parent]
        kept.append(node)
    for node in kept:
        node.children = []
    for i, node in enumerate(kept):
        if node.parent >= 0:
            kept[node.parent].children.append(i)
    return kept


def node_kind(kind: str) -> str:
    return kind if kind in ("block", "root") else "element"


def inherited(parent: Node) -> list[str]:
    """What a node shows its children: its tag and names, marked as the parent's."""
    return ["up:" + f for f in parent.features if not f.startswith(("up:", "words:"))]


def observed(nodes: list[Node], i: int) -> list[str]:
    return nodes[i].features + (inherited(nodes[nodes[i].parent]) if nodes[i].parent >= 0 else [])


OTHER, CONTENT, MIXED = range(3)
States = tuple[float, float, float]


def scaled(x: list[float]) -> States:
    total = sum(x) or 1.0
    return x[0] / total, x[1] / total, x[2] / total


@dataclass(frozen=True)
class DomModel:
    """Log chances of each feature by label, and for each kind of node the chances of its labels below each label."""

    features: dict[str, States]
    below: dict[str, tuple[States, States, States]]
    root: States = (0.05, 0.05, 0.9)

    def total(self, features: list[str]) -> list[float]:
        sums = [0.0, 0.0, 0.0]
        for f in features:
            if (known := self.features.get(f)) is not None:
                sums = [a + b for a, b in zip(sums, known, strict=True)]
        return sums

    def evidence(self, nodes: list[Node]) -> list[States]:
        """What the features of each node say; those that children see of a parent are added up once."""
        above: dict[int, list[float]] = {-1: [0.0, 0.0, 0.0]}
        out = []
        for node in nodes:
            if node.parent not in above:
                above[node.parent] = self.total(inherited(nodes[node.parent]))
            sums = [a + b for a, b in zip(self.total(node.features), above[node.parent], strict=True)]
            top = max(sums)
            out.append(scaled([math.exp(max(-500.0, x - top)) for x in sums]))
        return out

    def marginals(self, nodes: list[Node]) -> list[States]:
        """Chances of the labels of each node."""
        up = self.evidence(nodes)
        message: list[States] = [(1.0, 1.0, 1.0)] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            table, j = self.below[node_kind(nodes[i].kind)], nodes[i].parent
            message[i] = scaled([sum(p * x for p, x in zip(row, up[i], strict=True)) for row in table])
            up[j] = scaled([a * b for a, b in zip(up[j], message[i], strict=True)])
        down: list[States] = [self.root] * len(nodes)
        out = []
        for i, node in enumerate(nodes):
            own = scaled([a * b for a, b in zip(up[i], down[i], strict=True)])
            out.append(own)
            for c in node.children:  # the parent's belief without what this child told it
                rest = [x / max(m, 1e-300) for x, m in zip(own, message[c], strict=True)]
                table = self.below[node_kind(nodes[c].kind)]
                down[c] = scaled([sum(rest[s] * table[s][t] for s in range(3)) for t in range(3)])
        return out

    def extract(self, page: str) -> str:
        nodes = parse(page)
        return "\n\n".join(n.text for n, p in zip(nodes, self.marginals(nodes), strict=True) if n.text is not None and p[CONTENT] >= 0.5)


def label_nodes(nodes: list[Node], text: str) -> list[int | None]:
    """Labels; None for an element without text below it."""
    wanted = Counter(text.split("\n\n"))
    labels: list[int | None] = [None] * len(nodes)
    for i, node in enumerate(nodes):
        if node.text is not None:
            labels[i] = OTHER
            if wanted[node.text] > 0:
                wanted[node.text] -= 1
                labels[i] = CONTENT
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i].text is None:
            found = {labels[c] for c in nodes[i].children} - {None}
            labels[i] = None if not found else found.pop() if len(found) == 1 else MIXED
    return labels


def count_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(what, parent's label, label, count) of one task."""
    total: Counter = Counter()
    for batch in batches:
        for page, text in zip(batch.column("html").to_pylist(), batch.column("text").to_pylist(), strict=True):
            nodes = parse(page or "")
            labels = label_nodes(nodes, text or "")
            for i in range(1, len(nodes)):
                if labels[i] is not None:
                    total[f"kind:{node_kind(nodes[i].kind)}", labels[nodes[i].parent], labels[i]] += 1
                    for f in observed(nodes, i):
                        total[f, -1, labels[i]] += 1
    keys = list(total)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([total[k] for k in keys], pa.int64())], names=["what", "above", "label", "n"])


def fit_dom_model(labelled: DataFrame, *, least_count: int = 3, max_features: int = 20_000) -> DomModel:
    """`labelled` has html and text. Rare features are left out, and at most `max_features` stay, so the model is small."""
    cells = [F.coalesce(F.sum(F.when((F.col("above") == a) & (F.col("label") == b), F.col("n"))), F.lit(0)) for a in (-1, 0, 1, 2) for b in range(3)]
    counts = labelled.select(F.col("html").cast("string"), F.col("text").cast("string")).mapInArrow(count_pages, "what string, above int, label int, n long").groupBy("what").agg(F.array(*cells).alias("n"), F.sum("n").alias("total"))
    kinds = F.col("what").startswith("kind:")
    rows = counts.where(kinds | (F.col("total") >= least_count)).orderBy(F.desc(kinds), F.desc("total"), "what").limit(max_features).collect()
    below = {k: tuple((1 / 3, 1 / 3, 1 / 3) for _ in range(3)) for k in ("element", "block")}
    size = {"element": [3.0, 3.0, 3.0], "block": [3.0, 3.0, 3.0]}
    for r in rows:
        if r.what.startswith("kind:"):
            kind = r.what[5:]
            table = [[r.n[3 + 3 * a + b] + (0.5 if kind == "element" or b != MIXED else 0.0) for b in range(3)] for a in range(3)]
            below[kind] = tuple(scaled(row) for row in table)
            size[kind] = [sum(table[a][b] for a in range(3)) + 1 for b in range(3)]
    features = {}
    for r in rows:
        if not r.what.startswith("kind:"):
            kind = "block" if r.what.startswith(("words:", "links:", "end:", "in:")) else "element"
            total = size[kind] if not r.what.startswith("up:") else [a + b for a, b in zip(size["element"], size["block"], strict=True)]
            features[r.what] = tuple(math.log((r.n[b] + 0.5) / (total[b] + 1)) for b in range(3))
    return DomModel(features, below)


#: Ways to write each part of a made page: tag and attributes.
PARTS = {
    "header": [("header", ""), ("div", 'id="header"'), ("div", 'class="site-header"'), ("div", 'class="top-bar masthead"')],
    "nav": [("nav", ""), ("div", 'class="nav"'), ("ul", 'class="menu"'), ("div", 'class="breadcrumbs"'), ("nav", 'role="navigation"')],
    "ad": [("div", 'class="ad"'), ("div", 'class="advert"'), ("aside", 'class="ads sponsored"'), ("div", 'id="banner"'), ("div", 'class="promo"'), ("section", 'class="advertisement"')],
    "aside": [("aside", ""), ("div", 'class="sidebar"'), ("aside", 'class="related"'), ("div", 'class="widget"'), ("div", 'id="side"')],
    "notice": [("div", 'class="cookie-notice"'), ("div", 'class="notice"'), ("div", 'role="alert"'), ("div", 'class="consent banner"'), ("section", 'class="newsletter subscribe"')],
    "form": [("form", ""), ("form", 'class="search"'), ("form", 'id="login"')],
    "comments": [("section", 'class="comments"'), ("div", 'id="comments"'), ("div", 'class="comment-list replies"'), ("ol", 'class="commentlist"')],
    "footer": [("footer", ""), ("div", 'id="footer"'), ("div", 'class="site-footer"'), ("footer", 'role="contentinfo"')],
    "article": [("article", ""), ("article", 'class="post"'), ("div", 'class="article-body"'), ("div", 'class="entry-content"'), ("main", ""), ("div", 'id="content"'), ("section", 'class="story"'), ("main", 'role="main"')],
}


def made_page(seed: int) -> tuple[str, str]:
    """A page and its main text, by rule."""
    r = random.Random(seed)
    letters = "eeeaaoinrstlhducmpg"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(2, 9)))

    def sentence() -> str:
        return " ".join(word() for _ in range(r.randint(1, 18))).capitalize() + r.choice("....!?")

    def paragraph() -> str:
        return " ".join(sentence() for _ in range(r.choice((1, 1, 2, 4, 8))))

    def wrap(part: str, inner: str) -> str:
        tag, names = r.choice(PARTS[part])
        return f"<{tag}{' ' * bool(names)}{names}>{inner}</{tag}>"

    def links(n: int) -> str:
        each = [f'<a href="/{word()}">{" ".join(word() for _ in range(r.randint(1, 3)))}</a>' for _ in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in each) + "</ul>" if r.random() < 0.7 else " | ".join(each)

    def boilerplate(part: str) -> str:
        if part == "nav":
            return wrap(part, links(r.randint(2, 8)))
        if part == "header":
            return wrap(part, f"<h1>{word()}</h1>" * (r.random() < 0.3) + f"<p>{sentence()}</p>" * (r.random() < 0.5) + links(r.randint(0, 5)))
        if part == "aside":
            return wrap(part, f"<h3>{word()}</h3>" + r.choice((links(4), f"<p>{paragraph()}</p>")))
        if part == "form":
            return wrap(part, f'<label>{word()}</label><input name="q"><p>{sentence()}</p>' + "<button>Go</button>")
        if part == "comments":
            return wrap(part, "<h2>Comments</h2>" * (r.random() < 0.5) + "".join(f'<div class="comment"><b>{word()}</b><p>{paragraph()}</p></div>' for _ in range(r.randint(1, 4))))
        if part == "footer":
            return wrap(part, r.choice((f"&copy; {word()}.example &middot; {sentence()}", f"<p>{sentence()}</p>", links(4))))
        return wrap(part, r.choice((sentence(), f"<p>{paragraph()}</p>", f'<p>{sentence()} <a href="/x">{word()}</a></p>')))

    blocks: list[str] = []
    body: list[str] = []
    title = sentence()
    for i in range(r.randint(1, 12)):
        kind = "h1" if not i and r.random() < 0.7 else r.choice(("p", "p", "p", "p", "p", "h2", "ul", "blockquote", "bold", "ad"))
        if kind == "ad":
            body.append(boilerplate(r.choice(("ad", "aside", "notice", "form"))) if r.random() < 0.4 else "")
        elif kind == "ul":
            items = [sentence() for _ in range(r.randint(1, 5))]
            body.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            blocks += items
        elif kind == "bold":
            first, second = sentence(), paragraph()
            body.append(f"<p><b>{first}<br><p>{second}</p>")
            blocks += [first, second]
        else:
            text = title if kind == "h1" else sentence() if kind == "h2" else paragraph()
            if kind == "p" and r.random() < 0.2:
                text += " " + word()
                body.append(f'<p>{text.rpartition(" ")[0]} <a href="/y">{text.rpartition(" ")[2]}</a></p>')
            else:
                body.append(f"<{kind}>{text}</{kind}>")
            blocks.append(text)
    if r.random() < 0.2:
        body.append(boilerplate("comments"))
    article = wrap("article", "".join(body))
    if r.random() < 0.3:
        article = f'<div class="{r.choice(("wrapper", "container", "row", "page"))}">{article}{boilerplate("aside") * (r.random() < 0.5)}</div>'
    above = [boilerplate(x) for x in ("header", "nav", "notice", "ad", "form") if r.random() < 0.5]
    under = [boilerplate(x) for x in ("comments", "aside", "ad", "form") if r.random() < 0.35]
    page = f"<!DOCTYPE html><html><head><title>{title}</title><script>var t='<p>';</script></head><body>{''.join(above)}{article}{''.join(under)}{boilerplate('footer') if r.random() < 0.8 else ''}</body></html>"
    return page, "\n\n".join(blocks)


def sample_pages(spark: SparkSession, n: int = 600) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [made_page(i) for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.string()), pa.array([t for _, t in made], pa.string())], names=["html", "text"])

    return spark.range(n).mapInArrow(make, "html string, text string")


def extract_text(pages: DataFrame, model: DomModel, *, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """`pages` with the main text of each."""

    def run(texts: list[str]) -> pa.Array:
        return pa.array([model.extract(x) for x in texts], pa.string())

    return pages.withColumn(text_col, text_udf(run, "string")(F.col(html_col)))
