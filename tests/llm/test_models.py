"""Quality, toxicity, page text, embeddings, mixing and the pipeline."""

from __future__ import annotations

import random
import zlib
from pathlib import Path

import numpy as np
import pyspark.sql.functions as F
import pytest

from relictum.llm import toxicity as T
from relictum.llm.common import connected_components, held_out, materialize
from relictum.llm.embedding_dedup import embedding_components, near_tiles
from relictum.llm.html_text import extract_text, fit_dom_model, label_nodes, made_page, parse, sample_pages
from relictum.llm.mixing import mix_sources, rake
from relictum.llm.quality import FEATURES, fit_quality, score_quality, statistics

from relictum.workspace import clear_tables, own_folder

from .conftest import words

SF = "/root/testdata/sf0.01"


def test_held_out_is_the_checksum(spark):
    ids = [0, 1, 7, 99, 123456]
    got = spark.createDataFrame([(i,) for i in [*ids, None]], "doc_id long").select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)


def test_components_of_a_path_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(5, 5), (3, 2)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {100 + i: 100 for i in range(1, 40)} | {200 + i: 200 for i in range(1, 9)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tables_can_be_cleared(spark, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir")
    kept = materialize(spark.range(3), "t")
    assert kept.count() == 3 and before == spark.conf.get("spark.checkpoint.dir")
    clear_tables(spark)
    assert not Path(own_folder(spark).removeprefix("file://")).exists()


# quality


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_quality(docs, fit_quality(docs, labels)).where(held_out(F.col("doc_id"))).join(labels, "doc_id")
    right = scored.select(F.avg(((F.col("score") >= 0.3).cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.95


def test_scores_are_those_of_a_plain_discriminant(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(docs, labels)
    known = docs.join(labels, "doc_id").where(~held_out(F.col("doc_id"))).select("text", "quality").collect()
    x, y = np.array([statistics(r.text) for r in known]), np.array([r.quality for r in known])
    pooled = sum((y == k).sum() * np.cov(x[y == k].T, bias=True) for k in (0, 1)) / len(y)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    density = []
    for k in (0, 1):
        own = np.cov(x[y == k].T, bias=True) / np.outer(scale, scale)
        cov = 0.88 * own + 0.1 * pooled / np.outer(scale, scale) + (0.02 * np.trace(own) / FEATURES + 1e-4) * np.eye(FEATURES)
        away = (x - x[y == k].mean(0)) / scale
        density.append(np.log(((y == k).sum() + 1) / (len(y) + 2)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (away @ np.linalg.inv(cov) * away).sum(1))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500))), atol=1e-6)


def test_labels_that_disagree_are_left_out(spark):
    from relictum.llm.common import drawn_labels

    learnt = [i for i in range(80) if zlib.crc32(str(i).encode()) % 5]
    one, two = [i for i in learnt if i % 2][:2]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(one, 0), (two, 1)], "doc_id long, quality int")
    drawn, n, share = drawn_labels(labels, "quality", 10**6)
    assert sorted(r.doc_id for r in drawn.collect()) == [i for i in learnt if i != one] and sum(n) == len(learnt) - 1 and share == [1.0, 1.0]


def test_quality_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, None), (None, 1), (6, 7)], "doc_id long, quality int")
    for docs in (odd_docs, odd_docs.withColumn("score", F.lit("x"))):
        scores = [r.score for r in score_quality(docs, fit_quality(docs, labels)).collect()]
        assert len(scores) == len(odd_rows) and all(0 <= s <= 1 for s in scores)
    model = fit_quality(no_docs, labels)
    assert model.mean is None and score_quality(no_docs, model).count() == 0
    assert len(statistics("")) == FEATURES and all(np.isfinite(statistics("")))


# toxicity


def plain_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_automaton_matches_edit_distance():
    terms = ["idiot$", "pathetic$", "disgusting$", "worthless$", "lowei", "clown$"]
    automaton = T.Automaton(terms)
    r = random.Random(4)
    letters = "abcdeghilnoprstuw"
    samples = []
    for t in terms:
        for edits in range(4):
            for _ in range(60):
                w = list(t.rstrip("$"))
                for _ in range(edits):
                    at = r.randrange(len(w)) if w else 0
                    w[at : at + 1] = r.choice(([], [r.choice(letters)], [r.choice(letters), *w[at : at + 1]]))
                samples.append("".join(w))
    for word in samples:
        fits = []
        for i, t in enumerate(terms):
            bare = t.rstrip("$")
            d = plain_distance(bare, word) if t.endswith("$") else min(plain_distance(bare, word[:n]) for n in range(len(word) + 1))
            if d <= T.allowed_edits(t):
                fits.append((d, i))
        assert automaton.match(word) == (min(fits) if fits else None)


def test_quotation_counts_less_than_abuse():
    m = T.Matcher(["idiot$"], [5.0])
    bare = m.features("what an idiot that is")
    quoted = m.features('he said "idiot" and left')
    direct = m.features("you are an idiot they think")
    assert direct[0] > bare[0] > quoted[0] == 0 and quoted[2] > 0


@pytest.fixture(scope="module")
def toxic_model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return T.fit_toxicity(docs, labels)


def test_misspelt_short_terms_are_hits():
    m = T.Matcher(["idiot$", "moron$", "scum$"], [5.0] * 3, frozenset({"scam"}))
    clean = m.features("what a nice day it is")
    for word in ("iddiot", "idi0t", "mor0n", "morn", "scumm"):
        assert m.features(f"what an {word} that is")[:2] > clean[:2], word
    for word in ("scam", "boron", "idea", "radiot"):
        assert m.features(f"what an {word} that is") == clean, word


def test_marks_pair_within_a_quotation():
    assert T.quotations('he "said this" and then "that" too'.split()) == [(1, 2), (5, 5)]
    m = T.Matcher(["idiot$"], [5.0])
    between = m.features('the "first" one an idiot the "second" one')
    assert between[0] > 0 and between[2] == 0


def test_scores_are_those_of_the_features(toxic_model):
    """The score from its parts: hits by edit distance, contexts, and the logistic model."""
    terms, text = toxic_model.terms, "you are a %s and so it goes on"
    whole = next(t for t in terms if t.endswith("$"))
    words = (text % whole.rstrip("$")).split()
    hits = [i for i, w in enumerate(words) if any(plain_distance(t.rstrip("$"), w) <= T.allowed_edits(t) and w not in toxic_model.clean if t.endswith("$") else w.startswith(t) for t in terms)]
    x = np.array([T.Matcher(list(terms), list(toxic_model.weights), toxic_model.clean).features(text % whole.rstrip("$"))])
    assert hits == [3] and abs(x[0][0] - np.log1p(1.25)) < 1e-9 and abs(x[0][5] - (1.25 / 9) ** 0.5) < 1e-9
    z = x[0] @ np.array(toxic_model.coefficients[:-1]) + toxic_model.coefficients[-1]
    assert abs(toxic_model.scores(x)[0] - 1 / (1 + np.exp(-z))) < 1e-12


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = T.score_toxicity(docs, T.fit_toxicity(docs, labels)).where(held_out(F.col("doc_id"))).join(labels, "doc_id")
    right = scored.select(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("toxic")).cast("int"))).first()[0]
    assert right > 0.93


def test_toxicity_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, 0), (None, 1), (7, 1)], "doc_id long, toxic int")
    model = T.fit_toxicity(odd_docs, labels)
    assert T.score_toxicity(odd_docs.withColumn("score", F.lit("x")), model).where("score between 0 and 1").count() == len(odd_rows)
    assert T.score_toxicity(no_docs, T.fit_toxicity(no_docs, labels)).count() == 0


# page text


@pytest.fixture(scope="module")
def dom_model(spark):
    return fit_dom_model(sample_pages(spark))


def test_unseen_made_pages(dom_model):
    right = sum(dom_model.extract(p) == t for p, t in (made_page(10_000 + i) for i in range(200)))
    assert right >= 190


def test_messages_give_exact_marginals(dom_model):
    """Against all labellings of a small tree."""
    from itertools import product

    nodes = parse('<div class="x"><p>One two.</p><nav><a href="/">three</a></nav></div>')
    own = dom_model.evidence(nodes)
    total, each = 0.0, np.zeros((len(nodes), 3))
    for labels in product(range(3), repeat=len(nodes)):
        p = dom_model.root[labels[0]]
        for i, n in enumerate(nodes):
            p *= own[i][labels[i]]
            if i:
                p *= dom_model.below["block" if n.kind == "block" else "element"][labels[n.parent]][labels[i]]
        total += p
        for i, label in enumerate(labels):
            each[i, label] += p
    assert np.allclose(dom_model.marginals(nodes), each / total)


CASES = {
    "": "",
    "<html><body>": "",
    "<article><h1>A &amp;amp; B</h1><p>Some  text\n here with a few words.<p>Next one follows here.</article><footer>&copy; x</footer>": "A &amp; B\n\nSome text here with a few words.\n\nNext one follows here.",
    "<nav><ul><li><a href='/a'>a</a></li></ul></nav><article><p>Body of the page, long enough to read.</p><script>var x='<p>no</p>'</script></article>": "Body of the page, long enough to read.",
}


@pytest.mark.parametrize("page", CASES)
def test_page_cases(dom_model, page):
    assert dom_model.extract(page) == CASES[page]


def blocks_of(page: str) -> list[str]:
    return [n.text for n in parse(page) if n.text is not None]


@pytest.mark.parametrize(
    "page,blocks",
    [
        ("<html><head><title>t</title><div>hello world</div><p>para</p></html>", ["hello world", "para"]),
        ("<head> words<p>x", ["words", "x"]),
        ('<p>one</p><a href="x>two</a>', ["one", "two"]),
        ("<p>a < b</p><!--> c <!-- x --> d </> e", ["a < b", "c d e"]),
        ('<p title="a > b">c</p>', ["c"]),
        ("<p>kept</p><div class='x", ["kept"]),
    ],
)
def test_broken_markup(page, blocks):
    assert blocks_of(page) == blocks


@pytest.mark.parametrize("piece", ["<a ", "<b>x", "<div>", "</x>", '<a href="x>', "<p><svg>", "<li><ul>", "<title", "&amp"])
def test_a_megabyte_of_one_piece_is_read_quickly(piece):
    import time

    begun = time.process_time()
    parse(piece * (1_000_000 // len(piece)))
    assert time.process_time() - begun < 20


def test_text_below_very_deep_elements_stays():
    assert blocks_of("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after</p>") == ["deep", "after"]


@pytest.mark.parametrize("depth", [1, 3, 100, 400, 511, 512, 600, 3000])
def test_depth_inside_an_article_changes_nothing(dom_model, depth):
    first, nested, *after = ("The harbour was rebuilt over nine years by people who had seen it burn." + f" Part {i}." for i in range(4))
    blocks = "".join(f"<p>{t}</p>" for t in after)
    page = f'<body><div class="menu"><a href="/">Home</a></div><div class="article content"><h1>The harbour</h1><p>{first}</p>{"<div>" * depth}<p>{nested}</p>{"</div>" * depth}{blocks}</div></body>'
    got = dom_model.extract(page).split("\n\n")
    assert got == ["The harbour", first, nested, *after]


def test_closing_tags_of_unnested_elements_close_nothing_else():
    nodes = parse('<div class="outer">' + "<div>" * 600 + "x" + "</div>" * 600 + "<p>y</p></div>z")
    kinds = {n.text: n for n in nodes if n.text}
    outer = next(i for i, n in enumerate(nodes) if "name:outer" in n.features)
    assert nodes[kinds["y"].parent].parent == outer and kinds["z"].parent != outer


def test_pages_over_spark(spark, dom_model):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<p>" * 3000 + "x"), (4, "<!-- never closed <p>a"), (5, "<div" * 50)], "page_id long, html string").withColumn("text", F.lit(1))
    got = {r.page_id: r.text for r in extract_text(pages, dom_model).collect()}
    assert got[1] == got[2] == "" and set(got) == {1, 2, 3, 4, 5}
    assert extract_text(pages.limit(0), dom_model).count() == 0


def test_labels_follow_blocks():
    page, text = made_page(3)
    nodes = parse(page)
    assert sum(l == 1 for n, l in zip(nodes, label_nodes(nodes, text), strict=True) if n.text is not None) == len(text.split("\n\n"))


# embeddings


def plain_embeddings(rows, threshold=0.98):
    ids, links = [r[0] for r in rows], {i: set() for i, _ in enumerate(rows)}
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows):
            if i != j and la is not None and la == lb and ok(a) and ok(b) and len(a) == len(b):
                x, y = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                    links[i].add(j)
    comp = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        comp[ids[i]] = min(ids[k] for k in seen)
    return {ids[i]: (len(links[i]), comp[ids[i]]) for i in links}


def test_embeddings_match_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for c in range(30):
        center = rng.normal(size=16)
        for _ in range(6):
            v = center + rng.normal(size=16) * rng.choice([0.02, 0.15, 0.3])
            rows.append((n, [float(np.float32(x)) for x in v], int(c % 3)))
            n += 1
    rows += [(n + i, rows[0][1], 0) for i in range(5)] + [(n + 5, [2 * x for x in rows[0][1]], 0), (n + 6, rows[0][1], None), (n + 7, None, 0), (n + 8, [0.0] * 16, 0), (n + 9, [float("nan")] * 16, 0), (n + 10, [None] * 16, 0), (n + 11, rows[0][1][:4], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = plain_embeddings(rows)
    for tile in (4096, 9):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_components(df, tile_rows=tile).collect()}
        assert got == want
    assert embedding_components(df.limit(0)).count() == 0


# mixing


def test_huge_and_tiny_vectors_link_and_ids_may_repeat(spark):
    rows = [(1, [3e200, 1e200], 0), (2, [3e200, 1.01e200], 0), (3, [3e-200, 1e-200], 0), (4, [0.0, 1.0], 0), (4, [3.0, 1.0], 0)]
    got = sorted(map(tuple, embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()))
    assert got == [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 0, 4, True), (4, 3, 1, False)]


@pytest.mark.parametrize("width", [0.2, 0.05])
def test_tiles_meet_wherever_their_boxes_are_near(spark, width):
    r = random.Random(6)
    boxes = []
    for i in range(60):
        low = [r.uniform(-1, 1), r.uniform(-1, 1), r.uniform(-1, 1)]
        boxes.append((f"t{i:02}", "x", 3, low, [a + r.choice((0, 0.01, 0.3)) for a in low]))
    gap = lambda a, b: sum(max(0, a[3][k] - b[4][k], b[3][k] - a[4][k]) ** 2 for k in range(3))
    want = {(a[0], b[0]) for a in boxes for b in boxes if a[0] <= b[0] and gap(a, b) <= width * width}
    got = near_tiles(spark.createDataFrame(boxes, "tile string, label string, d int, low array<double>, high array<double>"), width * width, width)
    assert sorted((x.tile_a, x.tile_b) for x in got.collect()) == sorted(want)


def test_raking_meets_margins():
    held = np.array([[400.0, 100], [50, 450]])
    kept, away = rake(held, [np.array([0.5, 0.5]), np.array([0.6, 0.4])], 0.4)
    assert away < 1e-4
    assert np.allclose(kept.sum(1), [200, 200], rtol=1e-4) and np.allclose(kept.sum(0), [240, 160], rtol=1e-4) and (kept <= held + 1e-9).all()


def plain_raking(held: dict, goals: list[dict], keep: float) -> dict:
    """Iterative proportional fitting cell by cell."""
    kept = {c: n * keep for c, n in held.items()}
    budget = keep * sum(held.values())
    for _ in range(2000):
        for axis, goal in enumerate(goals):
            for value, share in goal.items():
                now = sum(n for c, n in kept.items() if c[axis] == value)
                for c in kept:
                    if c[axis] == value:
                        kept[c] = min(held[c], kept[c] * share * budget / now)
    return kept


def test_raking_of_three_margins_is_the_plain_one():
    r = random.Random(8)
    held = {(a, b, c): float(r.randrange(50, 900)) for a in range(4) for b in range(3) for c in range(2)}
    goals = [{0: 0.3, 1: 0.3, 2: 0.2, 3: 0.2}, {0: 0.5, 1: 0.3, 2: 0.2}, {0: 0.6, 1: 0.4}]
    table = np.array([[[held[a, b, c] for c in range(2)] for b in range(3)] for a in range(4)])
    kept, away = rake(table, [np.array(list(g.values())) for g in goals], 0.4)
    want = plain_raking(held, goals, 0.4)
    assert away < 1e-6 and all(abs(kept[c] - n) < 1e-3 for c, n in want.items())


def test_targets_out_of_reach_are_reported(spark):
    docs = spark.createDataFrame([(i, "a b c", "rare" if i < 5 else "usual") for i in range(500)], "doc_id long, text string, source string")
    with pytest.warns(UserWarning, match="away from its target"):
        mixed = mix_sources(docs.withColumn("class_source", F.lit("own")), {"source": {"rare": 0.9}}, columns={"source": F.col("source")})
    assert mixed.where("source = 'rare' and probability < 1").count() == 0 and mixed.where("class_source = 'own'").count() == 500


def test_topics_tell_subjects_apart(spark):
    from relictum.llm.mixing import fit_topics, with_topics

    r = random.Random(2)
    subjects = [[f"{'xyz'[k]}{i}word" for i in range(30)] for k in range(3)]
    rows = [(i, " ".join(r.choices(subjects[i % 3], k=60) + ["und"] * 10), "de") for i in range(300)] + [(300, None, "en"), (301, " ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in with_topics(docs, F.col("lang"), fit_topics(docs, F.col("lang"), axes=2)).collect()}
    assert got[300].topic is None is got[301].topic and got[300].n_words == got[301].n_words == 0 and got[5].n_words == 70
    groups = [{got[i].topic for i in range(k, 300, 3)} for k in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    empty = docs.limit(0)
    assert with_topics(empty, F.col("lang"), fit_topics(empty, F.col("lang"))).count() == 0


def test_words_are_counted_by_their_hash(monkeypatch):
    from relictum.llm import mixing as M

    texts = ["a bb  a\tccc", None, "", " \n", "bb " * 500, "é É x" * 40, "a"]
    counts = M.word_counts(texts)
    assert counts.sum(1).tolist() == [len((t or "").split()) for t in texts]
    assert (counts[0] >= counts[6]).all() and counts[4].max() == 500 and counts[5].max() >= 39
    monkeypatch.setattr(M, "PIECE", 64)
    assert (M.word_counts(texts) == counts).all()


def test_mixture_is_close_to_its_targets(spark):
    docs = spark.createDataFrame([(i, words(i % 50, 40), "big" if i % 3 else "small", "en" if i % 2 else "de") for i in range(4000)], "doc_id long, text string, source string, lang string")
    mixed = mix_sources(docs, {"source": {"big": 0.4}, "lang": {"en": 0.5}}, columns={"source": F.col("source"), "lang": F.col("lang")}, keep=0.5)
    kept = {r.source: r.n for r in mixed.where("selected").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert abs(kept["big"] / sum(kept.values()) - 0.4) < 0.05
    assert mixed.where("selected").count() == mixed.where("selected").count()


def test_mixing_odd_rows(odd_docs, odd_rows, no_docs):
    columns = {"source": F.col("source"), "lang": F.col("lang")}
    for targets in ({"source": {"a": 0.5}, "lang": {"en": 0.9}}, {"source": {}, "lang": {"zz": 1.0}}):
        got = mix_sources(odd_docs.withColumn("selected", F.lit("x")), targets, columns=columns).collect()
        assert len(got) == len(odd_rows) and all(0 <= r.probability <= 1 for r in got)
        assert mix_sources(no_docs, targets, columns=columns).count() == 0


def test_every_source_is_mixed_whatever_its_name(spark):
    from relictum.llm.queries import MIX_TARGETS, MIX_TEMPERED

    rows = [(i, "word " * 50, "hot" if i % 2 else f"s{i % 20}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mix_sources(docs, {"source": MIX_TARGETS["source"]}, columns={"source": F.col("source")}, tempered=MIX_TEMPERED)
    kept = {r.source: r.k for r in mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("k")).collect()}
    share = {s: k / sum(kept.values()) for s, k in kept.items()}
    root = {s: (2000 if s == "hot" else 200) ** 0.5 for s in kept}
    assert len(kept) == 11 and abs(share["s0"] - min(share.values())) < 1e-9
    assert all(abs(share[s] - root[s] / sum(root.values())) < 0.02 for s in kept), share
