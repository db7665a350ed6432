"""Toxicity: misspelled terms caught by Levenshtein automata on a lexicon trie, weighed by the words around them.

The lexicon is learned from labelled rows: words and beginnings of words that stand in toxic texts and hardly elsewhere.
The trie of the terms and the Levenshtein automaton of a word run in step; the state sets they reach are made into a
deterministic automaton as they occur, so most words take one table look-up a letter. Each hit gets a context score from a
window of words: within a pair of quotation marks or after a reporting verb it counts as quotation, next to a second
person as abuse. A misspelling begins with the letter of its term and is no word that stands in clean rows. A logistic model on the sums of both gives the score.

The fit reads a bounded sample of labelled rows (`sample_rows` of each class, drawn by a hash of the id), in which near
copies count once; scoring reads every row whole.

Defined cases: null and empty texts score as texts without a hit; labels other than 0 and 1, ids whose labels disagree and
null ids are left out of the fit; of rows that share an id one counts in it; with one class only every score is that class's smoothed share; repeated rows score alike; columns named like the
added ones are replaced.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relictum.llm.common import drawn_labels, drawn_rows, materialize, text_udf

EDGE = ".,;:!?\"'`()[]{}<>#$%&*|~^=+-_/\\…«»“”„‘’"
MARKS = frozenset("\"«»“”„‟")
REPORTING = frozenset("said says say wrote writes called calls quoted quote quotes reported cited according dit disait a-t-il sagte schrieb zitat dijo escribió".split())
SECOND_PERSON = frozenset("you your you're yourself u tu te toi vous votre ton ta du dich dir dein deine sie ihr usted ustedes tú ti vosotros".split())
WINDOW = 6
SHORTEST, LONGEST = 4, 10
QUOTATION = 60
END = "$"
FEATURES = 7


def allowed_edits(term: str) -> int:
    """Terms under four letters must stand as they are, and so must beginnings of words, which vary as it is."""
    n = len(term.rstrip(END))
    return 0 if n < 4 or not term.endswith(END) else 1 if n < 10 else 2


class Automaton:
    """Trie of terms; a term that ends in END must cover the whole word, any other only its beginning."""

    def __init__(self, terms: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.closed: dict[int, int] = {}
        self.open: dict[int, int] = {}
        self.reach = [0]
        self.edits = [allowed_edits(t) for t in terms]
        for number, term in enumerate(terms):
            node, whole = 0, term.endswith(END)
            self.reach[0] = max(self.reach[0], self.edits[number])
            for letter in term.rstrip(END):
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.reach.append(0)
                node = self.children[node][letter]
                self.reach[node] = max(self.reach[node], self.edits[number])
            (self.closed if whole else self.open)[node] = number
        self.clear()

    def clear(self) -> None:
        start = self.settle({0: 0}, None)
        self.states = {start: 0}
        self.known = [start]
        self.moves: dict[tuple[int, str], int] = {}

    def settle(self, nodes: dict[int, int], best: tuple[int, int] | None):
        """Follow dropped letters; keep the least edits of each node and the best open term met so far."""
        queue = list(nodes)
        while queue:
            node = queue.pop()
            used = nodes[node]
            for child in self.children[node].values():
                if used < self.reach[child] and nodes.get(child, 99) > used + 1:
                    nodes[child] = used + 1
                    queue.append(child)
        for node, used in nodes.items():
            term = self.open.get(node)
            if term is not None and used <= self.edits[term] and (best is None or (used, term) < best):
                best = (used, term)
        return frozenset(nodes.items()), best

    def step(self, state, letter: str):
        nodes: dict[int, int] = {}
        for node, used in state[0]:
            reached = [(child, used + (c != letter)) for c, child in self.children[node].items()] + [(node, used + 1)]
            for to, cost in reached:
                if cost <= self.reach[to] and nodes.get(to, 99) > cost:
                    nodes[to] = cost
        return self.settle(nodes, state[1])

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, number of the term) of the closest term."""
        at = 0
        for letter in word:
            to = self.moves.get((at, letter))
            if to is None:
                if len(self.moves) > 400_000:
                    state = self.known[at]
                    self.clear()
                    at = self.states.setdefault(state, len(self.known))
                    if at == len(self.known):
                        self.known.append(state)
                state = self.step(self.known[at], letter)
                to = self.states.setdefault(state, len(self.known))
                if to == len(self.known):
                    self.known.append(state)
                self.moves[at, letter] = to
            at = to
            if not self.known[at][0]:
                break
        nodes, best = self.known[at]
        for node, used in nodes:
            term = self.closed.get(node)
            if term is not None and used <= self.edits[term] and (best is None or (used, term) < best):
                best = (used, term)
        return best


def quotations(words: list[str]) -> list[tuple[int, int]]:
    """First and last word of each quotation: an opening mark and the next closing one, at most QUOTATION words on."""
    spans, begun = [], -1
    for i, w in enumerate(words):
        if w.lstrip("([{")[:1] in MARKS and (begun < 0 or i - begun > QUOTATION):
            begun = i
        if begun >= 0 and w.rstrip(".,;:!?)]}")[-1:] in MARKS and (i > begun or len(w) > 2):
            if i - begun <= QUOTATION:
                spans.append((begun, i))
            begun = -1
    return spans


@dataclass
class Matcher:
    """Finds hits and their contexts; one for each task."""

    terms: list[str]
    weights: list[float]
    clean: frozenset[str] = frozenset()
    memo: dict[str, tuple[int, int] | None] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.automaton = Automaton(self.terms)

    def features(self, text: str) -> list[float]:
        words = text.lower().split()
        memo, hits = self.memo, []
        if len(memo) > 300_000:
            memo.clear()
        for i, raw in enumerate(words):
            try:
                found = memo[raw]
            except KeyError:
                word = raw.strip(EDGE)
                found = self.automaton.match(word) if len(word) >= 3 else None
                if found is not None and found[0] and (word in self.clean or word[0] != self.terms[found[1]][0]):
                    found = None
                memo[raw] = found
            if found is not None:
                hits.append((i, found))
        abuse = fuzzy = quoted = evidence = 0.0
        kinds, most = set(), 0.0
        spans = quotations(words) if hits else []
        for i, (edits, term) in hits:
            context = self.context(words, i, spans)
            weight = self.weights[term]
            if context <= 0.5:
                quoted += 1
            else:
                abuse += context
                fuzzy += edits > 0
                kinds.add(term)
                most = max(most, weight / (1 + edits))
                evidence += context * weight / (1 + edits)
        return [math.log1p(abuse), math.log1p(fuzzy), math.log1p(quoted), math.log1p(len(kinds)), most, math.sqrt(abuse / max(1, len(words))), math.log1p(max(0.0, evidence))]

    @staticmethod
    def context(words: list[str], i: int, spans: list[tuple[int, int]]) -> float:
        """1 for a bare hit, less within quotation, more beside a second person."""
        before, after = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
        score = 1.0
        at = bisect_right(spans, (i, len(words))) - 1
        if at >= 0 and i <= spans[at][1]:
            score -= 0.6
        if any(w.strip(EDGE) in REPORTING for w in before):
            score -= 0.25
        if any(w.strip(EDGE) in SECOND_PERSON for w in (*before, *after)):
            score += 0.25
        return max(0.1, score)


@dataclass(frozen=True)
class ToxicityModel:
    prior: float
    terms: tuple[str, ...] = ()
    weights: tuple[float, ...] = ()
    clean: frozenset[str] = frozenset()
    coefficients: tuple[float, ...] = ()

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.coefficients:
            return np.full(len(x), self.prior)
        c = np.array(self.coefficients)
        return 1 / (1 + np.exp(-np.clip(x @ c[:-1] + c[-1], -500, 500)))


def beginnings(words: set[str]) -> set[str]:
    out = {w[:n] for w in words for n in range(SHORTEST, min(LONGEST, len(w)) + 1)}
    return out | {w + END for w in words if 3 <= len(w) <= 24}


def describe(texts: list[str]) -> pa.Array:
    """Beginnings of the words of each text, and four pairs of minimum hashes of its three-word runs."""
    import xxhash

    kind = pa.struct([("parts", pa.list_(pa.string())), ("bands", pa.list_(pa.string()))])
    out = []
    for text in texts:
        words = text.lower().split()
        runs = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))], np.uint64)
        least = [int((runs * np.uint64(2 * k + 0x9E3779B97F4A7C15) ^ runs >> np.uint64(29 + k)).min()) for k in range(8)]
        out.append({"parts": sorted(beginnings({w.strip(EDGE) for w in words})), "bands": [f"{k}:{least[k]}:{least[k + 1]}" for k in range(0, 8, 2)]})
    return pa.array(out, kind)


def ratio(a: float, b: float, n1: float, n0: float) -> float:
    """Log-likelihood ratio of a term in a of n1 toxic and b of n0 other rows."""
    term = lambda x, e: x * math.log(x / e) if x > 0 else 0.0
    n, k = n1 + n0, a + b
    return 2 * (term(a, n1 * k / n) + term(b, n0 * k / n) + term(n1 - a, n1 * (n - k) / n) + term(n0 - b, n0 * (n - k) / n))


def choose_terms(counts: list[tuple[str, int, int]], n1: int, n0: int, least_ratio: float, least_precision: float, most: int) -> list[tuple[str, float]]:
    """Terms by strength; of beginnings that begin alike, the longest that loses no toxic row stands for all. Whole words stay
    beside a beginning of theirs, since only they may be misspelt."""
    scored = []
    for term, a, b in counts:
        precision = (a / n1) / (a / n1 + b / n0 + 1e-12)
        if precision >= least_precision and (g := ratio(a, b, n1, n0)) >= least_ratio:
            scored.append((g, len(term), term, a, b))
    scored.sort(key=lambda x: (-x[0], -x[1], x[2]))
    chosen: dict[str, int] = {}
    out = []
    for _, _, term, a, b in scored:
        if not term.endswith(END):
            if any(term[:n] in chosen for n in range(SHORTEST, len(term) + 1)):
                continue
            related = [c for t, c in chosen.items() if t.startswith(term)]
            if related and a < 1.25 * max(related):
                continue
        chosen[term] = a
        out.append((term, math.log(((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1)))))
        if len(out) == most:
            break
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    c = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + penalty + 1e-9 * np.eye(len(c)), a.T @ (weight * (y - p)) - penalty @ c)
        c = c + step
        if np.abs(step).max() < 1e-8:
            break
    return c


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", text_col: str = "text", sample_rows: int = 4000, least_ratio: float = 30.0, least_precision: float = 0.75, max_terms: int = 500, max_candidates: int = 50_000) -> ToxicityModel:
    """Learn from at most about `sample_rows` rows of each class outside the held-out fifth. The lexicon holds at most `max_terms`
    terms, chosen among the `max_candidates` strongest."""
    drawn, n, share = drawn_labels(labels, label_col, sample_rows)
    prior = (n[1] + 1) / (sum(n) + 2)
    if min(n) < 2:
        return ToxicityModel(prior)
    rows = drawn_rows(docs, drawn, text_col)
    rows = materialize(rows.withColumn("d", text_udf(describe, "struct<parts:array<string>,bands:array<string>>")(F.col("text"))).select("doc_id", "y", "text", "d.parts", "d.bands"), "toxicity-sample")

    group: dict[str, int] = {}
    parent: dict[int, int] = {}
    ids = sorted((r.doc_id, r.y, r.bands) for r in rows.select("doc_id", "y", "bands").collect())  # of the bounded sample

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, _, bands) in enumerate(ids):
        parent[i] = i
        for band in bands:
            j = root(group.setdefault(band, i))
            parent[max(j, root(i))] = min(j, root(i))
    single = [(ids[i][0], ids[i][1]) for i in range(len(ids)) if root(i) == i]
    n1 = sum(y for _, y in single)
    n0 = len(single) - n1
    if min(n0, n1) < 2:
        return ToxicityModel(prior)
    alone = docs.sparkSession.createDataFrame([(i,) for i, _ in single], f"doc_id {rows.schema['doc_id'].dataType.simpleString()}")
    parts = rows.join(F.broadcast(alone), "doc_id", "left_semi").select("y", F.explode("parts").alias("part"))
    parts = materialize(parts.groupBy("part").agg(F.sum("y").cast("int").alias("a"), F.sum(1 - F.col("y")).cast("int").alias("b")), "parts")
    strong = parts.where((F.col("a") >= 3) & (F.col("a") / n1 >= least_precision / (1 - least_precision) * F.col("b") / n0))
    counts = [(r.part, r.a, r.b) for r in strong.orderBy(F.desc(F.col("a") / n1 - F.col("b") / n0), F.desc(F.length("part")), "part").limit(max_candidates).collect()]
    terms = choose_terms(counts, n1, n0, least_ratio, least_precision, max_terms)
    words, weights = [t for t, _ in terms], [w for _, w in terms]
    # Words of clean rows that only an edit makes a hit are no misspelling of it; of the bounded sample.
    usual = parts.where(F.col("part").endswith(END) & (F.col("b") >= 1) & (F.col("a") / n1 < F.col("b") / n0))
    near = usual.where(text_udf(misspelt_of(words, weights), "boolean")(F.col("part"))).select("part")
    clean = frozenset(r.part.removesuffix(END) for r in near.collect())

    seen = rows.select("y", text_udf(features_of(words, weights, clean), "array<double>")(F.col("text")).alias("x")).collect()
    x, y = np.array([r.x for r in seen], float), np.array([r.y for r in seen], float)
    balance = np.where(y == 1, 1 / share[1], 1 / share[0])
    c = logistic(x, y, balance / balance.mean())
    return ToxicityModel(prior, tuple(words), tuple(weights), clean, tuple(c.tolist()))


def features_of(terms: list[str], weights: list[float], clean: frozenset[str]):
    cache: list[Matcher] = []

    def run(texts: list[str]) -> pa.Array:
        if not cache:
            cache.append(Matcher(terms, weights, clean))
        return pa.array([cache[0].features(t) for t in texts], pa.list_(pa.float64()))

    return run


def misspelt_of(terms: list[str], weights: list[float]):
    cache: list[Automaton] = []

    def run(words: list[str]) -> pa.Array:
        if not cache:
            cache.append(Automaton(terms))
        return pa.array([(m := cache[0].match(w.removesuffix(END))) is not None and m[0] > 0 for w in words], pa.bool_())

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with the probability of label 1."""
    cache: list[Matcher] = []

    def run(texts: list[str]) -> pa.Array:
        if not cache:
            cache.append(Matcher(list(model.terms), list(model.weights), model.clean))
        x = np.array([cache[0].features(t) for t in texts], float).reshape(-1, FEATURES)
        return pa.array(model.scores(x), pa.float64())

    return docs.withColumn(score_col, text_udf(run, "double")(F.col(text_col)))
