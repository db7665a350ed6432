"""Mixing sources to target weights by iterative proportional fitting.

Tokens are added up by cell (source, language and topic class). Raking scales the cells until their shares meet the target
marginals, no cell above what it holds; a document's probability is what its cell keeps over what it holds, so that the
expected tokens meet the targets. Documents are then drawn by a hash of their id and text, alike on every run. Targets that
cannot be met, and raking that does not settle, are reported as a warning with the largest deviation of a share.

A class is a value that the targets name; all other values, and null, are the class 'other', which gets what is left of 1.
A marginal in `tempered` has more classes: every value found shares what is left of 1 by its tokens to that power, so each is
raked whatever it is called. Values beyond the MOST_VALUES with most tokens are the class 'other'. So the number of cells is
bounded by the targets, whatever the table holds, and the cells may be raked on the driver and broadcast.

Where no topic column exists, topics come from the texts (`fit_topics`): the principal axes of all texts' word profiles within
their languages; a text belongs to the axis and side on which it stands out most. `tokens` takes the weights of rows, such as
the counts of a tokenizer; without it words between white space are counted.

Defined cases: null and empty texts have no tokens, no topic (null), and the probability of their cell (1 in a cell without
tokens); targets of classes that the table lacks are spread over the others; an empty table gives an empty table; repeated
rows share one decision; columns named like the added ones are replaced.
"""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relictum.llm.common import free_name, materialize

OTHER = "other"
MAX_CELLS = 100_000
MOST_VALUES = 200
DIMS = 256
QUANTUM = 1 << 12
DEVIATION = 0.01
Targets = Mapping[str, Mapping[str, float]]


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def hash_tables() -> tuple[np.ndarray, np.ndarray]:
    """A number for each byte (none for white space) and an odd factor for each place in a word."""
    mixed = np.arange(1, 321, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values, factors = mixed[:256] ^ (mixed[:256] >> np.uint64(27)), mixed[256:] | np.uint64(1)
    values[SPACES] = 0
    return values, factors


SPACES = [32, 9, 10, 11, 12, 13]
IS_SPACE = np.isin(np.arange(256), SPACES)
VALUES, FACTORS = hash_tables()
PIECE = 1 << 18


def count_words(parts: list[bytes]) -> np.ndarray:
    """For each part the number of its words by hash, as rows of DIMS."""
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    space = IS_SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros((len(parts), DIMS), np.int64)
    place = np.arange(len(data) - starts[0]) - np.repeat(starts - starts[0], np.diff(np.append(starts, len(data))))
    hashes = np.add.reduceat(VALUES[data[starts[0] :]] * FACTORS[np.minimum(place, len(FACTORS) - 1)], starts - starts[0])
    bucket = ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64)
    part = np.searchsorted(begins, starts, side="right") - 1
    return np.bincount(part * DIMS + bucket, minlength=len(parts) * DIMS).reshape(len(parts), DIMS)


def word_counts(texts: list[str | None]) -> np.ndarray:
    """Words of whole texts by hash; long texts are cut at white space, so memory stays bounded."""
    out = np.zeros((len(texts), DIMS), np.int64)
    parts: list[bytes] = []
    owners: list[int] = []
    size = 0

    def settle() -> None:
        nonlocal size
        np.add.at(out, owners, count_words(parts))
        parts.clear(), owners.clear()
        size = 0

    for i, text in enumerate(texts):
        raw, at = (text or "").lower().encode("utf-8", "surrogatepass"), 0
        while at < len(raw):
            end = at + PIECE
            if end < len(raw):
                cut = max(raw.rfind(b" ", at, end), raw.rfind(b"\n", at, end))
                end = cut + 1 if cut > at else end
            parts.append(raw[at:end])
            owners.append(i)
            size, at = size + min(end, len(raw)) - at, end
            if size >= PIECE:
                settle()
    if parts:
        settle()
    return out


def profiles(counts: np.ndarray) -> np.ndarray:
    """Square roots of word counts, of length 1, in steps of 1 / QUANTUM so that sums hardly depend on their order."""
    return np.round(np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True))) * QUANTUM) / QUANTUM


@dataclass(frozen=True)
class Topics:
    """Means of the profiles of each group, and axes in units of their spread."""

    means: dict[str, np.ndarray]
    axes: np.ndarray

    def names(self, groups: list[str], counts: np.ndarray) -> list[str | None]:
        centre = np.array([self.means.get(g, self.means[OTHER]) for g in groups]).reshape(-1, DIMS)
        y = (profiles(counts) - centre) @ self.axes
        k = np.abs(y).argmax(1)
        side = np.where(y[np.arange(len(k)), k] > 0, "+", "-")
        return [f"topic{a}{b}" if some else None for a, b, some in zip(k.tolist(), side.tolist(), counts.any(1).tolist(), strict=True)]


def profile_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each group of one task the number and the sum of its profiles, and for all the sums of their products."""
    sums: dict[str, np.ndarray] = {}
    products = np.zeros((DIMS, DIMS))
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            counts = word_counts(part.column("text").to_pylist())
            x, groups = profiles(counts), np.array(part.column("group").to_pylist(), object)
            some = counts.any(1)
            products += x[some].T @ x[some]
            for group in set(groups[some].tolist()):
                own = x[some & (groups == group)]
                sums[group] = sums.get(group, 0) + np.concatenate([[len(own)], own.sum(0)])
    for group, values in [*sums.items(), *([(None, products.ravel())] if sums else [])]:
        yield pa.RecordBatch.from_arrays([pa.array([group] * len(values), pa.string()), pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], names=["group", "i", "total"])


def fit_topics(docs: DataFrame, group: Column, *, text_col: str = "text", axes: int = 4) -> Topics:
    """Topic axes of all texts. `group` is a column of few values (languages), whose means are taken out first."""
    rows = docs.select(F.coalesce(group.cast("string"), F.lit(OTHER)).alias("group"), F.col(text_col).cast("string").alias("text"))
    total = np.zeros((DIMS, DIMS))
    sums: dict[str, np.ndarray] = {OTHER: np.zeros(DIMS + 1)}
    for r in rows.mapInArrow(profile_sums, "group string, i int, total double").groupBy("group", "i").agg(F.sum("total").alias("total")).collect():
        if r.group is None:
            total.ravel()[r.i] = r.total
        else:
            sums.setdefault(r.group, np.zeros(DIMS + 1))[r.i] = r.total
    n = sum(s[0] for s in sums.values())
    means = {g: s[1:] / max(1.0, s[0]) for g, s in sums.items()}
    if not sums[OTHER][0]:
        means[OTHER] = sum(s[1:] for s in sums.values()) / max(1.0, n)
    within = (total - sum(sums[g][0] * np.outer(m, m) for g, m in means.items())) / max(1.0, n)
    value, vector = np.linalg.eigh(within)
    vector = vector[:, ::-1][:, :axes]
    vector = vector * np.sign(vector[np.abs(vector).argmax(0), np.arange(axes)])
    return Topics(means, vector / np.sqrt(np.maximum(value[::-1][:axes], 1e-9)))


def with_topics(docs: DataFrame, group: Column, topics: Topics, *, text_col: str = "text") -> DataFrame:
    """`docs` with topic, n_words and draw (a hash of the text)."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for groups, texts in batches:
            names, totals = [], []
            for at in range(0, len(texts), 512):
                counts = word_counts(texts.slice(at, 512).to_pylist())
                names += topics.names(groups.slice(at, 512).to_pylist(), counts)
                totals += counts.sum(1).tolist()
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(totals, pa.int64())], names=["topic", "n_words"])

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(run, "struct<topic:string,n_words:long>").asNondeterministic()
    found = free_name(docs, "found")
    read = docs.withColumn(found, udf(F.coalesce(group.cast("string"), F.lit(OTHER)), F.col(text_col).cast("string")))
    return read.withColumns({"topic": F.col(f"{found}.topic"), "n_words": F.col(f"{found}.n_words"), "draw": F.xxhash64(F.col(text_col))}).drop(found)


def rake(held: np.ndarray, targets: list[np.ndarray], keep: float, rounds: int = 1000, close: float = 1e-10) -> tuple[np.ndarray, float]:
    """What each cell should keep of the tokens that it holds, and the largest deviation of a share from its target."""
    budget = keep * held.sum()
    goals = []
    for axis, share in enumerate(targets):
        there = held.sum(tuple(i for i in range(held.ndim) if i != axis)) > 0
        share = np.where(there, share, 0.0)
        goals.append(budget * (share / share.sum() if share.sum() else there / max(1, there.sum())))
    margin = lambda x, axis: x.sum(tuple(i for i in range(held.ndim) if i != axis))
    kept = held * keep
    for _ in range(rounds):
        before = kept
        for axis, goal in enumerate(goals):
            now = margin(kept, axis)
            factor = np.divide(goal, now, out=np.ones_like(goal), where=now > 0)
            kept = np.minimum(kept * factor.reshape([-1 if i == axis else 1 for i in range(held.ndim)]), held)
        if np.abs(kept - before).max(initial=0) <= close * max(1.0, budget):
            break
    away = max((np.abs(margin(kept, axis) - goal).max(initial=0) for axis, goal in enumerate(goals)), default=0.0) / max(1.0, budget)
    return kept, float(away)


def share_out(held: DataFrame, declared: Mapping[str, float], power: float) -> dict[str, float]:
    """The declared targets, and for every other value of `held` (value, held) its tempered share of what they leave."""
    others = held.where(F.col("value").isNull() | ~F.col("value").isin(*declared)) if declared else held
    most = others.where((F.col("held") > 0) & (F.col("value") != OTHER)).orderBy(F.desc("held"), "value").limit(MOST_VALUES).collect()
    named = {r.value: float(r.held) for r in most}
    total = float(others.agg(F.sum("held")).first()[0] or 0)
    weight = {v: n**power for v, n in named.items()}
    if OTHER not in declared:
        weight[OTHER] = max(0.0, total - sum(named.values())) ** power
    left, whole = max(0.0, 1.0 - sum(declared.values())), sum(weight.values())
    return dict(declared) | {v: left * w / whole if whole else 0.0 for v, w in weight.items()}


def mix_sources(docs: DataFrame, targets: Targets, *, columns: Mapping[str, Column], keep: float = 0.5, tokens: Column | None = None, draw: Column | None = None, text_col: str = "text", id_col: str = "doc_id", seed: int = 17, tempered: Mapping[str, float] | None = None) -> DataFrame:
    """`docs` with n_tokens, probability and selected. `columns` gives the column of each marginal in `targets`, `tokens` the
    tokens of a row (words of the text, if not given), `draw` what decides besides the id (the text); `tempered` gives the
    power of those marginals in which every value is a class."""
    names = list(targets)
    tokens = F.coalesce(tokens.cast("long"), F.lit(0)) if tokens is not None else word_count(F.col(text_col))
    classes = {m: free_name(docs, f"class_{m}") for m in names}
    own = {m: columns[m].cast("string") for m in names}
    lot = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), draw if draw is not None else F.col(text_col)), F.lit(1 << 53)).cast("double") / float(1 << 53)
    held_by = docs.select(*[own[m].alias(classes[m]) for m in names], tokens.alias("n")).groupBy(*classes.values()).agg(F.sum("n").alias("held"))
    held_by = materialize(held_by, "cells")  # one pass over the documents serves every sum
    targets = dict(targets)
    for m, power in ((m, p) for m, p in (tempered or {}).items() if m in targets):
        targets[m] = share_out(held_by.groupBy(F.col(classes[m]).alias("value")).agg(F.sum("held").alias("held")), targets[m], power)
    values = {m: [v for v in targets[m] if v != OTHER] + [OTHER] for m in names}
    if np.prod([len(v) for v in values.values()]) > MAX_CELLS:
        raise ValueError(f"the targets make more than {MAX_CELLS} cells")
    shares = []
    for m in names:
        given = [float(targets[m][v]) for v in values[m][:-1]]
        shares.append(np.array([*given, float(targets[m].get(OTHER, max(0.0, 1.0 - sum(given))))]))
    classed = {m: F.when(c.isin(*values[m][:-1]), c).otherwise(F.lit(OTHER)) if len(values[m]) > 1 else F.lit(OTHER) for m, c in ((m, F.col(classes[m])) for m in names)}
    held = np.zeros([len(values[m]) for m in names])
    for r in held_by.select(*[classed[m].alias(classes[m]) for m in names], "held").groupBy(*classes.values()).agg(F.sum("held").alias("held")).collect():  # at most one row for each cell
        held[tuple(values[m].index(r[classes[m]]) for m in names)] = r.held or 0
    kept, away = rake(held, shares, keep)
    if away > DEVIATION:
        warnings.warn(f"raking leaves a share {away:.3f} away from its target", stacklevel=2)
    chances = np.divide(kept, held, out=np.ones_like(held), where=held > 0)
    rows = [(*key, float(p)) for key, p in zip(itertools.product(*values.values()), chances.ravel(), strict=True) if p != 1.0]
    schema = ", ".join([*(f"`{c}` string" for c in classes.values()), "__probability double"])
    cells = docs.sparkSession.createDataFrame(rows, schema)  # at most MAX_CELLS rows
    out = docs.withColumns({**{classes[m]: own[m] for m in names}, "n_tokens": tokens})
    out = out.withColumns({classes[m]: classed[m] for m in names}).join(F.broadcast(cells), list(classes.values()), "left")
    out = out.withColumn("probability", F.coalesce("__probability", F.lit(1.0))).drop("__probability", *classes.values())
    return out.withColumn("selected", lot < F.col("probability"))
