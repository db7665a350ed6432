"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are lower-cased and every run of other than letters and digits becomes one space. An item of m
bytes may be changed by k = floor(rate * m) edits, so an occurrence shares at least m - q + 1 - k * q of its q-grams, all on
neighbouring diagonals (place in the text less place in the item); q is eight, or less for an item so short that the bound
would not be positive. Shared q-grams are counted in overlapping bands of diagonals; a band that meets the bound, and
whose text also meets the bound for three-byte grams, is verified by a banded alignment, the item whole, the ends in the
text free.

Items are handed to the tasks in blocks of bounded size, one pass over the documents for each block, and the driver holds one
block at a time. Pairs of a gram and its places are counted in pieces, so a text that repeats itself takes little memory.

Defined cases: null and empty texts hold no item; null and empty items match nothing; items so short that they may not be
changed must occur as whole words; of several occurrences of an item in a text the closest counts, the first among those;
equal items each match; items without an id match with `null_ids`; repeated rows each get their matches; columns named like
the added one are replaced.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relictum.llm.common import free_name, materialize, text_key, text_udf

Q = 8
BLOCK_BYTES = 16 << 20
PIECE = 1 << 20
PAIRS = 1 << 22
LEAKS = "array<struct<item_id:long,distance:int,start:int,end:int>>"
LEAKS_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
OTHER = re.compile(r"[\W_]+")
MIXER = np.uint64(0x9E3779B97F4A7C15)


ASCII_FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def normalise(text: str) -> bytes:
    if text.isascii():  # the same, without a pattern
        return b" ".join(text.encode().translate(ASCII_FOLD).split())
    return OTHER.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def grams(data: bytes) -> np.ndarray:
    """The eight bytes at each place as one number."""
    n = len(data) - Q + 1
    return np.ndarray((n,), "<u8", data, strides=(1,)) if n > 0 else np.empty(0, np.uint64)


def mask(q: int) -> np.uint64:
    """The first q of eight bytes."""
    return np.uint64((1 << 8 * q) - 1)


@dataclass
class Items:
    ids: list[int]
    texts: list[bytes]
    budget: np.ndarray
    need: np.ndarray
    gram: np.ndarray
    first: np.ndarray
    count: np.ndarray
    item: np.ndarray
    place: np.ndarray
    narrow: np.ndarray
    seen: np.ndarray
    shift: np.uint64
    q: int
    #: items with a shorter q: their numbers, and an index of them
    short: list[tuple[list[int], Items]]


def gram_length(size: int, edits: int) -> int:
    return min(Q, size // (edits + 1))


def index_items(rows: list[tuple[int | None, str]], rate: float) -> Items:
    rows = [(i, normalise(t)) for i, t in rows if t and normalise(t)]
    texts = [t for _, t in rows]
    budget = np.array([int(len(t) * rate) for t in texts], np.int64)
    q = np.array([gram_length(len(t), k) if k else Q for t, k in zip(texts, budget.tolist(), strict=True)], np.int64)
    if q.size and q.min() < 1:
        raise ValueError(f"rate {rate} allows more edits than an item has bytes")
    short = []
    for own in sorted({int(x) for x in q} - {Q}):
        numbers = np.flatnonzero(q == own).tolist()
        short.append((numbers, index_grams([rows[n] for n in numbers], budget[numbers], np.ones(len(numbers), bool), own, [])))
    return index_grams(rows, budget, (q == Q) & (budget > 0), Q, short)


def index_grams(rows: list[tuple[int | None, bytes]], budget: np.ndarray, used: np.ndarray, q: int, short: list) -> Items:
    size = np.array([len(t) for _, t in rows], np.int64)
    each = [grams(t + bytes(Q - q)) & mask(q) if use else np.empty(0, np.uint64) for (_, t), use in zip(rows, used.tolist(), strict=True)]
    gram = np.concatenate(each) if each else np.empty(0, np.uint64)
    item = np.repeat(np.arange(len(rows)), [len(g) for g in each])
    place = np.concatenate([np.arange(len(g)) for g in each]) if each else np.empty(0, np.int64)
    order = np.argsort(gram, kind="stable")
    distinct, first, count = np.unique(gram[order], return_index=True, return_counts=True)
    narrow = np.array([int(k).bit_length() for k in budget], np.int64)  # 2**narrow diagonals are more than k
    bits = max(16, int(len(gram) * 16).bit_length())
    shift = np.uint64(64 - bits)
    seen = np.zeros(1 << bits, bool)
    seen[((gram * MIXER) >> shift).astype(np.int64)] = True
    return Items([i for i, _ in rows], [t for _, t in rows], budget, size - q + 1 - budget * q, distinct, first, count, item[order], place[order], narrow, seen, shift, q, short)


def shared_grams(item: bytes, region: bytes) -> int:
    """How many places of the item begin three bytes that the region holds; an edit takes at most three of them away."""
    held = {region[i : i + 3] for i in range(len(region) - 2)}
    return sum([item[i : i + 3] in held for i in range(len(item) - 2)])


def align(item: bytes, region: bytes, slack: int, budget: int) -> tuple[int, int, int] | None:
    """Least edits between the whole item and a part of the region, with that part; place i of the item may meet places
    i .. i + slack of the region. None if more than `budget` edits are needed."""
    at = region.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    if not budget or shared_grams(item, region) < len(item) - 2 - 3 * budget:
        return None
    a, b = np.frombuffer(item, np.uint8), np.frombuffer(region + b"\0" * (slack + len(item) + 2), np.uint8)
    far = len(item) + 1
    steps = np.arange(slack + 1)
    cost, begin = np.zeros(slack + 1, np.int64), steps.copy()  # column c of row i: i bytes of the item, i + c of the region
    inside = len(region)
    for i in range(len(a)):
        # 2**32 times the cost plus the place where the part begins: the least cost wins, then the first begin
        diagonal = ((cost + (b[i : i + slack + 1] != a[i])) << 32) + begin
        up = np.concatenate([((cost[1:] + 1) << 32) + begin[1:], [far << 32]])
        best = np.minimum(diagonal, up)
        best = np.minimum.accumulate(best - (steps << 32)) + (steps << 32)
        cost, begin = best >> 32, best & ((1 << 32) - 1)
        cost[i + 1 + steps > inside] = far
        if cost.min() > budget:
            return None
    c = int(np.argmin(cost))
    return (int(cost[c]), int(begin[c]), len(a) + c) if cost[c] <= budget else None


def find_items(texts: list[str], items: Items) -> list[list[dict]]:
    """Matches of each text."""
    found: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
    clean = [normalise(t) for t in texts]
    for i, item in enumerate(items.texts):
        if not items.budget[i]:
            for n, data in enumerate(clean):
                if (at := (b" " + data + b" ").find(b" " + item + b" ")) >= 0:
                    found[n][i] = (0, at, at + len(item))
    gap = b"\0" * Q
    begins = list(accumulate((len(x) + Q for x in clean), initial=0))
    data = gap.join(clean) + gap
    g = grams(data)
    search(texts, clean, data, begins, g, items, range(len(items.texts)), found)
    for numbers, index in items.short:
        search(texts, clean, data, begins, g & mask(index.q), index, numbers, found)
    return [[{"item_id": items.ids[i], "distance": d, "start": a, "end": b} for i, (d, a, b) in sorted(x.items(), key=lambda y: (items.ids[y[0]] is None, items.ids[y[0]] or 0, y[1]))] for x in found]


def count_bands(hits: np.ndarray, at: np.ndarray, items: Items, bands: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (item and band) in order, and the grams that each shares. `hits` are places of the text, `at` their grams."""
    done = np.cumsum(items.count[at])
    keys, sums, held = [], [], 0

    def fold() -> tuple[np.ndarray, np.ndarray]:
        key, number = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(number.ravel(), np.concatenate(sums)).astype(np.int64)

    begin = 0
    while begin < len(hits):
        end = max(begin + 1, int(np.searchsorted(done, (done[begin - 1] if begin else 0) + PAIRS, side="right")))
        part, gram = hits[begin:end], at[begin:end]
        count = items.count[gram]
        entry = np.repeat(items.first[gram] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        item = items.item[entry]
        key = item * bands + ((np.repeat(part, count) - items.place[entry] + longest) >> items.narrow[item])
        key.sort()
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        keys.append(key[edge])
        sums.append(np.diff(np.concatenate([edge, [len(key)]])))
        held += len(edge)
        if len(keys) > 1 and held > PAIRS:
            key, total = fold()
            keys, sums, held = [key], [total], 0
        begin = end
    return (keys[0], sums[0]) if len(keys) == 1 else fold()


def search(texts: list[str], clean: list[bytes], data: bytes, begins: list[int], g: np.ndarray, items: Items, numbers: Sequence[int], found: list[dict[int, tuple[int, int, int]]]) -> None:
    """Add the matches of the items to `found`, under their numbers."""
    hits = np.empty(0, np.int64)
    if len(items.gram) and len(g):  # in pieces, so that a very long text takes little memory
        hits = np.concatenate([at + np.flatnonzero(items.seen[((g[at : at + PIECE] * MIXER) >> items.shift).astype(np.int64)]) for at in range(0, len(g), PIECE)])
    at = np.searchsorted(items.gram, g[hits])
    same = items.gram[np.minimum(at, len(items.gram) - 1)] == g[hits] if len(hits) else np.empty(0, bool)
    hits, at = hits[same], at[same]
    if len(hits):
        longest = max(map(len, items.texts))
        bands = len(data) + longest + 2
        key, shared = count_bands(hits, at, items, bands, longest)
        both = shared.copy()  # of a band and the next one
        both[:-1] += np.where(key[1:] == key[:-1] + 1, shared[1:], 0)
        item, band = key // bands, key % bands
        enough = both >= items.need[item]
        for i, b in zip(item[enough].tolist(), band[enough].tolist(), strict=True):
            k, width = int(items.budget[i]), 1 << int(items.narrow[i])
            lowest = b * width - longest  # diagonals lowest .. lowest + 2 width - 1
            start, stop = lowest - k, lowest + 2 * width + len(items.texts[i]) + k
            for n in range(max(0, bisect_right(begins, start) - 1), min(len(texts), bisect_right(begins, stop))):
                if found[n].get(numbers[i], (1,))[0] == 0:  # an earlier band held the item unchanged
                    continue
                begin, end = max(start, begins[n]), min(stop, begins[n] + len(clean[n]))
                if end - begin < len(items.texts[i]) - k:
                    continue
                if (m := align(items.texts[i], data[begin:end], 2 * width + 2 * k, k)) and (old := (m[0], m[1] + begin - begins[n], m[2] + begin - begins[n])) < found[n].get(numbers[i], (1 << 30, 0, 0)):
                    found[n][numbers[i]] = old


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", leaks_col: str = "leaks", rate: float = 0.1, block_bytes: int = BLOCK_BYTES, null_ids: bool = False) -> DataFrame:
    """`docs` with an array of the benchmark items that each whole text holds: item id, edits, and place in the normalised
    text (bytes)."""
    known = benchmark.where((F.lit(null_ids) | F.col("item_id").isNotNull()) & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = known.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-2 * size // block_bytes))
    if blocks == 1:
        rows = [(r.item_id, r.text) for r in known.toLocalIterator()]
        return docs.withColumn(leaks_col, matcher(rows, rate)(F.col(text_col)) if rows else F.from_json(F.lit("[]"), LEAKS))
    parts = []
    for block in range(blocks):  # each block holds about half of block_bytes, and its matches are written before the next one
        rows = [(r.item_id, r.text) for r in known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toLocalIterator()]
        if rows:
            met = docs.select(text_key(F.col(text_col)).alias("__key"), matcher(rows, rate)(F.col(text_col)).alias("__found")).where(F.size("__found") > 0)
            parts.append(materialize(met.dropDuplicates(["__key"]), "leaks"))
    met = functools.reduce(DataFrame.unionByName, parts).groupBy("__key").agg(F.array_sort(F.flatten(F.collect_list("__found"))).alias("__found"))
    key = free_name(docs, "text_key")
    keyed = docs.withColumn(key, text_key(F.col(text_col)))
    joined = keyed.drop(leaks_col).join(met, keyed[key] == met["__key"], "left")
    return joined.withColumn(leaks_col, F.coalesce(met["__found"], F.from_json(F.lit("[]"), LEAKS))).drop(key, met["__key"], met["__found"])


def matcher(rows: list[tuple[int | None, str]], rate: float):
    cache: list[Items] = []

    def run(texts: list[str]) -> pa.Array:
        if not cache:
            cache.append(index_items(rows, rate))
        return pa.array(find_items(texts, cache[0]), LEAKS_ARROW)

    return text_udf(run, LEAKS)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Only the rows whose texts hold no benchmark item."""
    leaks = free_name(docs, "leaks")
    return find_leaks(docs, benchmark, leaks_col=leaks, **{"null_ids": True} | options).where(F.size(leaks) == 0).drop(leaks)
