"""Exact repeats of WINDOW bytes, found with a sparse suffix array.

Sorting every suffix would move each text a hundred times over, so only suffixes at anchors are sorted: places whose GRAM
bytes hash lowest among all GRAM-byte strings of some window. Two equal windows choose equal places, so every repeated
window meets its copy at a common anchor and none is lost. Around an anchor at most WINDOW - GRAM bytes to the left and
WINDOW bytes to the right matter: its context.

1. Texts with a copy are repeats as a whole, and one row of each goes on. Anchor suffixes are range-partitioned by their
   leading bytes with sampled splitters and sorted in their buckets, then adjacent ones are compared. Suffixes with equal
   contexts repeat whole. Where the contexts of one gram differ, one suffix of each context goes on. The first and the last
   context of each bucket are compared across buckets.
2. Contexts that share REACH bytes to the right, or the rest of the window to the left, form groups; any two contexts with
   a common window share one of the two. Groups are range-partitioned and sorted the same way. All windows of a group are
   compared at once; groups that touch an edge of their bucket, or are cut for size, send one row for each distinct window
   and are decided by counts.
3. Spans are merged for each text, and the bytes that remain are hashed.

Equality of contexts and windows is equality of 64-bit hashes (plus the leading bytes, and the group).

Defined cases: a null text counts as empty; texts under WINDOW bytes lose nothing; rows with equal texts are occurrences of
each other; repeated ids are fine, since texts are told apart by a 128-bit hash of their content; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relictum.llm.common import materialize

WINDOW, GRAM = 200, 32
LEFT = WINDOW - GRAM
REACH = 116
NEAR = WINDOW - REACH
CHUNK = 1 << 16
U = np.uint64
BASE = 0xD6E8FEB86659FD93
MASK = (1 << 64) - 1


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


def byte_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


VALUES = byte_values()


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hashes of all strings of `size` bytes (a power of 2)."""
    h, factor, step = VALUES[data], BASE, 1
    while step < size:
        h = h[:-step] * U(factor) + h[step:]
        factor, step = factor * factor & MASK, 2 * step
    return mixed(h)


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over x[i : i + width]."""
    covered = 1
    while covered < width:
        step = min(covered, width - covered)
        x = pick(x[:-step], x[step:])
        covered += step
    return x


def anchors(data: np.ndarray, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lowest hashes of all windows, ties included, and the hashes there. Long texts are read in pieces that
    share all but one byte of a window, so memory stays bounded and no window is missed."""
    if len(data) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, U)
    if len(data) > piece + WINDOW:
        parts = [(at, *anchors(data[at : at + piece + WINDOW - 1], piece)) for at in range(0, len(data) - WINDOW + 1, piece)]
        places, first = np.unique(np.concatenate([at + p for at, p, _ in parts]), return_index=True)
        return places, np.concatenate([h for _, _, h in parts])[first]
    h, width = gram_hashes(data), LEFT + 1
    low = sliding(h, width, np.minimum)
    edge = np.zeros(width - 1, U)
    at = np.flatnonzero(sliding(np.concatenate([edge, low, edge]), width, np.maximum) == h)
    return at, h[at]


SUFFIXES = "lead long, gram long, context long, k1 long, k2 long, place int, size int, copied boolean"
SUFFIX_NAMES = ["lead", "gram", "context", "k1", "k2", "place", "size", "copied"]


def emit_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2", "copied")]
        out: list[list] = [[] for _ in SUFFIX_NAMES]
        size = 0
        for n, text in enumerate(batch.column("content")):
            raw = text.as_buffer()
            data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
            at, gram = anchors(data)
            if not len(at):
                continue
            raw = data.tobytes()
            context = [digest(raw[max(0, p - LEFT) : p + WINDOW], min(p, LEFT) << 8 | min(len(raw) - p, WINDOW)) for p in at.tolist()]
            lead = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,))[at].astype(U) ^ U(1 << 63)  # signed order is byte order
            for column, values in zip(out, (lead.view(np.int64), gram.view(np.int64), np.array(context, U).view(np.int64), np.full(len(at), keys[0][n]), np.full(len(at), keys[1][n]), at.astype(np.int32), np.full(len(at), len(raw), np.int32), np.full(len(at), keys[2][n])), strict=True):
                column.append(values)
            size += len(at)
            if size > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=SUFFIX_NAMES)
                out, size = [[] for _ in SUFFIX_NAMES], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=SUFFIX_NAMES)


FOUND = "kind int, lead long, gram long, context long, k1 long, k2 long, place int, size int, copied boolean, n long, several boolean"
REPEATED, ASKED, ASKED_REPEATED, EDGE = range(4)


def compare_neighbours(batches: Iterator[pa.RecordBatch], most_held: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Suffixes come sorted by (lead, gram, context). What adjacent suffixes of a bucket show is decided here. The first and
    the last context of a bucket also leave as one row each, with their number, to be compared with other buckets."""
    held: list[np.ndarray] | None = None
    first = True

    def decide(columns: list[np.ndarray], edge_first: bool, edge_last: bool) -> pa.RecordBatch:
        lead, gram, context = columns[:3]
        copied = columns[7].astype(bool)
        new_gram = np.concatenate([[True], (gram[1:] != gram[:-1]) | (lead[1:] != lead[:-1])])
        new = new_gram | np.concatenate([[True], context[1:] != context[:-1]])
        run, kind = np.cumsum(new_gram) - 1, np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        rows_of = np.bincount(kind)
        repeated = (rows_of > 1) | (np.bincount(kind, copied) > 0)
        several = np.bincount(run[heads])[run[heads]] > 1
        edge = np.zeros(len(heads), bool)
        edge[0] |= edge_first
        edge[-1] |= edge_last
        spans = np.flatnonzero(repeated[kind] & ~copied)
        asked = np.flatnonzero(several & (repeated | ~edge))
        edges = np.flatnonzero(edge)
        kinds = np.concatenate([np.full(len(spans), REPEATED), np.where(repeated[asked], ASKED_REPEATED, ASKED), np.full(len(edges), EDGE)]).astype(np.int32)
        picked = np.concatenate([spans, heads[asked], heads[edges]])
        own = np.concatenate([kind[spans], asked, edges])
        return pa.RecordBatch.from_arrays([pa.array(kinds), *(pa.array(c[picked]) for c in columns[:7]), pa.array(copied[picked]), pa.array(rows_of[own].astype(np.int64)), pa.array(several[own])], names=["kind", *SUFFIX_NAMES, "n", "several"])

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        if held is not None:
            columns = [np.concatenate([a, b]) for a, b in zip(held, columns, strict=True)]
        lead, gram = columns[:2]
        last = (gram == gram[-1]) & (lead == lead[-1])
        begin = len(gram) - int(np.argmin(last[::-1])) if not last.all() else 0
        if begin:
            yield decide([c[:begin] for c in columns], first, False)
            first = False
        held = [c[begin:] for c in columns]
        if len(held[0]) > most_held:  # one gram fills the bucket: cut it as if the bucket ended here
            yield decide(held, True, True)
            held, first = None, True
    if held is not None:
        yield decide(held, True, True)


CONTEXTS = "group long, repeated boolean, k1 long, k2 long, place int, before int, after int, bytes binary"


def emit_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each asked anchor of a text: its context to the left group, the right group, or both."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    names = ["group", "repeated", "k1", "k2", "place", "before", "after", "bytes"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for k1, k2, text, asked in zip(*(batch.column(c) for c in ("k1", "k2", "content", "asked")), strict=True):
            k1, k2, raw = k1.as_py(), k2.as_py(), text.as_py()
            for a in asked.as_py():
                p = a["place"]
                left, right = min(p, LEFT), min(len(raw) - p, WINDOW)
                if right >= REACH:
                    before = min(left, NEAR)
                    rows = [(signed(digest(raw[p : p + REACH], 1)), before, right, raw[p - before : p + right])]
                else:
                    rows = []
                if left >= NEAR:
                    after = min(right, REACH)
                    rows.append((signed(digest(raw[p - NEAR : p + GRAM], 2)), left, after, raw[p - left : p + after]))
                for group, before, after, context in rows:
                    for column, value in zip(out, (group, a["repeated"], k1, k2, p, before, after, context), strict=True):
                        column.append(value)
            if len(out[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
                out = [[] for _ in names]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)


def window_hashes(contexts: list[bytes], before: np.ndarray, after: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each distance that a window may start left of its anchor: the distance, the windows' hashes, and which of them lie
    within their context. The hashes roll leftward byte by byte over contexts set so that all anchors share a column."""
    widest, longest = int(before.max(initial=0)), int(after.max(initial=0))
    size = widest + longest
    data = np.zeros((len(contexts), size), np.uint8)
    for row, context, left in zip(data, contexts, before.tolist(), strict=True):
        row[widest - left : widest - left + len(context)] = np.frombuffer(context, np.uint8)
    data = np.ascontiguousarray(data.T)
    lowest = max(0, WINDOW - longest)
    if lowest > widest:
        return
    inverse, top = U(pow(BASE, -1, 1 << 64)), U(pow(BASE, WINDOW - 1, 1 << 64))
    h = np.zeros(len(contexts), U)
    start = widest - lowest
    for j in range(WINDOW):
        h = h * U(BASE) + VALUES[data[start + j]]
    for step in range(lowest, widest + 1):
        if step > lowest:
            start -= 1
            h = (h - VALUES[data[start + WINDOW]]) * inverse + VALUES[data[start]] * top
        yield step, mixed(h), (step <= before) & (WINDOW - step <= after)


WINDOW_NAMES = ["start", "end", "k1", "k2", "grp", "step", "hash"]
WINDOWS = "start int, end int, k1 long, k2 long, grp long, step int, hash long"


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def compare_windows(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Contexts come sorted by group, and at most `chunk` of them are compared at once. Rows with a span are decided; rows with a hash stand for one distinct window of an open
    part, with the text and the span that hang on it, or without if that span is decided."""
    held: list[tuple] = []

    def decide(rows: list[tuple], open_groups: set[int]) -> Iterator[pa.RecordBatch]:
        group = mixed(np.array([r[0] for r in rows], np.int64).view(U))
        repeated = np.array([r[1] for r in rows], bool)
        before, after = (np.array([r[i] for r in rows], np.int64) for i in (5, 6))
        opened = np.array([r[0] in open_groups for r in rows], bool)
        steps, shared = [], []
        out: list[list] = [[] for _ in range(7)]
        lone: list[tuple[np.ndarray, ...]] = []
        for step, hashes, valid in window_hashes([r[7] for r in rows], before, after):
            at = np.flatnonzero(valid)
            both = np.zeros(len(rows), bool)
            if len(at):
                key = hashes ^ group
                order = at[np.argsort(key[at], kind="stable")]
                same = key[order][1:] == key[order][:-1]
                both[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
                head = order[np.concatenate([[True], ~same])]
                head = head[opened[head]]
                lone.append((np.full(len(head), step, np.int32), head, hashes[head].view(np.int64), repeated[head] | both[head]))
            steps.append(step)
            shared.append(both)
        shared = np.array(shared, bool).reshape(len(steps), len(rows))
        for i in np.flatnonzero(~repeated & shared.any(0)).tolist():
            for a, b in runs_of(shared[:, i]):
                place = rows[i][4]
                for column, value in zip(out, (place - steps[b - 1], place - steps[a] + WINDOW, rows[i][2], rows[i][3], None, None, None), strict=True):
                    column.append(value)
        k1, k2, place, grp = (np.array([r[i] for r in rows], np.int64) for i in (2, 3, 4, 0))
        for step, i, h, decided in lone:  # one batch a step; a window that is decided has no span
            start = (place[i] - step).astype(np.int32)
            span = [pa.array(c, mask=decided) for c in (start, start + np.int32(WINDOW), k1[i], k2[i])]
            if len(i):
                yield pa.RecordBatch.from_arrays([*span, pa.array(grp[i]), pa.array(step), pa.array(h)], names=WINDOW_NAMES)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=WINDOW_NAMES)

    first, touched = True, set()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if first:
                touched.add(row[0])
                first = False
            if len(held) >= chunk:
                if row[0] == held[-1][0] == held[0][0]:  # one group fills the chunk
                    touched.add(row[0])
                    yield from decide(held, touched & {row[0]})
                    held = []
                else:
                    cut = len(held) if row[0] != held[-1][0] else next(i for i in range(len(held) - 1, -1, -1) if held[i][0] != row[0]) + 1
                    yield from decide(held[:cut], touched)
                    touched &= {r[0] for r in held[cut:]}
                    held = held[cut:]
            held.append(row)
    if held:
        yield from decide(held, touched | {held[-1][0]})


RESULT = "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(4)]
        for text, copied, spans in zip(batch.column("content"), batch.column("copied"), batch.column("spans"), strict=True):
            raw, spans = text.as_py(), sorted((s["start"], s["end"]) for s in spans.as_py() or [])
            if copied.as_py() and len(raw) >= WINDOW:
                spans = [(0, len(raw))]
            kept, at, removed, count = [], 0, 0, 0
            i = 0
            while i < len(spans):
                start, end = spans[i]
                while i < len(spans) and spans[i][0] <= end:
                    end = max(end, spans[i][1])
                    i += 1
                kept.append(raw[at:start])
                at, removed, count = end, removed + end - start, count + 1
            kept.append(raw[at:])
            for column, value in zip(out, (len(raw), removed, count, hashlib.sha256(b"".join(kept)).hexdigest()), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], names=["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeat_spans(texts: DataFrame, parts: int, chunk: int = CHUNK) -> DataFrame:
    """Spans (k1, k2, start, end) of repeated windows of texts that have no copy."""
    order = ["lead", "gram", "context", "k1", "place"]
    suffixes = texts.select("k1", "k2", "content", "copied").mapInArrow(emit_suffixes, SUFFIXES)
    found = materialize(suffixes.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(compare_neighbours, FOUND), "suffixes")

    edges = found.where(F.col("kind") == EDGE)  # two rows a bucket
    kinds = edges.groupBy("lead", "gram", "context").agg(((F.sum("n") > 1) | F.max("copied")).alias("repeated"))
    grams = edges.groupBy("lead", "gram").agg((F.max("several") | (F.count_distinct("context") > 1)).alias("mixed"))
    late = materialize(edges.join(kinds, ["lead", "gram", "context"]).join(grams, ["lead", "gram"]).select("k1", "k2", "place", "size", "n", "copied", "repeated", "mixed"), "edges")
    repeated = found.where(F.col("kind") == REPEATED).select("k1", "k2", "place", "size").unionByName(late.where("repeated and n = 1 and not copied").select("k1", "k2", "place", "size"))
    whole = repeated.select("k1", "k2", F.greatest(F.lit(0), F.col("place") - LEFT).alias("start"), F.least(F.col("size"), F.col("place") + WINDOW).alias("end"))

    asked = found.where(F.col("kind").isin(ASKED, ASKED_REPEATED)).select("k1", "k2", "place", (F.col("kind") == ASKED_REPEATED).alias("repeated"))
    asked = asked.unionByName(late.where("mixed").select("k1", "k2", "place", "repeated")).distinct()
    by_text = asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("place", "repeated")).alias("asked"))
    around = texts.join(by_text, ["k1", "k2"]).select("k1", "k2", "content", "asked").mapInArrow(emit_contexts, CONTEXTS)
    order = ["group", "k1", "place"]
    windows = materialize(around.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(partial(compare_windows, chunk=chunk), WINDOWS), "windows")
    lone = windows.where("hash is not null")
    met = lone.groupBy("grp", "step", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("grp", "step", "hash")
    across = lone.where("start is not null").join(met, ["grp", "step", "hash"], "left_semi").select("k1", "k2", "start", "end")
    inside = windows.where("hash is null").select("k1", "k2", "start", "end")
    return whole.unionByName(inside).unionByName(across).distinct()


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 24 << 20, most_parts: int = 20_000, chunk: int = CHUNK) -> DataFrame:
    """Returns doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row."""
    content = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), content.cast("binary").alias("content")).withColumns({"k1": F.xxhash64("content"), "k2": F.xxhash64(F.lit(1), "content")})
    total = keyed.agg(F.sum(F.octet_length("content").cast("long"))).first()[0] or 0
    parts = min(most_parts, max(8, -(-total // part_bytes)))  # beyond that, partitions grow and their sorts spill
    once = keyed.groupBy("k1", "k2").agg(F.first("content").alias("content"), (F.count(F.lit(1)) > 1).alias("copied"))
    texts = materialize(once, "texts")
    spans = repeat_spans(texts, parts, chunk)
    spans = materialize(spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    cut = texts.join(spans, ["k1", "k2"], "left").select("k1", "k2", "content", "copied", "spans").mapInArrow(cut_texts, RESULT)
    cut = materialize(cut, "cut")
    return keyed.select("doc_id", "k1", "k2").join(cut, ["k1", "k2"], "left").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
