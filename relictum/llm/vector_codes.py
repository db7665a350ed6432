"""Vectors as short codes: each part of a vector is named by the nearest entry of that part's codebook.

Components become integers, so sums and distances are exact whatever the order of rows. A round assigns every part to its
nearest entry and replaces entries by the means of their parts; tasks send on sums and counts of entries alone. Nearest entries
come from a vantage-point tree over each part's codebook: a subtree is left out only if the triangle inequality, with radii
rounded outwards and subtrees that may just tie still visited, rules it out; whoever is visited is compared by integers.

Defined cases: vectors that are null, empty or hold null or non-finite components are left out, as are those whose length is not
a multiple of `parts` or differs from that of the first kept row; a null id comes after all others; rows that share an id each
count, and come by their vectors among the first; fewer rows than `entries` give fewer entries; components are held within
`reach` of zero, far beyond unit vectors, so that no sum of squares overflows, and sums of errors end at the largest long; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relictum.llm.common import materialize

#: Roots are widened and narrowed by this share, more than the rounding of conversion, root and difference together.
SLACK = 2.0**-48
LEAF = 2
LARGEST = 2**63 - 1


@dataclass(frozen=True)
class Node:
    """Entries `own` are compared as they stand; if there are others, own[0] is the vantage point of two subtrees, each with its
    least and greatest distance from it."""

    own: tuple[int, ...]
    sides: tuple[tuple[Node, float, float], ...] = ()
    split: int = 0


def squares(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    d = x - entry
    return np.einsum("nd,nd->n", d, d)


def vantage_tree(entries: np.ndarray, among: np.ndarray | None = None) -> Node:
    among = np.arange(len(entries)) if among is None else among
    if len(among) <= LEAF:
        return Node(tuple(among.tolist()))
    middle = entries[among].astype(float).mean(0)
    point = among[np.square(entries[among] - middle).sum(1).argmax()]  # far out, so that distances from it differ
    others = among[among != point]
    far = squares(entries[others], entries[point])
    order = np.argsort(far, kind="stable")
    cut = len(others) // 2
    sides = []
    for half in (order[:cut], order[cut:]):
        low, high = (math.sqrt(int(x)) for x in (far[half].min(), far[half].max()))
        sides.append((vantage_tree(entries, others[half]), low * (1 - SLACK), high * (1 + SLACK)))
    return Node((int(point),), tuple(sides), int(far[order[cut - 1]]))


def nearest(tree: Node, entries: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its nearest entry, the lower of those that tie, and the squared distance."""
    best = np.full(len(x), LARGEST, np.int64)
    who = np.full(len(x), len(entries), np.int64)

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        for i in node.own:
            d = squares(x[rows], entries[i])
            better = (d < best[rows]) | ((d == best[rows]) & (i < who[rows]))
            best[rows[better]], who[rows[better]] = d[better], i
        if not node.sides:
            return
        root = np.sqrt(d.astype(np.float64))  # of the vantage point
        inside = d <= node.split
        for first, second, at in ((0, 1, inside), (1, 0, ~inside)):
            near, low, high = rows[at], root[at] * (1 - SLACK), root[at] * (1 + SLACK)
            for side in (first, second):  # the likelier side first; the bound is the better for the other
                below, least, most = node.sides[side]
                gap = np.maximum(least - high, low - most) * (1 - SLACK)
                visit(below, near[gap <= np.sqrt(best[near].astype(np.float64)) * (1 + SLACK)])

    visit(tree, np.arange(len(x)))
    return who, best


def reach(size: int) -> int:
    """The greatest power of two such that `size` squared differences of components within it stay below 2 ** 63."""
    return 1 << ((62 - max(1, size - 1).bit_length()) // 2 - 1)


def usable(vector: Column, parts: int) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & (F.size(vector) > 0) & (F.size(vector) % parts == 0), F.lit(False))


def integer_vectors(vectors: DataFrame, *, parts: int, scale: int, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, int]:
    """(vec_id, label, v) of the kept rows, written, and the length of their vectors."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v")).where(usable(F.col("v"), parts))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("d")).first()
    d = first.d if first else 0
    most = reach(d)
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(most))), F.lit(float(-most)))).cast("int"))
    return materialize(rows.where(F.size("v") == d).select("vec_id", "label", whole.alias("v")), "integers"), d


def matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def part_sums(books: list[np.ndarray], d: int):
    """One row (part, entry, position, total, n) for each number of the books that this task's rows have a part in."""
    width = d // len(books)
    trees = [vantage_tree(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(books), len(books[0]), width), np.int64)
        count = np.zeros(total.shape[:2], np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch, d)
            for p, (book, tree) in enumerate(zip(books, trees, strict=True)):
                part = x[:, p * width : (p + 1) * width]
                who, _ = nearest(tree, book, part)
                np.add.at(total[p], who, part)
                count[p] += np.bincount(who, minlength=len(book))
        p, e, i = (a.ravel() for a in np.indices(total.shape))
        used = count[p, e] > 0
        columns = [pa.array(c[used], k) for c, k in ((p, pa.int32()), (e, pa.int32()), (i, pa.int32()), (total.ravel(), pa.int64()), (count[p, e], pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "position", "total", "n"])

    return run


def fit_codebooks(integers: DataFrame, d: int, *, parts: int = 8, entries: int = 16, rounds: int = 6) -> list[np.ndarray]:
    """The codebook of each part: an array (entries, d / parts). A round brings entries * d numbers to the driver."""
    width = d // parts
    if not d:
        return [np.zeros((0, 0), np.int64)] * parts
    seeds = np.array([r.v for r in integers.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()], np.int64).reshape(-1, d)
    books = [seeds[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    for _ in range(rounds if len(seeds) else 0):
        sums = integers.select("v").mapInArrow(part_sums(books, d), "part int, entry int, position int, total long, n long")
        found = sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        books = [b.copy() for b in books]
        for r in found:
            books[r.part][r.entry, r.position] = r.total // r.n
    return books


def encode_vectors(integers: DataFrame, d: int, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error): `code` has one byte for each part."""
    width = d // len(books)
    trees = [vantage_tree(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch, d)
            found = [nearest(t, b, x[:, p * width : (p + 1) * width]) for p, (b, t) in enumerate(zip(books, trees, strict=True))]
            codes = np.stack([who for who, _ in found], 1).astype(np.uint8)
            error = sum(e for _, e in found)
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), packed, pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    fields = {f.name: f for f in integers.schema}
    return integers.mapInArrow(run, f"vec_id long, label {fields['label'].dataType.simpleString()}, code binary, error long")


def decode_vectors(codes: Column, books: list[np.ndarray], scale: int = 4096) -> Column:
    """The vectors that codes stand for."""
    pick = [F.get(F.array(*[F.array(*[F.lit(x / scale) for x in e]) for e in b.tolist()]), F.conv(F.hex(F.substring(codes, p + 1, 1)), 16, 10).cast("int")) for p, b in enumerate(books)]
    return F.concat(*pick)


def vector_codes(vectors: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error, label_error) for each kept row, and the codebooks. `entries` is at most 256."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part")
    integers, d = integer_vectors(vectors, parts=parts, scale=scale, id_col=id_col, vector_col=vector_col, label_col=label_col)
    books = fit_codebooks(integers, d, parts=parts, entries=entries, rounds=rounds)
    coded = materialize(encode_vectors(integers, d, books), "codes")
    wide = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.groupBy(F.col("label").alias("__label")).agg(F.least(wide, F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("__label")), "left").drop("__label"), books
