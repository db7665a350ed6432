"""Embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors fall together first, with their number. Unit vectors are turned onto their principal axes, which keeps every
product. Rows are range-partitioned by label and leading coordinates and cut into tiles with bounding boxes; two tiles of
one label meet only if their boxes come near enough for the threshold. Within a meeting, products are accumulated over
leading dimensions; the rest is at most the product of the two suffix norms, and a pair is dropped as soon as that bound
is below the threshold. What is left is verified in double precision on the vectors as given.

A meeting sends on link counts for each row and a spanning forest of its links, never its pairs.

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows whose label or id is null, link
with nothing and are their own component; vectors of unlike length never link; equal rows link with each other; rows that
share an id keep the links of their own vectors; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relictum.llm.common import connected_components, materialize

TILE = 4096
BOX = 8
STEP = 8
SLACK = 1e-9


def scaled_rows(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1: no digit changes, and no square overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    s = scaled_rows(x)
    return s / np.sqrt(np.square(s).sum(1, keepdims=True))


def unit_rows(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow list column, all of one length, as unit vectors."""
    return unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def second_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        sizes = np.array([len(v) for v in batch.column("v")])
        for d in np.unique(sizes):
            u = unit_rows(batch.column("v").filter(pa.array(sizes == d)))
            total[int(d)] = total.get(int(d), 0) + u.T @ u
    for d, m in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d), pa.int32()), pa.array(np.arange(d * d), pa.int32()), pa.array(m.ravel())], names=["d", "i", "total"])


def principal_axes(groups: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vector, its axes by falling share; made from d * d sums."""
    sums = groups.select("v").mapInArrow(second_moments, "d int, i int, total double").groupBy("d", "i").agg(F.sum("total").alias("total")).collect()
    moments: dict[int, np.ndarray] = {}
    for r in sums:
        moments.setdefault(r.d, np.zeros(r.d * r.d))[r.i] = r.total
    return {d: np.linalg.eigh(m.reshape(d, d))[1][:, ::-1].copy() for d, m in moments.items()}


def with_leading(axes: dict[int, np.ndarray], width: float):
    """Adds grid cells on the first three axes and the coordinate on the first one, to sort by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            sizes = np.array([len(v) for v in column])
            lead = np.zeros((len(sizes), 3))
            for d in np.unique(sizes):
                at = sizes == d
                u = unit_rows(column.filter(pa.array(at)))
                lead[at, : min(3, d)] = (u @ axes[int(d)])[:, :3]
            cells = np.floor(lead / width).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), pa.array(cells[:, 0]), pa.array(cells[:, 1]), pa.array(cells[:, 2]), pa.array(lead[:, 0])], names=[*batch.schema.names, "d", "c0", "c1", "c2", "lead"])

    return run


TILES = "tile string, label string, d int, n int, low array<double>, high array<double>, node binary, weight binary, vectors binary"


def make_tiles(axes: dict[int, np.ndarray], tile_rows: int):
    """Consecutive rows of one label and length become tiles of at most `tile_rows` rows."""

    def tile(label: str, d: int, name: str, rows: list[tuple]) -> pa.RecordBatch:
        x = np.array([r[2] for r in rows], np.float64)
        y = (unit(x) @ axes[d])[:, :BOX]
        cells = [[name], [label], [d], [len(rows)], [y.min(0).tolist()], [y.max(0).tolist()], [np.array([r[0] for r in rows], np.int64).tobytes()], [np.array([r[1] for r in rows], np.int64).tobytes()], [x.tobytes()]]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["tile", "label", "d", "n", "low", "high", "node", "weight", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("label", "d", "node", "weight", "v")]
            for label, d, node, weight, v in zip(*columns, strict=True):
                if now is not None and ((label, d) != now or len(rows) >= tile_rows):
                    yield tile(*now, f"{now[0]}:{rows[0][0]}", rows)
                    rows = []
                now = label, d
                rows.append((node, weight, v))
        if rows:
            yield tile(*now, f"{now[0]}:{rows[0][0]}", rows)

    return run


def compare(xa: np.ndarray, xb: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with cosine >= threshold."""
    ya, yb = unit(xa) @ axes, unit(xb) @ axes
    d = ya.shape[1]
    rest = lambda y, k: np.sqrt(np.square(y[:, k:]).sum(1))
    k = min(STEP, d)
    product = ya[:, :k] @ yb[:, :k].T
    i, j = np.nonzero(product + rest(ya, k)[:, None] * rest(yb, k)[None, :] >= threshold - SLACK)
    value = product[i, j]
    while k < d and len(i):
        to = min(d, k + STEP)
        ra, rb = rest(ya, to), rest(yb, to)
        for at in range(0, len(i), 1 << 18):
            part = slice(at, at + (1 << 18))
            value[part] += np.einsum("nd,nd->n", ya[i[part], k:to], yb[j[part], k:to])
        keep = value + ra[i] * rb[j] >= threshold - SLACK
        i, j, value, k = i[keep], j[keep], value[keep], to
    if len(i):
        xa, xb = scaled_rows(xa), scaled_rows(xb)
        na, nb = np.sqrt(np.square(xa).sum(1)), np.sqrt(np.square(xb).sum(1))
        exact = np.concatenate([np.einsum("nd,nd->n", xa[i[at : at + (1 << 18)]], xb[j[at : at + (1 << 18)]]) for at in range(0, len(i), 1 << 18)]) / (na[i] * nb[j])
        i, j = i[exact >= threshold], j[exact >= threshold]
    return i, j


def meetings(axes: dict[int, np.ndarray], threshold: float, piece: int = 1024):
    """Rows (node, links) with null other, and rows (node, other) of the spanning forest with null links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                same = r["tile_a"] == r["tile_b"]
                ids = [np.frombuffer(r[f"node_{s}"], np.int64) for s in "ab"]
                weight = [np.frombuffer(r[f"weight_{s}"], np.int64) for s in "ab"]
                x = [np.frombuffer(r[f"vectors_{s}"], np.float64).reshape(len(n), -1) for s, n in zip("ab", ids, strict=True)]
                links = [np.zeros(len(n), np.int64) for n in ids]
                parent: dict[int, int] = {}

                def root(n: int) -> int:
                    while parent.setdefault(n, n) != n:
                        parent[n] = parent[parent[n]]
                        n = parent[n]
                    return n

                for a in range(0, len(ids[0]), piece):
                    for b in range(a if same else 0, len(ids[1]), piece):
                        i, j = compare(x[0][a : a + piece], x[1][b : b + piece], axes[r["d"]], threshold)
                        i, j = i + a, j + b
                        if same:
                            i, j = i[i < j], j[i < j]
                        np.add.at(links[0], i, weight[1][j])
                        np.add.at(links[1], j, weight[0][i])
                        for p, q in zip(ids[0][i].tolist(), ids[1][j].tolist(), strict=True):
                            p, q = root(p), root(q)
                            if p != q:
                                parent[max(p, q)] = min(p, q)
                out = {"node": [], "links": [], "other": []}
                for n, count in zip(ids, links, strict=True):
                    for node, c in zip(n[count > 0].tolist(), count[count > 0].tolist(), strict=True):
                        out["node"].append(node), out["links"].append(c), out["other"].append(None)
                for n in list(parent):
                    if root(n) != n:
                        out["node"].append(n), out["links"].append(None), out["other"].append(root(n))
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], names=list(out))

    return run


def near_tiles(boxes: DataFrame, most: float, width: float) -> DataFrame:
    """Pairs of tiles of one label and length whose boxes come as near as sqrt(most). Tiles meet in cells of `width` on the two
    leading axes: one side sends the cells that its box covers, the other those and their neighbours, and a pair counts in
    the first cell that both send."""
    cell = lambda side, axis: F.coalesce(F.floor(F.get(side, F.lit(axis)) / width), F.lit(0)).cast("int")
    placed = boxes.select("*", *[cell(side, axis).alias(f"{side[0]}{axis}") for side in ("low", "high") for axis in (0, 1)])

    def spread(s: str, more: int) -> DataFrame:
        sent = placed.select(*[F.col(c).alias(f"{c}_{s}") for c in ("tile", "low", "high", "l0", "l1")], "label", "d", F.explode(F.sequence(F.col("l0") - more, F.col("h0") + more)).alias("x"), "l1", "h1")
        return sent.withColumn("y", F.explode(F.sequence(F.col("l1") - more, F.col("h1") + more))).drop("l1", "h1")

    met = spread("a", 0).join(spread("b", 1), ["label", "d", "x", "y"]).where((F.col("tile_a") <= F.col("tile_b")) & (F.col("x") == F.greatest(F.col("l0_a"), F.col("l0_b") - 1)) & (F.col("y") == F.greatest(F.col("l1_a"), F.col("l1_b") - 1)))
    gaps = F.transform(F.sequence(F.lit(0), F.size("low_a") - 1), lambda k: F.greatest(F.get("low_a", k) - F.get("high_b", k), F.get("low_b", k) - F.get("high_a", k), F.lit(0.0)))
    return met.where(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= most).withColumnRenamed("d", "d_a")


def embedding_components(vectors: DataFrame, *, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile_rows: int = TILE) -> DataFrame:
    """Returns vec_id, n_links, component_id and kept for every row."""
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    keys = {"k1": F.xxhash64("label", "v"), "k2": F.xxhash64(F.lit(1), "label", "v")}
    good = rows.withColumn("good", usable).withColumns(keys)
    groups = good.where("good").groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.min("vec_id").cast("long").alias("least"), F.count(F.lit(1)).alias("weight"))
    groups = materialize(groups.withColumn("node", F.monotonically_increasing_id()), "vectors")  # written, so that the numbers stay
    axes = principal_axes(groups)
    width = float(np.sqrt(max(1e-6, 2 - 2 * threshold)))
    order = ["label", "d", "c0", "c1", "c2", "lead", "node"]
    placed = groups.select("label", "v", "node", "weight").mapInArrow(with_leading(axes, width), "label string, v array<double>, node long, weight long, d int, c0 int, c1 int, c2 int, lead double")
    n = groups.count()
    parts = max(1, -(-n // (2 * tile_rows)))
    tiles = materialize(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(make_tiles(axes, tile_rows), TILES), "tiles")

    near = near_tiles(tiles.select("tile", "label", "d", "low", "high"), 2 - 2 * threshold + SLACK, width)
    pairs = near.select("tile_a", "tile_b", F.col("d_a").alias("d"))
    side = lambda s: tiles.select(*[F.col(c).alias(f"{c}_{s}") for c in ("tile", "node", "weight", "vectors")])
    met = pairs.join(side("a"), "tile_a").join(side("b"), "tile_b")
    spread = max(1, min(parts * parts, 4 * spark.sparkContext.defaultParallelism * max(1, parts // 8)))
    found = materialize(met.repartition(spread, "tile_a", "tile_b").mapInArrow(meetings(axes, threshold), "node long, links long, other long"), "links")
    counts = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("other is not null").select("node", "other"))

    linked = groups.select("k1", "k2", "node", "least", "weight").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    linked = materialize(linked, "linked")
    least = materialize(linked.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    known = linked.join(least, "root").select("k1", "k2", F.lit(True).alias("good"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    known = materialize(known, "components")
    out = good.select("vec_id", "k1", "k2", "good").join(known, ["k1", "k2", "good"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.col("vec_id").cast("long")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
