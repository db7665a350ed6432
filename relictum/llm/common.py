"""Pieces that the operators of this subpackage share: reading, shared working tables, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relictum.workspace import cut as materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_udf(fn: Callable[[list[str]], pa.Array], returns: str, piece_bytes: int = 4 << 20) -> Callable[[Column], Column]:
    """A vectorised function of one text column. `fn` gets lists of texts of about `piece_bytes` in all (null: empty) and
    returns an Arrow array. It counts as nondeterministic, so that the optimizer never evaluates it twice."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts, begin, size = [], 0, 0
            for i, n in enumerate(pc.binary_length(texts).to_pylist()):
                size += n or 0
                if size >= piece_bytes:
                    parts.append(fn([x or "" for x in texts.slice(begin, i + 1 - begin).to_pylist()]))
                    begin, size = i + 1, 0
            if begin < len(texts) or not parts:
                parts.append(fn([x or "" for x in texts.slice(begin).to_pylist()]))
            yield pa.concat_arrays(parts)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(run, returns).asNondeterministic()
    return lambda col: udf(col.cast("string"))


def free_name(df: DataFrame, name: str) -> str:
    """A name for a passing column that no column of `df` bears."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """A digest of a whole text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


SLOTS = 1 << 24


def slots(keys: DataFrame, *columns: str) -> DataFrame:
    """A bitmap of hashed keys, (word, bits), of at most SLOTS / 64 rows whatever the number of keys."""
    slot = F.pmod(F.xxhash64(*columns), F.lit(SLOTS))
    marked = keys.select(F.shiftright(slot, 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int")).alias("bit"))
    return materialize(marked.groupBy("word").agg(F.bit_or("bit").alias("bits")), "slots")


def with_maybe(df: DataFrame, bitmap: DataFrame, name: str, *columns: Column) -> DataFrame:
    """`df` with a flag: false where the key is surely not among those of the bitmap, so that such rows need no join."""
    slot = F.pmod(F.xxhash64(*columns), F.lit(SLOTS))
    word = free_name(df, "word")
    keyed = df.withColumn(word, F.shiftright(slot, 6).cast("int"))
    held = bitmap.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    met = keyed.join(F.broadcast(held), keyed[word] == held["__word"], "left")  # at most SLOTS / 64 rows
    return met.withColumn(name, F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).drop("__word", "__bits", word)


def held_out(doc_id: Column) -> Column:
    """One fifth of the ids, fixed by a checksum of the id as text; a null id counts as the text 'null'."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), F.lit(5)) == 0


def drawn_labels(labels: DataFrame, label_col: str, sample_rows: int) -> tuple[DataFrame, list[int], list[float]]:
    """(doc_id, y) of about `sample_rows` labelled ids of each class outside the held-out fifth, drawn by a hash of the id, with
    the size and the drawn share of each class. Ids whose labels disagree are left out. The result is small by its bound."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(F.col(label_col).cast("int")).alias("y"), F.max(F.col(label_col).cast("int")).alias("__most")).where(F.col("y") == F.col("__most")).drop("__most")
    known = materialize(known, "labels")
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = [sizes.get(0, 0), sizes.get(1, 0)]
    share = [min(1.0, sample_rows / max(1, k)) for k in n]
    lot = F.pmod(F.xxhash64(F.lit("labels"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return known.where(lot < F.when(F.col("y") == 1, share[1]).otherwise(share[0])), n, share


def drawn_rows(docs: DataFrame, drawn: DataFrame, text_col: str) -> DataFrame:
    """(doc_id, y, text) of the drawn ids; of rows that share an id the one with the least text counts."""
    rows = docs.select("doc_id", F.col(text_col).cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def local_forest(batches: Iterator[pa.RecordBatch], most_nodes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one task: at most one edge for each node leaves. Beyond `most_nodes` what is held leaves and
    the work begins anew; edges that leave say the same as those that came."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def held() -> Iterator[pa.RecordBatch]:
        pairs = np.array([(x, root(x)) for x in list(parent)], np.int64).reshape(-1, 2)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        for i in range(0, len(pairs), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + 50_000, k].copy()) for k in (0, 1)], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > most_nodes:
            yield from held()
            parent.clear()
    yield from held()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """`edges` has two long columns. Returns (node, root) for every node that an edge names but the roots themselves; root
    is the smallest node of its component. Alternating large-star and small-star steps over tables in the shared folder; the
    minimum of each node is written before it is joined, so that Spark can split the edges of a node that has very many."""
    a, b = (F.col(c) for c in edges.columns[:2])
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")
    e = materialize(e.mapInArrow(local_forest, "u long, v long").distinct(), "edges")
    signature = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = materialize(large, "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        e = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        after = e.agg(signature).first()[0]
        if after == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
