"""Near-duplicates by similarity of word shingles: candidates through Golay-coded wide fingerprints, decided on the shingles.

Copies that share four fifths of their five-word shingles differ in five to ten of 64 bits, beyond what Golay decoding of
three segments reaches. So texts get WIDE bits here, from their distinct three-word shingles, and each table cuts segments
of 23 bits out of them in an order of its own. A segment is decoded to its nearest Golay codeword, so that words which differ
in a few bits mostly share the 12-bit index; the indices, and single bits for the rest, make the table's key. A pair at
`similarity` differs in an expected share of bits, most when its change is one run of words; the number of tables follows
from that share and the wanted `recall`, the bits of a key from the number of texts, so that buckets stay small and recall
stays the same at every size. Fingerprints in one bucket are compared in full; those within the share and SPARE standard
deviations are candidates, and each bucket sends on a spanning forest of them.

Candidates only bring texts together: in each component of candidates the sets of five-word shingles are compared, and
only pairs of that Jaccard similarity link. Buckets and components beyond a bound are cut into chunks, and every two chunks
meet in a task of their own, so that all members are compared.

Defined cases: as in `simhash`: null, empty and blank texts are copies of each other, repeated rows and ids fall into one
group, null ids come last, an empty table gives an empty table; fewer than five words make one shingle.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relictum.llm.common import connected_components, free_name, materialize, slots, text_key, text_udf, with_maybe
from relictum.llm.simhash import Golay, shingle_hashes

WIDE = 256
WORDS = WIDE // 64
HELD = 20_000
SPARE = 2.5
TABLES_AT_ONCE = 24
CHUNK_ROWS, CHUNK_SHINGLES = 500, 1 << 20
PRINT = [f"w{k}" for k in range(WORDS)]
KEYS = "key long, node long, " + ", ".join(f"{w} long" for w in PRINT)


def spread(h: np.ndarray) -> np.ndarray:
    """WORDS further hashes of each hash."""
    out = np.empty((len(h), WORDS), np.uint64)
    for k in range(WORDS):
        x = h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def wide_fingerprint(text: str, words: int = 3) -> bytes:
    hashes = np.unique(np.array(shingle_hashes(text, words), np.uint64))
    if not len(hashes):
        return bytes(WIDE // 8)
    total = np.zeros(WIDE, np.int64)
    for i in range(0, len(hashes), 4080):
        bits = np.unpackbits(spread(hashes[i : i + 4080]).view(np.uint8).reshape(-1, WIDE // 8), axis=1)
        whole = len(bits) // 255 * 255
        total += bits[:whole].reshape(-1, 255, WIDE).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.uint8)
    return np.packbits(2 * total > len(hashes)).tobytes()


def shingle_set(text: str, words: int = 5) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words) or [0], np.uint64))


def wide_array(texts: list[str]) -> pa.Array:
    """The fingerprint, and a digest of the set of five-word shingles."""
    digests = [hashlib.blake2b(shingle_set(x).tobytes(), digest_size=16).digest() for x in texts]
    return pa.StructArray.from_arrays([pa.array([wide_fingerprint(x) for x in texts], pa.binary()), pa.array(digests, pa.binary())], names=["wide", "digest"])


def sets_array(texts: list[str]) -> pa.Array:
    return pa.array([shingle_set(x).tobytes() for x in texts], pa.binary())


def differing_share(similarity: float) -> float:
    """Expected share of differing bits of texts whose shingle sets have that Jaccard similarity, if the change is one run of
    words. Scattered edits touch fewer of the three-word shingles and differ in fewer bits."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def same_codeword(share: float) -> float:
    """Chance that two words of 23 bits whose bits differ with chance `share` have the same nearest codeword: the sum over all
    pairs of error patterns of at most three bits (i of one, j of the other, o in common)."""
    patterns = ((i, j, o) for i in range(4) for j in range(4) for o in range(min(i, j) + 1))
    return sum(math.comb(23, i) * math.comb(i, o) * math.comb(23 - i, j - o) * share ** (i + j - 2 * o) * (1 - share) ** (23 - i - j + 2 * o) for i, j, o in patterns) / 2048


def tables_for(n: int, share: float, recall: float) -> tuple[int, int]:
    """(bits of a key, number of tables)."""
    bits = min(60, max(16, math.ceil(math.log2(max(2, n))) + 2))
    hit = same_codeword(share) ** (bits // 12) * (1 - share) ** (bits % 12)
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - hit))


def sampled_keys(bits: int, first: int, last: int, seed: int = 11):
    """Keys of the tables first .. last - 1: an index of 12 bits for each segment, then single bits."""
    segments, single = divmod(bits, 12)
    rng = np.random.default_rng(seed)
    order = [rng.permutation(WIDE)[: 23 * segments + single] for _ in range(last)][first:]
    tables = last - first
    pick = np.zeros((segments + 1, WIDE, tables))  # sums of powers of two, exact in double precision
    for t, places in enumerate(order):
        for k in range(segments):
            pick[k, places[23 * k : 23 * k + 23], t] = 2.0 ** np.arange(23)
        pick[segments, places[23 * segments :], t] = 2.0 ** np.arange(single)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                raw = np.frombuffer(b"".join(part.column("wide").to_pylist()), np.uint8).reshape(-1, WIDE // 8)
                on = np.unpackbits(raw, axis=1).astype(np.float64)
                value = (on @ pick[segments]).astype(np.int64)
                for k in range(segments):
                    value = value << 12 | code.index((on @ pick[k]).astype(np.int64))
                # one number for table and value: where two fall together, rows meet that then prove unlike
                key = ((value.T.view(np.uint64) << np.uint64(12)) ^ np.arange(first, last, dtype=np.uint64)[:, None]) * np.uint64(0x9E3779B97F4A7C15)
                words = np.frombuffer(raw.tobytes(), np.int64).reshape(-1, WORDS)
                columns = [key.ravel().view(np.int64), np.tile(part.column("node").to_numpy(), tables), *(np.tile(words[:, k], tables) for k in range(WORDS))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", *PRINT])

    return run


FOREST = "a long, b long, key long, chunk int, " + ", ".join(f"{w} long" for w in PRINT)


def grow(n: int, near_of: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Tree edges of the components of 0 .. n - 1; `near_of` says which of some rows link with a row."""
    left, links = np.arange(n), []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = near_of(x, left)
            if near.any():
                links += [(int(x), int(y)) for y in left[near]]
                frontier += list(left[near])
                left = left[~near]
    return links


def bucket_forest(most: int, held_rows: int = HELD):
    """Rows (key, node, print) come sorted by key; links leave as (a, b). A bucket beyond `held_rows` is cut into chunks: their
    own links leave, and all their rows (as a), so that every two chunks can meet (`chunk_pairs`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        chunk = 0
        ended = None
        a: list[int] = []
        b: list[int] = []

        def out(a, b=None, key=None, chunk=None, wide=None) -> pa.RecordBatch:
            n = len(a)
            column = lambda x, kind: pa.nulls(n, kind) if x is None else pa.array(x, kind)
            prints = [None if wide is None else np.ascontiguousarray(wide[:, k]).view(np.int64) for k in range(WORDS)]
            names = [x.split()[0] for x in FOREST.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), column(b, pa.int64()), column(key, pa.int64()), column(chunk, pa.int32()), *(column(x, pa.int64()) for x in prints)], names=names)

        def link(node: np.ndarray, wide: np.ndarray) -> None:
            for x, y in grow(len(node), lambda x, left: np.bitwise_count(wide[left] ^ wide[x]).sum(1) <= most):
                a.append(int(node[x]))
                b.append(int(node[y]))

        def settle(columns: list[np.ndarray]) -> None:
            key, node, wide = columns
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            size = np.diff(cut)
            two = cut[:-1][size == 2]  # most buckets
            two = two[np.bitwise_count(wide[two] ^ wide[two + 1]).sum(1) <= most]
            a.extend(node[two].tolist())
            b.extend(node[two + 1].tolist())
            for i in np.flatnonzero(size > 2):
                link(node[cut[i] : cut[i + 1]], wide[cut[i] : cut[i + 1]])

        def part(columns: list[np.ndarray]) -> pa.RecordBatch:
            key, node, wide = columns
            link(node, wide)
            return out(node, None, key, np.full(len(node), chunk), wide)

        for batch in batches:
            if not batch.num_rows:
                continue
            wide = np.stack([batch.column(w).to_numpy(zero_copy_only=False) for w in PRINT], axis=1).view(np.uint64)
            columns = [*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node")), wide]
            if chunk:  # the bucket before this batch is one in chunks, and what is kept of it is its latest chunk
                same = columns[0] == ended
                own = len(same) if same.all() else int(np.argmin(same))
                if own < len(same):
                    kept = [np.concatenate([x, y[:own]]) for x, y in zip(kept, columns, strict=True)]
                    if len(kept[0]):
                        yield part(kept)
                    kept, chunk, columns = None, 0, [c[own:] for c in columns]
            if kept is not None:
                columns = [np.concatenate([x, y]) for x, y in zip(kept, columns, strict=True)]
            begin = int(np.argmax(columns[0] == columns[0][-1]))
            if begin:
                settle([c[:begin] for c in columns])
            kept = [c[begin:] for c in columns]
            while len(kept[0]) > held_rows:
                ended = kept[0][0]
                yield part([c[:held_rows] for c in kept])
                kept, chunk = [c[held_rows:] for c in kept], chunk + 1
            if len(a) > 50_000:
                yield out(a, b)
                a.clear()
                b.clear()
        if kept is not None and len(kept[0]):
            if chunk:
                yield part(kept)
            else:
                settle(kept)
        yield out(a, b)

    return run


def chunk_pairs(rows: DataFrame, whole: list[str], chunk: str, chunks: str) -> DataFrame:
    """Each row once for every other chunk of its group, with the pair of chunks as i and j; a group of one chunk stays."""
    others = F.when(F.col(chunks) == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col(chunks) - 1), F.col(chunk)))
    each = rows.withColumn("__other", F.explode(others))
    return each.withColumns({"i": F.least(chunk, "__other"), "j": F.greatest(chunk, "__other")}).select(*whole, "i", "j", *[c for c in rows.columns if c not in (*whole, chunk, chunks)])


def candidates(distinct: DataFrame, most: int, bits: int, tables: int) -> DataFrame:
    """Links (a, b) of nodes whose fingerprints share a bucket and differ in at most `most` bits; some tables at a time."""
    found = []
    met = lambda rows, forest: rows.repartition("key").sortWithinPartitions("key").mapInArrow(forest, FOREST)
    for first in range(0, tables, TABLES_AT_ONCE):
        keys = distinct.select("node", "wide").mapInArrow(sampled_keys(bits, first, min(tables, first + TABLES_AT_ONCE)), KEYS)
        found.append(materialize(met(keys, bucket_forest(most)), "candidates"))
        over = found[-1].where("b is null")
        if not over.isEmpty():
            chunks = over.groupBy("key").agg((F.max("chunk") + 1).alias("chunks"))
            pairs = chunk_pairs(over.join(chunks, "key").select("key", "chunk", "chunks", F.col("a").alias("node"), *PRINT), ["key"], "chunk", "chunks")
            pairs = pairs.select(F.xxhash64("key", "i", "j").alias("key"), "node", *PRINT)
            found.append(materialize(met(pairs, bucket_forest(most, held_rows=1 << 62)), "chunks"))
    return functools.reduce(DataFrame.unionByName, found).where("b is not null").select("a", "b").distinct()


def set_forest(nodes: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Tree edges of the components that sets of at least that Jaccard similarity make."""
    size = np.array([len(x) for x in sets])
    number = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    begin = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(int(number.max()) + 1, np.int32)

    def near(x: int, left: np.ndarray) -> np.ndarray:
        own = number[begin[x] : begin[x + 1]]
        mark[own] = 1
        shared = np.add.reduceat(mark[number], begin[:-1])[left]
        mark[own] = 0
        return shared / (size[left] + size[x] - shared) >= similarity

    return [(nodes[x], nodes[y]) for x, y in grow(len(nodes), near)]


def decided(similarity: float):
    """Rows (root, i, j, node, set) come sorted by the first three; links of each group leave as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, sets, links = None, [], [], []
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j", "node", "set")), strict=True))
        for *key, node, data in rows:
            if key != group:
                if len(nodes) > 1:
                    links += set_forest(nodes, sets, similarity)
                group, nodes, sets = key, [], []
            nodes.append(node)
            sets.append(np.frombuffer(data, np.uint64))
        if len(nodes) > 1:
            links += set_forest(nodes, sets, similarity)
        for at in range(0, len(links), 50_000):
            part = links[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([y for _, y in part], pa.int64())], names=["a", "b"])

    return run


def known_prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every text read once: (doc_id, key, wide, digest), `key` for the text and `digest` for its set of shingles."""
    known = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"), text_udf(wide_array, "struct<wide:binary,digest:binary>")(F.col(text_col)).alias("p"))
    return materialize(known.select("doc_id", "key", "p.*"), "prints")


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, recall: float = 0.98, chunk_rows: int = CHUNK_ROWS, known: DataFrame | None = None) -> DataFrame:
    """One row for each distinct set of shingles: digest, root (the group's key), and the least (none, id, key) of its rows,
    `none` for a null id and `key` for the text."""
    known = known_prints(docs, id_col, text_col) if known is None else known
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "key")).alias("least")
    distinct = known.groupBy("digest").agg(F.first("wide").alias("wide"), least).withColumn("node", F.monotonically_increasing_id())
    distinct = materialize(distinct, "wide")  # written, so that the numbers stay
    share = differing_share(similarity)
    most = math.floor(WIDE * share + SPARE * math.sqrt(WIDE * share * (1 - share)))
    bits, tables = tables_for(distinct.count(), share, recall)
    roots = connected_components(candidates(distinct, most, bits, tables))
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    members = materialize(distinct.join(members, "node").select("node", "root", F.col("least.id").alias("id"), F.col("least.key").alias("key")), "members")
    # only texts that the bitmap of members may hold are dealt out
    texts = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("__key"), F.col(text_col).alias("text"))
    texts = with_maybe(texts, slots(members, "key", "id"), "__maybe", F.col("__key"), F.col("doc_id")).where("__maybe")
    texts = texts.join(members, (F.col("__key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")))
    sets = texts.select("node", "root", text_udf(sets_array, "binary")(F.col("text")).alias("set"))
    sets = materialize(sets.dropDuplicates(["node"]), "sets")
    chunks = sets.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / chunk_rows), F.ceil(F.sum(F.length("set") / 8) / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    cut = sets.join(materialize(chunks, "sizes"), "root").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    pairs = chunk_pairs(cut, ["root"], "chunk", "chunks").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    links = materialize(pairs.mapInArrow(decided(similarity), "a long, b long").distinct(), "links")
    found = connected_components(links)
    return materialize(distinct.join(found, "node", "left").select("digest", F.coalesce("root", "node").alias("root"), "least"), "similar")


def drop_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, **options) -> DataFrame:
    """One row of each group: that of the smallest id, and among rows of that id that of the smallest text key; a null id is
    last. Rows that are no copy pass as they are; only those that may be one are dealt out."""
    known = known_prints(docs, id_col, text_col)
    groups = similar_groups(docs, id_col=id_col, text_col=text_col, similarity=similarity, known=known, **options)
    best = materialize(groups.groupBy("root").agg(F.min("least").alias("best")), "best")
    placed = materialize(groups.select("digest", "root").join(best, "root").select("digest", "best"), "placed")
    rows = known.groupBy("doc_id", "key", "digest").agg(F.count(F.lit(1)).alias("n")).join(placed, "digest")
    stays = (F.col("key") == F.col("best.key")) & F.col("doc_id").eqNullSafe(F.col("best.id"))
    touched = rows.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), stays.alias("__stays"), "n").where("n > 1 or not __stays").drop("n")
    touched = materialize(touched, "touched")
    key, maybe = free_name(docs, "text_key"), free_name(docs, "maybe")
    flagged = with_maybe(docs.withColumn(key, text_key(F.col(text_col))), slots(touched, "__key", "__id"), maybe, F.col(key), F.col(id_col))
    hit = flagged.where(F.col(maybe))
    hit = hit.join(touched, (hit[key] == touched["__key"]) & hit[id_col].eqNullSafe(touched["__id"]), "left").where("__stays is null or __stays").select(*flagged.columns)
    return flagged.where(~F.col(maybe)).unionByName(hit.dropDuplicates([id_col, key])).drop(key, maybe)
