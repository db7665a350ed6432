"""SimHash near-duplicates, found through fuzzy hashing with the binary Golay code.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. If two fingerprints differ in at most 3 bits, then by the
pigeonhole principle either two segments are equal, or one is equal and another differs in exactly one bit, or all three
differ in exactly one bit. Equal segments are keys as they stand. For a segment that differs in exactly one bit the key is
the 12-bit index of a Golay codeword: the fingerprint of even parity there gives the codeword that its segment decodes to,
the one of odd parity those of all its neighbours, five or six in number, so the two share a key. Fingerprints with a
common key are compared bit by bit; each bucket sends on a spanning forest of its links, never all its pairs.

Defined cases: null and empty texts, and those of white space, have fingerprint zero and link with each other; fewer than
three words make one shingle; repeated rows and ids fall into one group; a group whose ids are all null has a null
component; columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relictum.llm.common import connected_components, free_name, materialize, text_key, text_udf

GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
SEGMENTS = ((0, 22), (22, 21), (43, 21))
DISTANCE = 3


def shingle_hashes(text: str, words: int = 3, seed: int = 42) -> list[int]:
    import xxhash

    digest = xxhash.xxh64_intdigest
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and exactly the white space of ASCII
    if not tokens:
        return []
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return [digest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    return [digest(joined[a:b], seed) for a, b in zip(begins[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)]


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    hashes = shingle_hashes(text, words, seed)
    if not hashes:
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = np.array(hashes[i : i + 4096], "<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints_array(texts: list[str]) -> pa.Array:
    return pa.array(np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64))


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator polynomial."""
    left = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        left ^= ((left >> bit) & 1) * (GENERATOR << (bit - 11))
    return left


def coset_leaders() -> np.ndarray:
    """The one error pattern of at most three bits for each of the 2048 syndromes: the code is perfect."""
    one = 1 << np.arange(23)
    two = (one[:, None] | one[None, :]).ravel()
    three = (two[:, None] | one[None, :]).ravel()
    errors = np.unique(np.concatenate([[0], one, two, three]))
    leaders = np.zeros(2048, np.int64)
    leaders[syndromes(errors)] = errors
    return leaders


class Golay:
    def __init__(self) -> None:
        self.leaders = coset_leaders()

    def index(self, words: np.ndarray) -> np.ndarray:
        """12-bit index of the nearest codeword."""
        return (words ^ self.leaders[syndromes(words)]) >> 11

    def keys(self, words: np.ndarray, bits: int) -> list[np.ndarray]:
        """For each segment value: one index if its parity is even, else those of all its neighbours."""
        near = np.sort(self.index(words[:, None] ^ (1 << np.arange(bits))[None, :]), axis=1)
        first = np.concatenate([np.ones((len(words), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
        odd = (np.bitwise_count(words) & 1).astype(bool)
        own = self.index(words)
        return [near[i][first[i]] if odd[i] else own[i : i + 1] for i in range(len(words))]


def bucket_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp): ten families of keys, told apart by the bits from 48 on."""
    code = Golay()
    for batch in batches:
        everything = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(everything), 2048):
            fps = everything[at : at + 2048]
            raw = [((fps >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
            fuzzy = [code.keys(r, n) for r, (_, n) in zip(raw, SEGMENTS, strict=True)]
            keys, owners = [], []
            for i, (a, b, c) in enumerate(zip(*fuzzy, strict=True)):
                x, y, z = (int(r[i]) for r in raw)
                three = (a[:, None, None] << 24 | b[None, :, None] << 12 | c[None, None, :]).ravel()
                own = np.concatenate([
                    [x << 22 | y, 1 << 48 | x << 22 | z, 2 << 48 | y << 22 | z],
                    3 << 48 | x << 12 | b, 4 << 48 | x << 12 | c, 5 << 48 | y << 12 | a,
                    6 << 48 | y << 12 | c, 7 << 48 | z << 12 | a, 8 << 48 | z << 12 | b,
                    9 << 48 | three,
                ])
                keys.append(own)
                owners.append(len(own))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys), pa.int64()), pa.array(np.repeat(fps, owners).view(np.int64))], names=["key", "fp"])


def forest(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Tree edges of the components that links within `distance` make of one bucket."""
    left, out = np.unique(fps), []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                found = left[near]
                out += [(int(x), int(f)) for f in found]
                frontier += list(found)
                left = left[~near]
    return out


def bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; links of each bucket leave as (a, b)."""
    kept_k, kept_f = np.empty(0, np.int64), np.empty(0, np.uint64)

    def links(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
        sizes = np.diff(cut)
        a, b = [], []
        two = cut[:-1][sizes == 2]
        near = np.bitwise_count(f[two] ^ f[two + 1]) <= DISTANCE
        a += f[two][near].tolist()
        b += f[two + 1][near].tolist()
        for i in np.flatnonzero(sizes > 2):
            for x, y in forest(f[cut[i] : cut[i + 1]]):
                a.append(x)
                b.append(y)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64))], names=["a", "b"])

    for batch in batches:
        k = np.concatenate([kept_k, batch.column(0).to_numpy(zero_copy_only=False)])
        f = np.concatenate([kept_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(k):
            continue
        done = int(np.searchsorted(k, k[-1]))
        if done:
            yield from links(k[:done], f[:done])
        kept_k, kept_f = k[done:], f[done:]
    if len(kept_k):
        yield from links(kept_k, kept_f)


def fingerprint_groups(prints: DataFrame, *, id_col: str = "doc_id", fp_col: str = "fp") -> DataFrame:
    """One row for each distinct fingerprint: fp, root (the group's key), component_id (the group's smallest id)."""
    fps = materialize(prints.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("least_id")), "fingerprints")
    keys = fps.select("fp").mapInArrow(bucket_keys, "key long, fp long")
    links = keys.repartition("key").sortWithinPartitions("key").mapInArrow(bucket_links, "a long, b long").distinct()
    roots = connected_components(links)
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "rooted")
    ids = materialize(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "ids")
    return materialize(rooted.join(ids, "root").select("fp", "root", "least_id", "component_id"), "groups")


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without its texts, with fp (the fingerprint as a signed long) and component_id. Each text is read once."""
    prints = docs.drop("fp", "component_id").withColumn("fp", text_udf(fingerprints_array, "long")(F.col(text_col))).drop(text_col)
    known = materialize(prints, "prints")
    groups = fingerprint_groups(known.select(F.col(id_col).alias("doc_id"), "fp"))
    return known.join(groups.select("fp", "component_id"), "fp", "left")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group: that of the smallest id, among rows of that id that of the smallest fingerprint, and of rows
    alike in both that of the smallest text key; a null id is last."""
    known = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"), text_udf(fingerprints_array, "long")(F.col(text_col)).alias("fp"))
    known = materialize(known.groupBy("doc_id", "fp").agg(F.min("key").alias("key")), "prints")
    order = F.struct(F.col("least_id").isNull().alias("none"), F.col("least_id"), F.col("fp"))
    best = materialize(fingerprint_groups(known).groupBy("root").agg(F.min(order).alias("best")).select("best.least_id", "best.fp"), "best")
    known = known.join(best, (known["fp"] == best["fp"]) & known["doc_id"].eqNullSafe(best["least_id"]), "left_semi").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
    key = free_name(docs, "text_key")
    keyed = docs.withColumn(key, text_key(F.col(text_col)))
    kept = keyed.join(known, (keyed[key] == known["__key"]) & keyed[id_col].eqNullSafe(known["__id"]), "left_semi")
    return kept.dropDuplicates([id_col, key]).drop(key)
