"""The trie of conversations by partition refinement.

All conversations start in one class. Turn by turn a class splits by what its members say next; a class is named by its
least member and its depth. A member that is alone retires: what is left of its conversation is a unary chain, given by its
two ends. Rounds take blocks of turns that double in width up to MOST_WIDTH: within a round each member chains the digests of its
turns from the name of its class, and equal chains are equal classes; only members that are still in company go on, so
tails are never read. Sums over subtrees are folded back by doubling steps: each node hands what it has gathered to
its ancestor 1, 2, 4, ... levels up, so a deep trie needs few rounds.

Turns are compared by SHA-256 of role and text, so texts are read once and never shuffled. Places of turns come from range
partitions that hand on counts, so a conversation with very many turns is not one task's work.

Defined cases: rows without a conversation id belong to no conversation and are left out; null roles and texts count as empty; null
turns come first; turns that tie come by role, then by the digest of role and text, then as equals; repeated rows are turns of
their own; conversations of no turns (named by `members`) end at the root; an empty table gives no node; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relictum.llm.common import materialize

FIRST_WIDTH, MOST_WIDTH = 4, 1024
#: Nodes of a chain, or ids of a list, that go as one.
CHUNK = 1024
EMPTY = hashlib.sha256(b"").hexdigest()


class Trie(NamedTuple):
    """nodes: conv_id (the least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved (bytes of turns that members
    but one share, summed over the subtree). ends: conv_id of a member, node_conv_id and depth of the node where it ends;
    shared_ends: those of them whose node has other members too."""

    nodes: DataFrame
    ends: DataFrame
    shared_ends: DataFrame


def turn_key(role: Column, text: Column) -> Column:
    said = F.concat_ws(":", F.octet_length(role).cast("string"), role, text)  # the length keeps role and text apart
    return F.unhex(F.sha2(said.cast("binary"), 256))


def number_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted; each gets the number of rows of its conversation before it in this partition."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        ids = batch.column("conv_id").to_numpy()
        if not len(ids):
            continue
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        sizes = np.diff(np.append(starts, len(ids)))
        before = np.arange(len(ids)) - np.repeat(starts, sizes)
        if last is not None and ids[0] == last:
            before[: sizes[0]] += seen
        last, seen = ids[-1], int(before[-1]) + 1
        columns = [batch.column("conv_id"), pa.array(np.full(len(ids), part), pa.int32()), pa.array(before, pa.int64()), batch.column("key"), batch.column("bytes")]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "before", "key", "bytes"])


def placed_turns(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place, key, bytes): each turn's place in its conversation from 1, its digest and the length of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "key", "row"]
    keyed = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), turn_key(role, text).alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    keyed = materialize(keyed.withColumn("row", F.monotonically_increasing_id()), "turns")  # written, so that sampling reads no text
    runs = materialize(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number_runs, "conv_id long, part int, before long, key binary, bytes long"), "runs")
    # A conversation may cross partitions: at most the first and the last one of each.
    edges = runs.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    edge = runs.join(F.broadcast(edges), "part").where((F.col("conv_id") == F.col("low")) | (F.col("conv_id") == F.col("high")))
    counts = edge.groupBy("part", "conv_id").agg(F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = materialize(counts.select("part", "conv_id", ahead.alias("ahead")).where("ahead is not null"), "ahead")
    return runs.join(F.broadcast(ahead), ["part", "conv_id"], "left").select("conv_id", (F.col("before") + 1 + F.coalesce("ahead", F.lit(0))).alias("place"), "key", "bytes")  # a row or two a partition


def block_ends(longest: int) -> list[int]:
    ends, width = [0], FIRST_WIDTH
    while ends[-1] < longest:
        ends.append(ends[-1] + width)
        width = min(MOST_WIDTH, 2 * width)
    return ends[1:]


def block_of(place: Column) -> Column:
    """The round that a place belongs to."""
    ends, width = [], FIRST_WIDTH
    while width < MOST_WIDTH:
        ends.append((ends[-1] if ends else 0) + width)
        width *= 2
    number = F.lit(len(ends)) + F.floor((place - ends[-1] - 1) / MOST_WIDTH)
    for k in reversed(range(len(ends))):
        number = F.when(place <= ends[k], k).otherwise(number)
    return number.cast("int")


def split_block(active: DataFrame, turns: DataFrame, number: int) -> DataFrame:
    """One round: (conv_id, length, class, path), where path has the places in this block at which a member has company, and for
    each the class there, its size and the bytes of its last turn."""
    met = active.join(turns.where(F.col("block") == number), "conv_id").groupBy("conv_id", "length", "class").agg(F.sort_array(F.collect_list(F.struct("place", "key", "bytes"))).alias("t"))
    onward = lambda chain, turn: F.concat(chain, F.array(F.unhex(F.sha2(F.concat(F.element_at(chain, -1), turn["key"]), 256))))
    chain = F.aggregate("t", F.array(F.unhex(F.sha2(F.col("class").cast("string").cast("binary"), 256))), onward)
    steps = met.select("conv_id", "length", "class", F.explode(F.arrays_zip("t", F.slice(chain, 2, F.size("t")).alias("chain"))).alias("s"))
    steps = materialize(steps.select("conv_id", "length", "class", F.col("s.t.place").alias("place"), F.col("s.t.bytes").alias("bytes"), F.col("s.chain").alias("chain")), "steps")
    company = steps.groupBy("place", "chain").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).where("n > 1")
    company = materialize(company, "classes")  # written, so that Spark can split the members of a class that has very many
    shared = F.when(F.col("n").isNotNull(), F.struct("place", F.col("least").alias("class"), "n", "bytes"))
    return materialize(steps.join(company, ["place", "chain"], "left").groupBy("conv_id", "length", "class").agg(F.sort_array(F.collect_list(shared)).alias("path")), "paths")


def fold_back(nodes: DataFrame, deepest: int, sums: tuple[str, ...]) -> DataFrame:
    """`nodes` (conv_id, depth, parent, ...) with each of `sums` summed over the node's subtree."""
    state = nodes.withColumn("up", F.col("parent"))
    step = 1
    while step <= deepest:
        gathered = state.where("up is not null").groupBy(F.col("up").alias("conv_id"), (F.col("depth") - step).alias("depth")).agg(*[F.sum(c).alias(f"{c}_more") for c in sums])
        above = state.where("up is not null").select(F.col("conv_id").alias("up"), (F.col("depth") + step).alias("depth"), F.col("up").alias("further"))
        met = state.join(gathered, ["conv_id", "depth"], "left").join(above, ["up", "depth"], "left")
        kept = [F.col(c) for c in nodes.columns if c not in sums]
        state = materialize(met.select(*kept, *[(F.col(c) + F.coalesce(f"{c}_more", F.lit(0))).alias(c) for c in sums], F.col("further").alias("up")), "folded")
        step *= 2
    return state.drop("up")


def prefix_trie(turns: DataFrame, members: DataFrame | None = None) -> Trie:
    """`turns` as placed_turns gives them, with places 1, 2, ... in each conversation. `members` (conv_id, each once) adds
    conversations that have no turns."""
    spark = turns.sparkSession
    turns = turns.withColumn("block", block_of(F.col("place")))
    turns = materialize(turns, "blocks", by="block")
    lengths = turns.groupBy("conv_id").agg(F.max("place").alias("length"))
    if members is not None:
        lengths = members.select("conv_id").join(lengths, "conv_id", "left").select("conv_id", F.coalesce("length", F.lit(0)).alias("length"))
    lengths = materialize(lengths, "lengths")
    whole = lengths.agg(F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).first()

    root = F.lit(whole.least).cast("long")
    everyone = lengths.select("conv_id", "length", root.alias("class"))
    node = "conv_id long, depth long, parent long, n long, bytes long"
    shared = [spark.createDataFrame([(whole.least, 0, None, whole.n, 0)] if whole.n > 1 else [], node)]
    if whole.n > 1:
        tails = []
        ends = [everyone.where("length = 0").select("conv_id", root.alias("node_conv_id"), F.lit(0).cast("long").alias("depth"))]
        active = everyone.where("length > 0")
    else:  # alone from the root on
        tails = [everyone.select("conv_id", F.lit(0).cast("long").alias("first"), "length", F.lit(None).cast("long").alias("parent"))]
        ends, active = [everyone.where("false").select("conv_id", root.alias("node_conv_id"), F.lit(0).cast("long").alias("depth"))], None
    begin = 0
    for number, end in enumerate(block_ends(whole.longest or 0)):
        if active is None or active.isEmpty():
            break
        paths = split_block(active, turns, number)
        reached = F.lit(begin).cast("long") + F.size("path")
        last = F.coalesce(F.get("path", F.size("path") - 1)["class"], F.col("class"))
        steps = paths.select("conv_id", "class", "path", F.posexplode("path").alias("at", "here")).where("here.class = conv_id")
        parent = F.when(F.col("at") > 0, F.get("path", F.col("at") - 1)["class"]).otherwise(F.col("class"))
        shared.append(steps.select("conv_id", F.col("here.place").alias("depth"), parent.alias("parent"), "here.n", "here.bytes"))
        ends.append(paths.where(reached == F.col("length")).select("conv_id", last.alias("node_conv_id"), F.col("length").alias("depth")))
        tails.append(paths.where((reached < F.col("length")) & (reached < end)).select("conv_id", (reached + 1).alias("first"), "length", last.alias("parent")))
        active = paths.where((reached < F.col("length")) & (reached == end)).select("conv_id", "length", last.alias("class"))
        begin = end

    tails, ends, shared = (materialize(reduce(DataFrame.unionByName, f), name) for f, name in ((tails, "tails"), (ends, "ends"), (shared, "shared")))
    children = shared.where("depth > 0").select("parent", (F.col("depth") - 1).alias("depth"), F.lit(0).alias("lone"))
    children = children.unionByName(tails.where("first > 0").select("parent", (F.col("first") - 1).alias("depth"), F.lit(1).alias("lone")))
    children = children.groupBy(F.col("parent").alias("conv_id"), "depth").agg(F.count(F.lit(1)).alias("n_children"), F.sum("lone").alias("lone"))
    known = shared.join(children, ["conv_id", "depth"], "left")
    leaves = F.coalesce("lone", F.lit(0)) + F.when(F.col("n_children").isNull(), 1).otherwise(0)
    known = materialize(known.select("conv_id", "depth", "parent", "n", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), leaves.cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("bytes")).alias("saved")), "known")
    deepest = known.agg(F.max("depth")).first()[0] or 0
    folded = fold_back(known, deepest, ("n_leaves", "saved"))
    folded = folded.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved")

    # Chains come out in pieces dealt over all tasks: one conversation may hold most of the nodes.
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = tails.withColumn("low", F.explode(F.sequence(F.col("first"), F.col("length"), F.lit(CHUNK).cast("long")))).repartition(dealt, "conv_id", "low")
    one = F.lit(1).cast("long")
    chain = pieces.withColumn("depth", F.explode(F.sequence(F.col("low"), F.least(F.col("low") + (CHUNK - 1), F.col("length")))))
    chain = chain.select("conv_id", "depth", F.when(F.col("depth") == F.col("first"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"), (F.col("depth") < F.col("length")).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved"))
    alone = tails.select("conv_id", F.col("conv_id").alias("node_conv_id"), F.col("length").alias("depth"))
    return Trie(folded.unionByName(chain), ends.unionByName(alone), ends)


def joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node_conv_id, depth, conv_id) come sorted. A list that surely lies within this partition leaves as its digest, others as
    pieces of at most CHUNK ids."""
    part = TaskContext.get().partitionId()
    now, held, sent, first = None, [], 0, True
    out: list[tuple] = []

    def leave(whole: bool) -> None:
        nonlocal held, sent
        said = ",".join(map(str, held)).encode()
        out.append((*now, part, sent, None if whole else said, hashlib.sha256(said).hexdigest() if whole else None))
        held, sent = [], sent + 1

    def batch_out() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        rows, out[:] = list(zip(*out, strict=True)) or [()] * 6, []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["node_conv_id", "depth", "part", "piece", "ids", "digest"])

    for batch in batches:
        for node, depth, conv in zip(*(batch.column(c).to_pylist() for c in ("node_conv_id", "depth", "conv_id")), strict=True):
            if now != (node, depth):
                if now is not None:
                    leave(not first and not sent)
                    first = False
                now, sent = (node, depth), 0
            elif len(held) >= CHUNK:
                leave(False)
            held.append(conv)
        if len(out) >= CHUNK:
            yield batch_out()
    if now is not None:
        leave(False)
    yield batch_out()


def hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state = None, None
    out: list[tuple] = []
    for batch in batches:
        for node, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("node_conv_id", "depth", "ids")), strict=True):
            if now != (node, depth):
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = (node, depth), hashlib.sha256(ids)
            else:
                state.update(b"," + ids)
    if now is not None:
        out.append((*now, state.hexdigest()))
    rows = list(zip(*out, strict=True)) or [()] * 3
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, [pa.int64(), pa.int64(), pa.string()], strict=True)], names=["node_conv_id", "depth", "digest"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node_conv_id, depth, ends_sha256): SHA-256 of the comma-joined ids that end at a node, ascending. The ids of a node with very many
    arrive in ready pieces, in order; only their digest, a single chain by its nature, is one task's work."""
    order = ["node_conv_id", "depth", "conv_id"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined_ids, "node_conv_id long, depth long, part int, piece int, ids binary, digest string")
    pieces = materialize(pieces, "pieces")
    rest = pieces.where("ids is not null").repartition("node_conv_id", "depth").sortWithinPartitions("node_conv_id", "depth", "part", "piece")
    made = rest.mapInArrow(hash_pieces, "node_conv_id long, depth long, digest string")
    return pieces.where("digest is not null").select("node_conv_id", "depth", F.col("digest").alias("ends_sha256")).unionByName(made.withColumnRenamed("digest", "ends_sha256"))
