"""What steers an acquisition: budgets, spacing, admission in waves, other captures for pages that hold no content."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relictum.operators.outcomes import RESELECTABLE

REDIRECTS = (301, 302, 303, 307, 308)
THROTTLES = (429, 503)


@dataclass(frozen=True)
class Budgets:
    max_requests: int = 400
    max_index_requests: int = 20
    max_total_bytes: int = 200 << 20
    max_response_bytes: int = 8 << 20
    max_elapsed_ms: int = 15 * 60 * 1000
    max_redirects: int = 5
    max_attempts: int = 3
    max_pages: int = 30
    max_dependencies: int = 500


def running_totals(rows: DataFrame, order: list[str], sums: dict[str, str], cut: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """`rows` with rank (the number of rows before, by `order`) and for each of `sums` the total of its column over those rows.
    Rows are dealt in ranges; only one row a range is added up in one place."""
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__rank"), *[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    ahead = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("__range", *[F.coalesce(F.sum(f"__{n}").over(ahead), F.lit(0)).alias(f"__{n}") for n in ("rank", *sums)])
    before = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = placed.join(F.broadcast(carried), "__range")  # one row a partition
    own = {"rank": F.count(F.lit(1)).over(before)} | {n: F.sum(c).over(before) for n, c in sums.items()}
    return met.withColumns({n: (F.coalesce(v, F.lit(0)) + F.col(f"__{n}")).cast("long") for n, v in own.items()}).drop("__range", *[f"__{n}" for n in ("rank", *sums)])


#: Rows whose order column falls into one block of that width are sorted together; blocks of a key hand on what they hold.
BLOCK = 100_000


def block_of(order: Column, width: int) -> Column:
    return F.floor(order / F.lit(width)).cast("long")


def ledger(attempts: DataFrame, budgets: Budgets, *, key: str, order: str = "ord", width: int = BLOCK) -> DataFrame:
    """Each request with what its ledger had spent before it, and the first budget that refuses it. Needs is_index, bytes and
    elapsed_ms; one ledger for each key. A key's requests are sorted in blocks of `width` by their order, so a ledger with a
    third of all requests is the work of many tasks."""
    block = block_of(F.col(order), width)
    spent = {"requests": F.lit(1), "index": F.col("is_index").cast("int"), "bytes": F.col("bytes")}
    totals = attempts.groupBy(key, block.alias("__block")).agg(*[F.sum(c).alias(n) for n, c in spent.items()])
    ahead = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(key, "__block", *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"__{n}") for n in spent])
    before = Window.partitionBy(key, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    met = attempts.withColumn("__block", block).join(carried, [key, "__block"])
    counted = met.withColumns({f"spent_{n}": F.coalesce(F.sum(c).over(before), F.lit(0)) + F.col(f"__{n}") for n, c in spent.items()}).drop("__block", *[f"__{n}" for n in spent])
    refused = F.when(F.col("elapsed_ms") >= budgets.max_elapsed_ms, "elapsed time").when(F.col("spent_requests") >= budgets.max_requests, "requests").when(F.col("is_index") & (F.col("spent_index") >= budgets.max_index_requests), "index requests").when(F.col("spent_bytes") >= budgets.max_total_bytes, "total bytes")
    return counted.withColumn("refused_by", refused)


def schedule(requests: DataFrame, gap_ms: int, *, key: str, arrival: str = "arrival_ms", order: str = "ord", width: int = BLOCK) -> DataFrame:
    """Start of each request when a host's requests keep `gap_ms` apart: the recurrence start = max(arrival, last + gap) as a
    running maximum of arrival - n * gap. A host's requests are sorted in blocks of `width` by their order; a block hands on its
    number of requests and its largest slack."""
    w = Window.partitionBy(key, "__block").orderBy(order)
    numbered = requests.withColumn("__block", block_of(F.col(order), width)).withColumn("__n", F.row_number().over(w).cast("long") - 1).withColumn("__slack", F.col(arrival) - F.col("__n") * gap_ms)
    blocks = numbered.groupBy(key, "__block").agg(F.count(F.lit(1)).alias("rows"), F.max("__slack").alias("slack"))
    ahead = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("rows").over(ahead), F.lit(0)))
    blocks = blocks.select(key, "__block", "__before", F.max(F.col("slack") - F.col("__before") * gap_ms).over(ahead).alias("__most"))
    met = numbered.join(blocks, [key, "__block"])
    most = F.greatest(F.max("__slack").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__before") * gap_ms, F.col("__most"))
    return met.withColumn("start_ms", most + (F.col("__n") + F.col("__before")) * gap_ms).drop("__slack", "__n", "__block", "__before", "__most")


def attempt_verdict(status: Column, attempt: Column, hops: Column, budgets: Budgets) -> Column:
    """What one response leads to: follow, retry, stop with a kind of failure, or take."""
    throttled, failing = status.isin(*THROTTLES), (status >= 500) | (status == 408) | status.isNull()
    left = attempt < budgets.max_attempts
    return (
        F.when(status.isin(*REDIRECTS), F.when(hops < budgets.max_redirects, "follow").otherwise("redirect-limit"))
        .when(throttled, F.when(left, "retry").otherwise("provider-throttled"))
        .when(failing, F.when(left, "retry").otherwise(F.when(status.isNull(), "transport-error").otherwise("http-status")))
        .when(status >= 400, "http-status")
        .otherwise("take")
    )


def settle(responses: DataFrame, budgets: Budgets, *, key: str, order: str = "ord") -> DataFrame:
    """How each item's chain of responses ends: the verdict that stopped it, after how many requests and hops. Needs status,
    url (what was asked for) and location (where a redirect leads). A redirect to a URL asked for before is a loop."""
    w = Window.partitionBy(key).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    hop = F.col("status").isin(*REDIRECTS).cast("int")
    steps = responses.withColumns({"__hops": F.coalesce(F.sum(hop).over(before), F.lit(0)), "__asked": F.collect_set("url").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__n": F.row_number().over(w)})
    since = Window.partitionBy(key, "__hops").orderBy(order)
    steps = steps.withColumn("__try", F.row_number().over(since))
    loop = (hop == 1) & F.array_contains("__asked", F.col("location"))
    verdict = F.when(F.coalesce(loop, F.lit(False)), "redirect-loop").otherwise(attempt_verdict(F.col("status"), F.col("__try"), F.col("__hops"), budgets))
    said = steps.withColumn("verdict", verdict)
    ends = said.where(~F.col("verdict").isin("follow", "retry"))
    stop = ends.groupBy(key).agg(F.min_by(F.struct("verdict", F.col("__n").alias("requests"), F.col("__hops").alias("hops")), "__n").alias("s"))
    every = said.groupBy(key).agg(F.max("__n").alias("n"), F.max("__hops").alias("h"))
    return every.join(stop, key, "left").select(key, F.coalesce("s.verdict", F.lit("unfinished")).alias("verdict"), F.coalesce("s.requests", "n").cast("long").alias("requests"), F.coalesce("s.hops", "h").cast("long").alias("hops"))


def waves(roots: DataFrame, edges: DataFrame, cut: Callable[[DataFrame, str], DataFrame], *, max_waves: int | None = None, most: int | None = None) -> DataFrame:
    """What is reached from `roots` (node, ord) over `edges` (src, dst), with the wave that reached it, until nothing new is
    reached. Each wave is written by `cut` before the next one reads it. `most` admits only so many nodes, the first by wave and
    order: a budget's meaning. With `max_waves` what the last wave would still lead to is left out."""
    seen = front = cut(roots.select("node", F.col("ord").cast("long").alias("ord"), F.lit(0).alias("wave")), "wave0")
    number = 0
    while not front.isEmpty() and (max_waves is None or number < max_waves):
        number += 1
        met = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node"), F.col("ord"))
        fresh = met.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.min("ord").alias("ord"))
        front = cut(fresh.select("node", "ord", F.lit(number).alias("wave")), f"wave{number}")
        seen = seen.unionByName(front)
        if number % 8 == 0:  # so that the plan does not grow with the waves
            seen = cut(seen, "seen")
    return seen if most is None else seen.orderBy("wave", "ord", "node").limit(most)


def needs_other_capture(outcome: Column, attempts: Column) -> Column:
    """A page goes on to another capture from five outcomes, and once it has begun from any that is not ok."""
    return F.when(attempts > 0, outcome != "ok").otherwise(outcome.isin(*RESELECTABLE))


def reselect(history: DataFrame, ranked: DataFrame, max_attempts: int, *, key: str = "capture_key") -> DataFrame:
    """Which capture of a page ends up used, given what each would turn out to be. `history` has key and the outcome of the
    first choice; `ranked` has key, place (0 is the first choice), timestamp and outcome, in the order in which they would be
    tried. Tries go on until one is ok, the attempts are spent or none is left."""
    tried = ranked.where(F.col("place") <= max_attempts)
    first_ok = tried.groupBy(key).agg(F.min(F.when(F.col("outcome") == "ok", F.col("place"))).alias("ok_at"), F.max("place").alias("last"), F.count(F.lit(1)).alias("n_tried"))
    total = ranked.groupBy(key).agg(F.count(F.lit(1)).alias("n_known"))
    starts = history.join(first_ok, key, "left").join(total, key, "left").withColumn("starts", F.col("outcome").isin(*RESELECTABLE))
    stop = F.when(~F.col("starts"), "not-needed").when(F.col("ok_at").isNotNull(), "ok").when(F.col("n_known") - 1 > max_attempts, "attempt-limit").otherwise("no-remaining-alternative")
    used = F.when(F.col("starts") & F.col("ok_at").isNotNull(), F.col("ok_at")).otherwise(0)
    upto = F.when(~F.col("starts"), 0).otherwise(F.coalesce("ok_at", "last"))
    decided = starts.select(key, used.alias("used_place"), upto.alias("further_attempts"), stop.alias("stop_reason"))
    trail = tried.join(decided, key).where(F.col("place") <= F.col("further_attempts")).groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "timestamp", "outcome"))), lambda x: F.concat(x["timestamp"], F.lit("="), x["outcome"])), ", ").alias("trail"))
    return decided.join(trail, key, "left")
