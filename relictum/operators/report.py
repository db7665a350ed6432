"""The report of a job: totals that are small whatever the job's size, and lists that are tables.

Totals come from one pass over the items, so every count is of the same rows. Lists are never gathered anywhere: each is a
DataFrame with a column for each thing that a report says, derived from the tables of a job. Columns that a job's items lack
(no asset was looked up, nothing was scored) count as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relictum.functions.time import DAY, distance_seconds
from relictum.functions.url import local_path, replay_modifier
from relictum.operators.fidelity import BANDS, WEIGHTS, rounded

ITEM = {
    "original_url": "string", "kind": "string", "relation": "string", "requested_ts": "string", "archive_status": "string", "from_excluded": "boolean", "referrer": "string", "referring_timestamp": "string",
    "status": "string", "unattempted_reason": "string", "failure": "struct<kind:string,message:string,http_status:int,retryable:boolean>", "http_status": "int", "redirects": "int", "served_ts": "string",
    "distance_seconds": "long", "requests": "long", "index_requests": "long", "bytes_read": "long", "body_hash": "string", "content_type": "string", "validated": "boolean", "truncated": "boolean", "delta_seconds": "long",
    "temporally_distant": "boolean", "considered": "long", "digests": "long", "resolution_detail": "string", "lookup_note": "string", "outcome": "string", "outcome_source": "string", "outcome_detail": "string",
    "score": "double", "band": "string", "weakest": "string", "applied_weight": "double", "overridden": "boolean", "promotion_blocked": "boolean", "reselection_trail": "string", **dict.fromkeys(WEIGHTS, "double"),
}
DEFAULT_WINDOW_DAYS = 365


def complete(items: DataFrame) -> DataFrame:
    """Items with every column that a report reads."""
    return items.withColumns({c: F.lit(None).cast(t) for c, t in ITEM.items() if c not in items.columns})


def yes(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def served_delta() -> Column:
    """How far what was served lies from the page that refers to it."""
    return distance_seconds(F.col("referring_timestamp"), F.col("served_ts"))


def distant(window_days: int) -> Column:
    """From another era: the capture that was chosen, or the one that a redirect led to."""
    return yes(F.col("temporally_distant")) | yes(served_delta() > window_days * DAY)


def is_asset() -> Column:
    return F.col("referring_timestamp").isNotNull()


def capture_source() -> Column:
    # Where an asset's capture came from.
    return F.when(F.col("requested_ts").isNull(), "none").when(yes(F.col("index_requests") > 0), "targeted-lookup").otherwise("inventory")


def recovered() -> Column:
    return yes((F.col("status") == "fetched") & F.col("body_hash").isNotNull() & F.col("validated"))


def totals(items: DataFrame, window_days: int = DEFAULT_WINDOW_DAYS) -> DataFrame:
    """One row: counts, assets and fidelity, each a struct of numbers."""
    n = lambda test, name: F.count_if(yes(test)).alias(name)
    is_ = lambda c, v: F.col(c) == v
    scored, ok = F.col("score").isNotNull(), is_("outcome", "ok")
    counts = (
        F.count(F.lit(1)).alias("items"), F.count(F.lit(1)).alias("indexed"), *[n(is_("status", s), s) for s in ("fetched", "failed", "unattempted", "skipped")],
        n(recovered(), "recoveredFiles"), n(ok, "referenceEligible"),
    )
    assets = (
        n(is_asset(), "assets"), F.coalesce(F.sum(F.when(is_asset(), F.col("index_requests"))), F.lit(0).cast("long")).alias("lookupIndexRequests"), n(is_asset() & (F.col("index_requests") > 0), "lookups"),
        n(is_asset() & (capture_source() == "inventory"), "resolvedFromInventory"), n(is_asset() & F.col("requested_ts").isNull(), "withoutCapture"), n(is_asset() & distant(window_days), "temporallyDistant"),
    )
    fidelity = (
        n(scored, "scored"), n(scored & is_("band", BANDS[0]), "accept"), n(scored & is_("band", BANDS[1]), "acceptWithWarning"), n(scored & is_("band", BANDS[2]), "reviewRequired"),
        n(scored & ok & ~yes(F.col("promotion_blocked")), "promotable"), n(scored & F.col("overridden"), "overridden"),
    )
    return complete(items).agg(F.struct(*counts).alias("counts"), F.struct(*assets).alias("assets"), F.struct(*fidelity).alias("fidelity"))


def total_rows(items: DataFrame, window_days: int = DEFAULT_WINDOW_DAYS) -> DataFrame:
    """The same totals, one row each: section, name, n."""
    one = totals(items, window_days)
    cells = [F.struct(F.lit(part.name).alias("section"), F.lit(f.name).alias("name"), F.col(part.name)[f.name].alias("n")) for part in one.schema for f in part.dataType]
    return one.select(F.inline(F.array(*cells)))


def indexed(items: DataFrame) -> DataFrame:
    return complete(items).select("original_url", "kind", "relation", "requested_ts", "archive_status", "from_excluded", F.col("referrer").alias("discovered_from"))


def fetched(items: DataFrame) -> DataFrame:
    return complete(items).where("status = 'fetched'").select(
        "original_url", local_path(F.col("original_url")).alias("local_path"), "http_status", "redirects", "requested_ts", "served_ts", "distance_seconds", replay_modifier(F.col("relation")).alias("replay_modifier"),
        F.col("requests").alias("attempts"), "bytes_read", "body_hash", "content_type", "truncated", "outcome", "outcome_source", "outcome_detail", "reselection_trail",
    )


def failed(items: DataFrame) -> DataFrame:
    return complete(items).where("status = 'failed'").select("original_url", F.col("failure.kind").alias("kind"), F.col("failure.message").alias("message"), F.col("failure.http_status").alias("http_status"), F.col("failure.retryable").alias("retryable"), F.col("requests").alias("attempts"), "outcome")


def unattempted(items: DataFrame) -> DataFrame:
    return complete(items).where("status = 'unattempted'").select("original_url", "kind", F.coalesce("unattempted_reason", F.lit("queued")).alias("reason"))


def recovered_files(items: DataFrame) -> DataFrame:
    """Validated bytes, content or not; the verdict of fidelity can only narrow what may serve as a reference."""
    return complete(items).where(recovered()).select("original_url", local_path(F.col("original_url")).alias("local_path"), "body_hash", "bytes_read", "content_type", "served_ts", "outcome", yes(F.col("outcome") == "ok").alias("reference_eligible"), "score", "band", "promotion_blocked", "overridden")


def asset_entries(items: DataFrame, window_days: int = DEFAULT_WINDOW_DAYS) -> DataFrame:
    """What each dependency was resolved to, and how far that lies from the page that refers to it: as chosen and as served."""
    return complete(items).where(is_asset()).select(
        "original_url", local_path(F.col("original_url")).alias("local_path"), F.col("referrer").alias("referring_page"), "referring_timestamp", F.col("requested_ts").alias("resolved_ts"), "served_ts", "delta_seconds",
        served_delta().alias("served_delta_seconds"), F.lit(window_days).alias("window_days"), distant(window_days).alias("temporally_distant"), capture_source().alias("source"), F.coalesce("considered", F.lit(0)).cast("long").alias("candidates"),
        "digests", "body_hash", "status", F.col("resolution_detail").alias("detail"),
    )


def lookups(items: DataFrame) -> DataFrame:
    return complete(items).where(is_asset() & (F.col("index_requests") > 0)).select("original_url", "index_requests", F.col("requested_ts").isNotNull().alias("found"), F.col("lookup_note").alias("note"))


def scored(items: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row for each signal of a scored page: its value, weight and contribution; what was not measured weighs nothing."""
    weights = weights or WEIGHTS
    signal = lambda i, name: F.struct(F.lit(i).alias("signal_ord"), F.lit(name).alias("signal"), F.col(f"`{name}`").alias("value"), F.when(F.col(f"`{name}`").isNotNull(), weights[name]).otherwise(0.0).alias("weight"), F.coalesce(rounded(F.col(f"`{name}`") * weights[name]), F.lit(0.0)).alias("contribution"))
    each = F.inline(F.array(*[signal(i, name) for i, name in enumerate(WEIGHTS)]))
    return complete(items).where("score is not null").select("original_url", "score", "band", "applied_weight", "weakest", "overridden", "promotion_blocked", each)


def timeline(captures: DataFrame) -> DataFrame:
    """Captures that a filter kept from being acquired: evidence of when a URL moved or died."""
    return captures.where("excluded_by is not null").select(F.col("capture_key").alias("original_url"), "timestamp", "status_code", "digest", "excluded_by")


def sections(tables: dict[str, DataFrame], window_days: int = DEFAULT_WINDOW_DAYS, weights: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """Every list of a report, by name."""
    items = tables["items"]
    return {
        "indexed": indexed(items), "fetched": fetched(items), "failed": failed(items), "unattempted": unattempted(items), "recovered_files": recovered_files(items), "assets": asset_entries(items, window_days),
        "lookups": lookups(items), "fidelity": scored(items, weights), "timeline": timeline(tables["captures"]), "gaps": tables["gaps"], "events": tables["events"],
    }
