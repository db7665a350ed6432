"""Evidence: what was counted, what is missing, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relictum.functions.time import DAY

ERA_DISTANCE = 365 * DAY
# Kinds of gaps in the order in which an item raises them.
GAP_KINDS = ("temporally-distant-asset", "asset-content-drift", "archive-injection", "low-fidelity", "non-content-body", "failed-fetch", "excluded-capture-only", "unattempted", "no-capture", "degraded-encoding", "truncated-body", "capture-era-distance", "partial-inventory")

# What a report advises for each kind of gap.
REMEDY = {
    "temporally-distant-asset": "accept the era difference explicitly, or narrow the window and record the asset as unavailable",
    "asset-content-drift": "confirm the chosen capture is the content the referring page showed",
    "archive-injection": "confirm the replay modifier reached the provider; the stored bytes are not raw capture bytes",
    "low-fidelity": "select an alternative capture, or record an explicit override before freezing this as a reference",
    "low-fidelity, overridden": "the override is recorded; confirm it still holds before freezing this as a reference",
    "non-content-body": "select an alternative capture; this body must not become a reference",
    "failed-fetch": "select an alternative capture or record the item as unavailable",
    "failed-fetch, retryable": "resume the job with retry enabled, or select an alternative capture",
    "excluded-capture-only": "widen the inventory period to look for a capture the origin answered normally",
    "unattempted": "resume the job",
    "unattempted, budget": "raise the declared budget and resume",
    "no-capture": "widen the inventory period or supply the file from another source",
    "degraded-encoding": "review the chosen encoding before this body is used as a reference",
    "truncated-body": "raise maxResponseBytes and re-acquire this item",
    "capture-era-distance": "choose a capture inside the declared period before freezing a reference",
}

#: Column of the wide item table -> its type. A table may lack any of them; what it lacks is null.
ITEM = {
    "original_url": "string", "status": "string", "unattempted_reason": "string", "failure_kind": "string", "failure_message": "string", "retryable": "boolean",
    "outcome": "string", "outcome_detail": "string", "validated": "boolean", "body_hash": "string", "reselection_trail": "string",
    "distant": "boolean", "distance_text": "string", "digests": "long", "resolution_detail": "string",
    "removed_nodes": "int", "removal_rules": "string", "score": "double", "band": "string", "weakest": "string", "overridden": "boolean",
    "from_excluded": "boolean", "requested_ts": "string", "served_ts": "string", "archive_status": "string",
    "replacement_ratio": "double", "degraded": "boolean", "encoding": "string", "truncated": "boolean", "bytes_read": "long", "distance_seconds": "long",
}


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("unknown")) for p in parts])


def gaps(items: DataFrame) -> DataFrame:
    """kind, original_url, detail and remedy of everything an item table shows to be missing, in one pass: an item makes an
    array of its gaps, which is then unfolded."""
    have = set(items.columns)
    c = {n: F.col(n) if n in have else F.lit(None).cast(t) for n, t in ITEM.items()}
    yes = lambda x: F.coalesce(x, F.lit(False))
    complete = (c["status"] == "fetched") & c["body_hash"].isNotNull() & yes(c["validated"])
    trail = F.when(c["reselection_trail"].isNotNull(), text("; captures tried: ", c["reselection_trail"])).otherwise("")
    budget = c["unattempted_reason"] == "budget-exhausted"
    # The sentences of a report.
    found = (
        (yes(c["distant"]), text("acquired from ", F.coalesce(c["served_ts"], c["requested_ts"]), ", ", c["distance_text"], " from the referring page"), F.lit(REMEDY["temporally-distant-asset"])),
        (yes(c["digests"] > 1), text("this URL served ", c["digests"], " distinct content hashes; ", c["resolution_detail"]), F.lit(REMEDY["asset-content-drift"])),
        (yes(c["removed_nodes"] > 0), text("the defensive strip removed ", c["removed_nodes"], " archive-injected node(s) (", c["removal_rules"], ")"), F.lit(REMEDY["archive-injection"])),
        (yes(c["band"] == "review-required"), text("fidelity ", F.format_string("%.4f", c["score"]), " needs review; weakest signal ", c["weakest"]), F.when(yes(c["overridden"]), REMEDY["low-fidelity, overridden"]).otherwise(REMEDY["low-fidelity"])),
        (yes(complete & F.coalesce(c["outcome"] != "ok", F.lit(True))), F.concat(text(F.coalesce(c["outcome"], F.lit("unclassified")), ": ", F.coalesce(c["outcome_detail"], F.lit("no classification pass has run"))), trail), F.lit(REMEDY["non-content-body"])),
        (yes((c["status"] == "failed") & c["failure_kind"].isNotNull()), text(c["failure_kind"], ": ", c["failure_message"]), F.when(yes(c["retryable"]), REMEDY["failed-fetch, retryable"]).otherwise(REMEDY["failed-fetch"])),
        (yes(c["from_excluded"]), text("every indexed capture failed the candidate filter; acquired ", c["requested_ts"], " with archive status ", c["archive_status"]), F.lit(REMEDY["excluded-capture-only"])),
        (yes(c["status"] == "unattempted"), text("no request was made: ", F.coalesce(c["unattempted_reason"], F.lit("queued"))), F.when(yes(budget), REMEDY["unattempted, budget"]).otherwise(REMEDY["unattempted"])),
        (yes(c["status"] == "skipped"), F.lit("no capture is known for this URL"), F.lit(REMEDY["no-capture"])),
        (yes(c["degraded"]), text("replacement ratio ", F.format_string("%.4f", c["replacement_ratio"]), " exceeds 0.01 under ", c["encoding"]), F.lit(REMEDY["degraded-encoding"])),
        (yes(c["truncated"]), text("body hit the response byte cap at ", c["bytes_read"], " bytes"), F.lit(REMEDY["truncated-body"])),
        (yes(c["distance_seconds"] > ERA_DISTANCE), text("served capture ", c["served_ts"], " is ", c["distance_seconds"], "s from the requested ", c["requested_ts"]), F.lit(REMEDY["capture-era-distance"])),
    )
    rows = F.array(*[F.when(test, F.struct(F.lit(kind).alias("kind"), detail.alias("detail"), remedy.alias("remedy"))) for kind, (test, detail, remedy) in zip(GAP_KINDS[:-1], found, strict=True)])
    return items.select(c["original_url"].alias("original_url"), F.explode(F.filter(rows, lambda g: g.isNotNull())).alias("g")).select("g.kind", "original_url", "g.detail", "g.remedy")


def inventory_reasons(runs: DataFrame) -> DataFrame:
    """Why an inventory may be partial: one row for each run and reason. Needs run_id, continued, failed and limit_reached."""
    # Likewise.
    reasons = F.array(
        F.when(F.col("continued"), F.lit("the provider offered more rows than were read")),
        F.when(F.col("failed"), F.lit("an index request failed")),
        F.when(F.col("limit_reached"), F.lit("a page of rows was filled to its limit")),
    )
    return runs.select("run_id", F.explode(F.filter(reasons, lambda r: r.isNotNull())).alias("reason"))


def inventory_gaps(runs: DataFrame, url: str) -> DataFrame:
    """Gaps of the inventory itself, under the URL that it was asked for."""
    remedy = "raise the index budget or page limit and resume; a URL that the inventory lacks may still be archived"
    return inventory_reasons(runs).select(F.lit(GAP_KINDS[-1]).alias("kind"), F.lit(url).alias("original_url"), F.col("reason").alias("detail"), F.lit(remedy).alias("remedy"))


def evidence_counts(items: DataFrame) -> DataFrame:
    """The report's totals, in one pass."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    return items.agg(
        F.count(F.lit(1)).alias("items"), is_("status", "fetched").alias("fetched"), is_("status", "failed").alias("failed"), is_("status", "unattempted").alias("unattempted"), is_("status", "skipped").alias("skipped"),
        F.count_if(F.col("outcome") == "ok").alias("eligible"), F.count_if((F.col("outcome") == "ok") & ~F.coalesce(F.col("promotion_blocked"), F.lit(False))).alias("promotable"),
    )
