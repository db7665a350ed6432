"""Outcomes of items: a closed set, decided in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relictum.functions.markup import FRAMESET, archive_error_marker, error_fingerprint, parked_marker, redirect_target, soft_404_marker
from relictum.functions.url import host_of

# Outcomes, and what each kind of failure comes to.
OUTCOMES = ("ok", "archive-interstitial", "origin-soft-404", "unverified-soft-404", "parked-domain", "meta-refresh-redirect", "frameset-only", "empty-body", "http-error", "not-archived", "rate-limited", "transport-error", "destination-refused", "redirect-unresolved", "content-type-mismatch", "oversized-body", "unattempted")
BY_FAILURE = {
    "destination-refused": "destination-refused",
    "transport-error": "transport-error",
    "provider-throttled": "rate-limited",
    "redirect-limit": "redirect-unresolved",
    "redirect-loop": "redirect-unresolved",
    "http-status": "http-error",
    "archive-error-page": "archive-interstitial",
    "content-type-mismatch": "content-type-mismatch",
    "empty-body": "empty-body",
    "oversized-body": "oversized-body",
}
RESELECTABLE = ("origin-soft-404", "archive-interstitial", "parked-domain", "meta-refresh-redirect", "frameset-only")


def failure_outcome(kind: Column, http_status: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in BY_FAILURE.items() for x in pair])
    return F.when((kind == "http-status") & http_status.isin(404, 410), "not-archived").otherwise(F.try_element_at(known, kind))


def error_templates(pages: DataFrame, *, url: str = "original_url", text: str = "text") -> DataFrame:
    """Pages that a host served with a 4xx status, by host and fingerprint, with the first URL that showed each."""
    seen = pages.where(F.col("archive_status").startswith("4")).select(host_of(F.col(url)).alias("host"), error_fingerprint(F.col(text)).alias("fingerprint"), F.col(url).alias("u"), "ord")
    found = seen.where("host is not null and fingerprint is not null").groupBy("host", "fingerprint").agg(F.min_by("u", "ord").alias("observed_from"))
    return found.withColumn("template_id", F.concat("host", F.lit(":"), F.substring("fingerprint", 1, 12)))


def declared_frames(frames: DataFrame, captured: DataFrame, *, key: str, url: str = "original_url") -> DataFrame:
    """For each page its frames, and how many of them the collection holds."""
    held = captured.select(F.col(url).alias("resolved_url"), F.lit(1).alias("held"))
    return frames.join(held, "resolved_url", "left").groupBy(key).agg(F.count(F.lit(1)).alias("frames"), F.count("held").alias("held_frames"))


def classify_text(pages: DataFrame, templates: DataFrame, frames: DataFrame, *, key: str, url: str = "original_url", text: str = "text") -> DataFrame:
    """`pages` with outcome, detail, matched_template and redirect_raw. `frames` comes from `declared_frames`."""
    t = F.col(text)
    looked = pages.withColumns({"__host": host_of(F.col(url)), "__print": error_fingerprint(t), "__redirect": redirect_target(t), "__marker": archive_error_marker(t), "__parked": parked_marker(t), "__missing": soft_404_marker(t)})
    by = templates.select(F.col("host").alias("__host"), F.col("fingerprint").alias("__print"), "template_id", "observed_from")
    met = looked.join(by, ["__host", "__print"], "left").join(frames, key, "left")
    no_frame = t.rlike(FRAMESET) & (F.coalesce("held_frames", F.lit(0)) == 0)
    # Outcomes in the order in which they are tried, with the details that reports give.
    ways = (
        (F.col("__marker").isNotNull(), "archive-interstitial", F.concat(F.lit('provider marker "'), F.col("__marker"), F.lit('"'))),
        (F.col("template_id").isNotNull(), "origin-soft-404", F.concat(F.lit("matches the error template observed at "), F.col("observed_from"))),
        (F.col("__parked").isNotNull(), "parked-domain", F.concat(F.lit('holding-page marker "'), F.col("__parked"), F.lit('"'))),
        (F.col("__redirect").isNotNull(), "meta-refresh-redirect", F.concat(F.col("__redirect.mechanism"), F.lit(" to "), F.col("__redirect.raw"))),
        (no_frame, "frameset-only", F.when(F.coalesce("frames", F.lit(0)) == 0, "frameset declares no frames").otherwise(F.concat(F.lit("none of the "), F.col("frames").cast("string"), F.lit(" declared frames hold validated bytes")))),
        (F.col("__missing").isNotNull(), "unverified-soft-404", F.concat(F.lit('not-found marker "'), F.col("__missing"), F.lit('" with no observed error template for this host'))),
    )
    outcome, detail = F, F
    for test, name, said in ways:
        outcome, detail = outcome.when(test, F.lit(name)), detail.when(test, said)
    out = met.withColumns({
        "outcome": F.when(t.isNull(), "ok").otherwise(outcome.otherwise("ok")),
        "detail": F.when(t.isNull(), "validated bytes, not markup").otherwise(detail.otherwise("validated markup with no non-content marker")),
    })
    out = out.withColumns({"matched_template": F.when(F.col("outcome") == "origin-soft-404", F.col("template_id")), "redirect_raw": F.when(F.col("outcome") == "meta-refresh-redirect", F.col("__redirect.raw"))})
    return out.drop("__host", "__print", "__redirect", "__marker", "__parked", "__missing", "template_id", "observed_from", "frames", "held_frames")


def classify_items(items: DataFrame, text_outcome: Column, text_detail: Column) -> DataFrame:
    """Outcome, source and detail of every item: what happened before the text comes before the text."""
    kind, status = F.col("failure.kind"), F.col("failure.http_status")
    outcome = F.when(F.col("status") == "unattempted", "unattempted").when(F.col("status") == "skipped", "not-archived").when(kind.isNotNull(), failure_outcome(kind, status)).when(~F.coalesce("validated", F.lit(False)), "http-error").otherwise(text_outcome)
    source = F.when(F.col("status") == "unattempted", "unattempted").when(F.col("status") == "skipped", "no-capture").when(kind.isNotNull() | ~F.coalesce("validated", F.lit(False)), "failure").otherwise("content")
    detail = F.when(F.col("status") == "unattempted", F.concat(F.lit("no request was made: "), F.coalesce("unattempted_reason", F.lit("queued")))).when(F.col("status") == "skipped", "no capture is known for this URL").when(kind.isNotNull(), F.concat(kind, F.lit(": "), F.col("failure.message"))).when(~F.coalesce("validated", F.lit(False)), "bytes arrived but did not pass validation").otherwise(text_detail)
    return items.withColumns({"outcome": outcome, "outcome_source": source, "outcome_detail": detail, "reference_eligible": outcome == "ok"})


def outcome_counts(items: DataFrame, column: str = "outcome") -> DataFrame:
    """One row for each outcome of the closed set, counts of zero included."""
    every = items.sparkSession.createDataFrame([(o, i) for i, o in enumerate(OUTCOMES)], "outcome string, ord int")
    counts = items.groupBy(F.col(column).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))
