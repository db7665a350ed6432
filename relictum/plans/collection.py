"""A collection classified and scored from what is stored, without a request."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relictum.functions.encoding import decoded
from relictum.functions.injection import strip_injection
from relictum.functions.markup import has_injection, validation_failure
from relictum.functions.url import capture_key
from relictum.operators import fidelity, links, outcomes

Cut = Callable[[DataFrame, str], DataFrame]


def decode_bodies(items: DataFrame, bodies: DataFrame) -> DataFrame:
    """Items with the decision on their body. A content is decoded once for each content type that goes with it."""
    pairs = items.select("body_hash", "content_type").where("body_hash is not null").distinct()
    read = pairs.join(bodies.select(F.col("hash").alias("body_hash"), "bytes"), "body_hash").withColumn("decoded", decoded(F.col("bytes"), F.col("content_type"))).select("body_hash", "content_type", F.octet_length("bytes").alias("byte_length"), "decoded")
    met = items.join(read, items["body_hash"].eqNullSafe(read["body_hash"]) & items["content_type"].eqNullSafe(read["content_type"]), "left").drop(read["body_hash"]).drop(read["content_type"])
    text = F.col("decoded.text")
    stripped = strip_injection(F.when(has_injection(text), text))
    return met.withColumn("stripped", stripped).withColumns({"text": F.coalesce("stripped.text", "decoded.text"), "removed_nodes": F.coalesce("stripped.removed_nodes", F.lit(0)), "removal_rules": F.array_join("stripped.rules", ", ")}).drop("stripped")


def validated(items: DataFrame) -> DataFrame:
    """Adds the failure of a body, if any, and whether it passed."""
    check = validation_failure(F.col("decoded.text"), F.col("relation"), F.col("content_type"), F.coalesce("byte_length", F.lit(0)), F.coalesce("truncated", F.lit(False)), F.col("decoded.binary_reason"))
    found = F.when(F.col("failure").isNotNull() | (F.col("status") != "fetched"), F.col("failure")).otherwise(F.when(check.isNotNull(), F.struct(check["kind"].alias("kind"), check["message"].alias("message"), F.lit(None).cast("int").alias("http_status"), F.lit(False).alias("retryable"))))
    return items.withColumn("failure", found).withColumn("validated", (F.col("status") == "fetched") & found.isNull())


def item_outcomes(items: DataFrame, cut: Cut) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items with their outcomes, the links of their pages, and the URLs of which a body is held."""
    items = cut(items, "items")  # read for what is held, for links, templates and classes
    held = cut(items.where("validated").select("original_url").distinct(), "held")
    found = cut(links.discover_links(items.where(F.col("text").isNotNull()), key="item_id", url="original_url", text="text"), "links")
    frames = outcomes.declared_frames(found.where(F.col("relation") == "frame"), held, key="item_id")
    looked = outcomes.classify_text(items, outcomes.error_templates(items.where(F.col("text").isNotNull())), frames, key="item_id")
    looked = looked.withColumnsRenamed({"outcome": "__text_outcome", "detail": "__text_detail"})
    classed = outcomes.classify_items(looked, F.col("__text_outcome"), F.col("__text_detail")).drop("__text_outcome", "__text_detail")
    return cut(classed, "classified"), found, held


def override_table(spark: SparkSession, declared: Sequence[Sequence[str]]) -> DataFrame | None:
    """A project's overrides (URL, reason, who recorded it) by normalised URL; None if there are none."""
    if not declared:
        return None
    given = spark.createDataFrame([tuple(o) for o in declared], "url string, reason string, recorded_by string")
    return given.select(capture_key(F.col("url")).alias("original_url"), "reason", "recorded_by")


def classify_collection(items: DataFrame, assets: DataFrame, captures: DataFrame, cut: Cut, *, overrides: DataFrame | None = None, thresholds: tuple[float, float] = (fidelity.ACCEPT, fidelity.ACCEPT_WITH_WARNING)) -> DataFrame:
    """Outcome and fidelity of every item. `items` has item_id, ord, original_url, relation, status, unattempted_reason,
    failure, validated, archive_status, text, replacement_ratio and requested_ts; `assets` has page_url, resolved, acquired
    and distant; `captures` has capture_key, timestamp, digest and ord. `cut` writes a table and reads it back."""
    classed, found, held = item_outcomes(items, cut)
    segs = cut(fidelity.page_segments(classed.where("text is not null"), key="item_id", text="text"), "segments")
    pages = classed.where((F.col("outcome") == "ok") & F.col("relation").isin("page", "frame") & F.col("text").isNotNull())
    from relictum.operators.captures import cross_capture

    history = captures.withColumnRenamed("capture_key", "original_url")
    agreed = cross_capture(history, pages.select("original_url", F.col("requested_ts").alias("chosen_timestamp")).dropDuplicates(["original_url"]), "original_url")
    first_referrer = assets.select(F.col("page_url").alias("original_url"), "resolved", "acquired", "distant")
    signals = (
        pages.select("item_id", "original_url", fidelity.encoding_signal(F.coalesce("replacement_ratio", F.lit(0.0))).alias("encoding"))
        .join(fidelity.structure(pages, segs, found, held, key="item_id", text="text").select("item_id", "structure"), "item_id")
        .join(fidelity.boilerplate(segs, fidelity.segment_frequency(segs, "item_id"), key="item_id").select("item_id", "boilerplate"), "item_id", "left")
        .join(fidelity.asset_signal(first_referrer, "original_url").select("original_url", "assets"), "original_url", "left")
        .join(agreed.select("original_url", fidelity.cross_capture_signal(F.col("state")).alias("cross-capture")), "original_url", "left")
        .withColumn("boilerplate", F.coalesce("boilerplate", F.lit(0.0)))
    )
    scores = fidelity.composite(signals, overrides, thresholds=thresholds)
    return classed.join(scores.drop("original_url", "override_reason"), "item_id", "left")
