"""Fidelity of pages: five signals, each between 0 and 1 or unmeasured, weighed into an explainable score."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relictum.functions.markup import segments, title_text
from relictum.functions.url import sha256

# Weights, thresholds, tuning and the credit of an asset.
WEIGHTS = {"structure": 0.3, "boilerplate": 0.25, "encoding": 0.25, "assets": 0.15, "cross-capture": 0.1}
ACCEPT, ACCEPT_WITH_WARNING = 0.85, 0.7
BANDS = ("accept", "accept-with-warning", "review-required")
CREDIT = {"acquired": 1.0, "distant": 0.6, "resolved": 0.25, "unresolved": 0.0}


@dataclass(frozen=True)
class Tuning:
    encoding_zero: float = 0.05
    body_target: int = 400
    least_documents: int = 2
    unique_zero: float = 0.1
    unique_full: float = 0.5
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))


def rounded(x: Column) -> Column:
    """Four decimals, halves upward."""
    return F.floor(x * 10000 + 0.5) / 10000


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def scaled(x: Column, zero: float, one: float) -> Column:
    return clamp((x - zero) / (one - zero)) if one > zero else F.when(x > zero, 1.0).otherwise(0.0)


def band(score: Column, accept: float = ACCEPT, warn: float = ACCEPT_WITH_WARNING) -> Column:
    return F.when(score >= accept, BANDS[0]).when(score >= warn, BANDS[1]).otherwise(BANDS[2])


def page_segments(pages: DataFrame, *, key: str = "page_id", text: str = "html") -> DataFrame:
    """Visible blocks, one row each, repeats included: key, seg_ord, segment."""
    return pages.select(key, F.posexplode(segments(F.col(text))).alias("seg_ord", "segment"))


def segment_frequency(segs: DataFrame, key: str = "page_id") -> DataFrame:
    """On how many pages each block stands; by hash, so no long text is a key."""
    once = segs.select(key, sha256(F.col("segment")).alias("seg_hash")).distinct()
    return once.groupBy("seg_hash").agg(F.count(F.lit(1)).alias("df"))


def boilerplate(segs: DataFrame, frequency: DataFrame, tuning: Tuning = Tuning(), key: str = "page_id") -> DataFrame:
    """How much of a page's visible text is its own. Blocks are counted within pages first, so a block on every page meets
    its frequency once a page."""
    own = segs.groupBy(key, sha256(F.col("segment")).alias("seg_hash")).agg(F.sum(F.length("segment")).alias("chars"))
    common = frequency.where(F.col("df") >= tuning.least_documents)
    joined = own.join(common, "seg_hash", "left")
    out = joined.groupBy(key).agg(F.sum("chars").alias("total_chars"), F.sum(F.when(F.col("df").isNotNull(), F.col("chars")).otherwise(0)).alias("shared_chars"))
    ratio = F.when(F.col("total_chars") == 0, 0.0).otherwise((F.col("total_chars") - F.col("shared_chars")) / F.col("total_chars"))
    return out.withColumn("boilerplate", rounded(scaled(ratio, tuning.unique_zero, tuning.unique_full)))


def structure(pages: DataFrame, segs: DataFrame, links: DataFrame, captured: DataFrame, tuning: Tuning = Tuning(), *, key: str = "page_id", url: str = "original_url", text: str = "html") -> DataFrame:
    """Title, amount of text, and whether a link leads to another page that is held; the last counts only where the
    collection holds more than one URL. `captured` has one row for each URL."""
    chars = segs.groupBy(key).agg(F.sum(F.length("segment")).alias("body_chars"))
    held = captured.select(F.col(url).alias("resolved_url"), F.lit(1).alias("held"))
    own = links.where(F.col("relation") == "link").join(pages.select(key, url), key).join(held, "resolved_url", "left")
    found = own.groupBy(key).agg(F.count(F.lit(1)).alias("declared_links"), F.count_if(F.col("held").isNotNull() & (F.col("resolved_url") != F.col(url))).alias("resolving_links"))
    many = captured.limit(2).count() > 1
    rows = pages.select(key, (F.coalesce(F.length(title_text(F.col(text))), F.lit(0)) > 0).alias("has_title")).join(chars, key, "left").join(found, key, "left")
    rows = rows.select(key, "has_title", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("body_chars", "declared_links", "resolving_links")])
    parts = F.col("has_title").cast("int") + clamp(F.col("body_chars") / tuning.body_target)
    value = (parts + (F.col("resolving_links") > 0).cast("int")) / 3 if many else parts / 2
    return rows.withColumn("structure", rounded(value))


def encoding_signal(ratio: Column, tuning: Tuning = Tuning()) -> Column:
    zero = tuning.encoding_zero
    value = clamp(1 - ratio / zero) if zero > 0 else F.when(ratio > 0, 0.0).otherwise(1.0)
    return rounded(value)


def asset_credit(resolved: Column, acquired: Column, distant: Column) -> Column:
    return F.when(~resolved, CREDIT["unresolved"]).when(~acquired, CREDIT["resolved"]).when(distant, CREDIT["distant"]).otherwise(CREDIT["acquired"])


def asset_signal(assets: DataFrame, key: str = "page_id") -> DataFrame:
    """Mean credit of a page's assets; a page without any has no row, and so no value."""
    credit = asset_credit(F.col("resolved"), F.col("acquired"), F.col("distant"))
    return assets.groupBy(key).agg(rounded(F.avg(credit)).alias("assets"), F.count(F.lit(1)).alias("n_assets"))


def cross_capture_signal(state: Column) -> Column:
    return F.when(state == "identical", 1.0)


def composite(signals: DataFrame, overrides: DataFrame | None = None, tuning: Tuning = Tuning(), *, url: str = "original_url", thresholds: tuple[float, float] = (ACCEPT, ACCEPT_WITH_WARNING)) -> DataFrame:
    """The weighted mean over measured signals, its band, and whether promotion is blocked. The band is that of the score
    before rounding. `overrides` has url, reason and recorded_by."""
    names = list(WEIGHTS)
    values = {n: F.col(f"`{n}`") for n in names}
    total = sum((F.when(values[n].isNotNull(), tuning.weights[n]).otherwise(0.0) for n in names), F.lit(0.0))
    gained = sum((F.when(values[n].isNotNull(), rounded(values[n] * tuning.weights[n])).otherwise(0.0) for n in names), F.lit(0.0))
    raw = F.when(total == 0, 0.0).otherwise(gained / total)
    weakest = F.array_min(F.filter(F.array(*[F.when(values[n].isNotNull(), F.struct(values[n].alias("value"), F.lit(i).alias("i"), F.lit(n).alias("name"))) for i, n in enumerate(names)]), lambda s: s.isNotNull()))
    out = signals.withColumns({"__raw": raw, "applied_weight": rounded(total), "weakest": weakest["name"]}).withColumns({"score": rounded(F.col("__raw")), "band": band(F.col("__raw"), *thresholds)}).drop("__raw")
    review = F.col("band") == BANDS[2]
    if overrides is None:
        return out.withColumns({"overridden": F.lit(False), "promotion_blocked": review})
    once = overrides.groupBy(url).agg(F.min("reason").alias("override_reason"))
    return out.join(once, url, "left").withColumns({"overridden": review & F.col("override_reason").isNotNull(), "promotion_blocked": review & F.col("override_reason").isNull()})
