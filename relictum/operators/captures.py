"""Captures of URLs: candidate filters, selection by policy, history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relictum.functions.time import DAY, epoch_seconds, expand_timestamp, is_usable, start_epoch

# Fields of an index row, the default filter, policies and page types.
FIELDS = ("urlkey", "timestamp", "original", "mimetype", "statuscode", "digest", "length")
DEFAULT_FILTERS = ("statuscode:200",)
SPAN = 30 * DAY
#: Captures of a key that each of its dependencies may look through.
MOST_LISTED = 256
NEAREST, EARLIEST_LARGEST = "nearest", "earliest-largest"
PAGE_TYPES = r"(?i)^(?:text/html|application/xhtml\+xml|text/plain)\b"


@dataclass(frozen=True)
class CandidateFilter:
    """`[!]field:pattern`; the pattern must match the whole field."""

    field: str
    pattern: str
    negated: bool
    source: str

    @classmethod
    def parse(cls, expression: str) -> CandidateFilter:
        field, colon, pattern = expression.removeprefix("!").partition(":")
        if not colon or not field:
            raise ValueError(f"candidate filter {expression} is not field:pattern")
        if field.lower() not in FIELDS:
            raise ValueError(f"candidate filter {expression} names an unknown field")
        return cls(field.lower(), pattern, expression.startswith("!"), expression)

    def passes(self) -> Column:
        matched = F.coalesce(F.col(self.field), F.lit("")).rlike(rf"\A(?:{self.pattern})\z")
        return ~matched if self.negated else matched


def tag_exclusions(rows: DataFrame, filters: tuple[str, ...] = DEFAULT_FILTERS) -> DataFrame:
    """Adds excluded_by: the first filter that a row fails, else null. Rows are told apart, never dropped."""
    checks = [CandidateFilter.parse(f) for f in filters]
    return rows.withColumn("excluded_by", F.coalesce(*[F.when(~c.passes(), F.lit(c.source)) for c in checks], F.lit(None).cast("string")))


def as_candidates(rows: DataFrame) -> DataFrame:
    """Index rows as typed captures; blank fields are null, and a length is the number that its text begins with."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.where((F.coalesce(F.col("original"), F.lit("")) != "") & (F.coalesce(F.col("timestamp"), F.lit("")) != "")).withColumns({"digest": blank("digest"), "status_code": blank("statuscode"), "mimetype": blank("mimetype"), "length": F.regexp_extract("length", r"^\s*([+-]?\d+)", 1).try_cast("long")}).drop("statuscode")


def seeds_a_page(mimetype: Column) -> Column:
    return F.coalesce(mimetype.isin("", "-"), F.lit(True)) | F.coalesce(mimetype.rlike(PAGE_TYPES), F.lit(False))


def rank(target: Column | None) -> Column:
    """Order by nearness to the target: then the larger, the later and the first seen. Without a target: the latest."""
    if target is None:
        return F.struct(F.col("timestamp").alias("a"), (-F.col("ord")).alias("b"))
    away = F.abs(F.col("__at") - epoch_seconds(target))
    known = away.isNotNull()
    near = F.struct(known.cast("int").alias("known"), F.coalesce(-away, F.lit(0)).alias("near"), F.when(known, F.coalesce(F.col("length"), F.lit(-1))).otherwise(0).alias("size"), F.when(known, F.col("timestamp")).otherwise("").alias("late"), (-F.col("ord")).alias("first"))
    last = F.struct(F.lit(0).alias("known"), F.lit(0).cast("long").alias("near"), F.lit(0).cast("long").alias("size"), F.col("timestamp").alias("late"), (-F.col("ord")).alias("first"))
    return F.when(epoch_seconds(target).isNotNull(), near).otherwise(last)


def select_captures(captures: DataFrame, key: str = "capture_key", *, policy: str = NEAREST, target: Column | None = None, cluster_days: int = 90) -> DataFrame:
    """One chosen capture for each key, by partial aggregates alone. Excluded captures count only where a key has no other,
    and then the choice says so. Needs timestamp, length, ord and excluded_by."""
    usable = captures.where(is_usable(F.col("timestamp")))
    columns = [c for c in captures.columns if c != key]
    eligible = F.col("excluded_by").isNull()
    if policy == EARLIEST_LARGEST:
        pools = usable.groupBy(key).agg(F.max(eligible).alias("has_eligible"), F.min(F.when(eligible, F.col("timestamp"))).alias("first_eligible"), F.min("timestamp").alias("first_any"))
        pools = pools.select(key, "has_eligible", F.coalesce("first_eligible", "first_any").alias("earliest"))
        pooled = usable.join(pools, key).where(eligible | ~F.col("has_eligible"))
        inside = F.coalesce(start_epoch(F.col("timestamp")) - start_epoch(F.col("earliest")) <= cluster_days * DAY, F.col("timestamp") == F.col("earliest"))
        best = F.struct(F.coalesce(-F.col("length"), F.lit(1)).alias("a"), F.col("timestamp").alias("b"), F.col("ord").alias("c"))
        chosen = pooled.groupBy(key).agg(F.min_by(F.struct(*columns), F.when(inside, best)).alias("chosen"), F.count(F.lit(1)).alias("considered"), (~F.max("has_eligible")).alias("from_excluded"))
        return chosen.select(key, *[F.col("chosen")[c].alias(c) for c in columns], "considered", "from_excluded")
    ranked = usable.withColumn("__at", start_epoch(F.col("timestamp")) if target is not None else F.lit(0))
    order = F.struct(eligible.alias("eligible"), rank(target).alias("rank"))  # any eligible capture comes before all others
    best = ranked.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("chosen"), F.count_if(eligible).alias("n_good"), F.count(F.lit(1)).alias("n_any"))
    considered = F.when(F.col("n_good") > 0, F.col("n_good")).otherwise(F.col("n_any"))
    return best.select(key, *[F.col("chosen")[c].alias(c) for c in columns], considered.alias("considered"), (F.col("n_good") == 0).alias("from_excluded"))


def unused_captures(captures: DataFrame, used: DataFrame, key: str = "capture_key") -> DataFrame:
    """Captures whose timestamp a key has not used."""
    return captures.join(used.select(key, "timestamp"), [key, "timestamp"], "left_anti")


def first_of_timestamp(captures: DataFrame, key: str = "capture_key") -> DataFrame:
    """One capture for each key and timestamp, the first seen."""
    best = captures.groupBy(key, "timestamp").agg(F.min_by(F.struct(*captures.columns), "ord").alias("r"))
    return best.select("r.*")


def collapse_adjacent(captures: DataFrame, key: str = "capture_key") -> DataFrame:
    """Without captures whose digest is that of the one before. A key's history is sorted month by month, and each month gets
    the last digest of the month before it."""
    month = F.substring("timestamp", 1, 6)
    w = Window.partitionBy(key, "__month").orderBy("timestamp", "ord")
    last = captures.groupBy(key, month.alias("__month")).agg(F.max_by(F.struct("digest"), F.struct("timestamp", "ord")).alias("d"))
    ahead = last.select(key, "__month", F.lag("d").over(Window.partitionBy(key).orderBy("__month")).alias("__ahead"))
    met = captures.withColumn("__month", month).join(ahead, [key, "__month"])
    met = met.withColumn("__before", F.coalesce(F.lag(F.struct("digest")).over(w), "__ahead"))
    return met.where(F.col("__before.digest").isNull() | ~F.col("digest").eqNullSafe(F.col("__before.digest"))).drop("__before", "__month", "__ahead")


def distinct_digests(captures: DataFrame, key: str = "capture_key") -> DataFrame:
    """Each capture with a digest once: key, digest, first_seen (the place of the digest among those of its key), ord and
    timestamp. Lists of timestamps are left to reports, since a digest may have very many."""
    seen = captures.where(F.nullif(F.col("digest"), F.lit("")).isNotNull()).select(key, "digest", "ord", "timestamp")
    first = seen.groupBy(key, "digest").agg(F.min("ord").alias("first_seen"))
    return seen.join(first, [key, "digest"]).select(key, "digest", "first_seen", "ord", "timestamp")


def content_drift(captures: DataFrame, key: str = "capture_key") -> DataFrame:
    digests = F.count_distinct(F.nullif(F.col("digest"), F.lit("")))
    return captures.groupBy(key).agg(digests.alias("digests")).where("digests > 1")


def cross_capture(captures: DataFrame, chosen: DataFrame, key: str = "capture_key") -> DataFrame:
    """How the chosen capture's digest compares with that of the capture nearest to it. `chosen` has key and
    chosen_timestamp; where that is no known capture, the first one stands in, and the flag says so."""
    known = captures.where(is_usable(F.col("timestamp"))).select(key, "timestamp", "digest", "ord", start_epoch(F.col("timestamp")).alias("at"))
    marked = known.join(chosen.select(key, "chosen_timestamp"), key)
    fields = F.struct("timestamp", "digest", "ord", "at")
    hit = F.col("timestamp") == F.col("chosen_timestamp")
    base = marked.groupBy(key).agg(F.min_by(fields, F.when(hit, F.col("ord"))).alias("hit"), F.min_by(fields, "ord").alias("first"), F.count(F.lit(1)).alias("capture_count"))
    base = base.select(key, "capture_count", F.coalesce("hit", "first").alias("c"), F.col("hit").isNull().alias("stand_in"))
    away = F.abs(F.col("at") - F.col("c.at"))
    others = known.join(base, key).where(F.col("ord") != F.col("c.ord"))
    near = others.groupBy(key).agg(F.min_by(F.struct("timestamp", "digest", away.alias("away")), F.struct(away.isNull().alias("a"), away.alias("b"), F.col("ord").alias("c"))).alias("n"))
    own, other = F.nullif(F.col("c.digest"), F.lit("")), F.nullif(F.col("n.digest"), F.lit(""))
    state = F.when(F.col("n").isNull(), "single-capture").when(own.isNull() | other.isNull(), "digest-unavailable").when(own == other, "identical").otherwise("different")
    return base.join(near, key, "left").select(key, "capture_count", state.alias("state"), F.col("n.timestamp").alias("compared_timestamp"), F.col("n.away").alias("distance_seconds"), "stand_in")


def resolve_assets(dependencies: DataFrame, captures: DataFrame, *, window_days: int = 365, key: str = "capture_key", most: int = MOST_LISTED) -> DataFrame:
    """Each dependency with the capture nearest in time to the page that refers to it. The captures of a key, if there are at most
    `most`, are a list that its dependencies meet in one join; keys with more are sorted with theirs. Needs dep_id, key and
    referring_timestamp; dependencies without any capture stay, unresolved."""
    usable = captures.where(is_usable(F.col("timestamp")))
    many = usable.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(key)
    if many.isEmpty():
        return resolve_listed(dependencies, usable, window_days=window_days, key=key)
    few = resolve_listed(dependencies.join(many, key, "left_anti"), usable.join(many, key, "left_anti"), window_days=window_days, key=key)
    return few.unionByName(resolve_sorted(dependencies.join(many, key, "left_semi"), usable.join(many, key, "left_semi"), window_days=window_days, key=key))


def resolve_listed(dependencies: DataFrame, captures: DataFrame, *, window_days: int, key: str) -> DataFrame:
    """`resolve_assets` where a key has few captures: each dependency looks through all of them."""
    good = F.col("excluded_by").isNull()
    known = captures.select(key, good.alias("good"), F.struct(F.col("timestamp"), (-F.col("ord")).alias("first"), start_epoch(F.col("timestamp")).alias("at"), F.coalesce(F.col("length"), F.lit(-1)).alias("size")).alias("c"))
    lists = known.groupBy(key).agg(F.collect_list(F.when(F.col("good"), F.col("c"))).alias("good"), F.collect_list(F.when(~F.col("good"), F.col("c"))).alias("rest"))
    lists = lists.select(key, F.when(F.size("good") > 0, F.col("good")).otherwise(F.col("rest")).alias("pool"))
    at = epoch_seconds(expand_timestamp(F.col("referring_timestamp"), "start"))
    asked = dependencies.select("dep_id", key, "referring_timestamp", at.alias("__at"))
    met = asked.join(lists, key, "left")
    near = F.array_max(F.transform(F.filter("pool", lambda c: c["at"].isNotNull()), lambda c: F.struct((-F.abs(F.col("__at") - c["at"])).alias("near"), c["size"].alias("size"), c["timestamp"].alias("timestamp"), c["first"].alias("first"))))
    late = F.array_max("pool")["timestamp"]
    first = F.array_max(F.transform("pool", lambda c: F.struct(c["first"].alias("first"), c["timestamp"].alias("timestamp"))))["timestamp"]
    chosen = met.withColumn("__near", F.when(F.col("__at").isNotNull(), near))
    delta = -F.col("__near.near")
    return chosen.select(
        "dep_id", key, "referring_timestamp", F.when(F.col("__at").isNull(), late).otherwise(F.coalesce("__near.timestamp", first)).alias("resolved_timestamp"), delta.alias("delta_seconds"),
        F.coalesce(delta > window_days * DAY, F.lit(False)).alias("temporally_distant"), F.coalesce(F.size("pool"), F.lit(0)).cast("long").alias("considered"),
    )


def resolve_sorted(dependencies: DataFrame, captures: DataFrame, *, window_days: int, key: str) -> DataFrame:
    """`resolve_assets` whatever the number of captures: a two-sided as-of join. Dependencies
    and captures of a key are sorted together, and each dependency looks at the capture before and the one after it, so
    rows never multiply. References at one instant share an answer, and a key's instants are sorted in spans of 30 days that
    hand on their first and last captures, so no key is one task's work."""
    target = epoch_seconds(expand_timestamp(F.col("referring_timestamp"), "start"))
    wanted = dependencies.select("dep_id", key, "referring_timestamp", target.alias("at")).withColumn("instant", F.coalesce("at", F.lit(-(1 << 62))))
    usable = captures.withColumns({"at": start_epoch(F.col("timestamp")), "good": F.col("excluded_by").isNull()})
    pick = F.struct(F.coalesce(F.col("length"), F.lit(-1)).alias("size"), F.col("timestamp"), (-F.col("ord")).alias("first"))
    late = F.struct(F.col("timestamp"), (-F.col("ord")).alias("first"))
    pools = usable.groupBy(key).agg(
        F.count_if("good").alias("n_good"), F.count(F.lit(1)).alias("n_any"),
        F.max(F.when(F.col("good"), late))["timestamp"].alias("late_good"), F.max(late)["timestamp"].alias("late_any"),
        F.min_by("timestamp", F.when(F.col("good"), F.col("ord"))).alias("first_good"), F.min_by("timestamp", "ord").alias("first_any"),
    )
    moments = usable.where("at is not null").groupBy(key, "at").agg(F.max(F.when(F.col("good"), pick)).alias("good"), F.max(pick).alias("any"))
    named = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col("at"), F.col(c).alias("pick")))
    left = wanted.select(key, "at", "instant").distinct().withColumn("asks", F.lit(1))
    right = moments.select(key, "at", F.lit(0).alias("asks"), named("good").alias("g"), named("any").alias("o"))
    both = left.unionByName(right, allowMissingColumns=True)
    # a key's instants are sorted in spans of time; a span gets the latest captures before it and the first ones after it
    both = both.withColumn("__span", F.floor(F.col("at") / F.lit(SPAN)))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    ends = both.groupBy(key, "__span").agg(*[f(c).alias(f"{c}_{n}") for c in ("g", "o") for n, f in (("first", first), ("last", latest))])
    along = Window.partitionBy(key).orderBy("__span")
    earlier, later = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    ends = ends.select(key, "__span", *[F.last(f"{c}_last", ignorenulls=True).over(earlier).alias(f"{c}_ahead") for c in ("g", "o")], *[F.first(f"{c}_first", ignorenulls=True).over(later).alias(f"{c}_next") for c in ("g", "o")])
    before = Window.partitionBy(key, "__span").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key, "__span").orderBy(F.desc("at"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    looked = both.withColumns({f"{c}_{n}": F.last(c, ignorenulls=True).over(w) for c in ("g", "o") for n, w in (("before", before), ("after", after))}).where("asks = 1")
    spans = looked.join(ends.withColumnsRenamed({key: "__key", "__span": "__of"}), (F.col(key) == F.col("__key")) & F.col("__span").eqNullSafe(F.col("__of")), "left")
    seen = spans.withColumns({f"{c}_{n}": F.coalesce(f"{c}_{n}", f"{c}_{m}") for c in ("g", "o") for n, m in (("before", "ahead"), ("after", "next"))}).select(key, "at", "instant", "g_before", "g_after", "o_before", "o_after")
    seen = seen.join(pools, key, "left")
    good = F.coalesce(F.col("n_good") > 0, F.lit(False))

    def nearest(c: str) -> Column:
        a, b = F.col(f"{c}_before"), F.col(f"{c}_after")
        rank = lambda x: F.struct(-F.abs(F.col("at") - x["at"]), x["pick"]["size"], x["pick"]["timestamp"], x["pick"]["first"])
        return F.when(b.isNull() | (a.isNotNull() & (rank(a) >= rank(b))), a).otherwise(b)["pick"]["timestamp"]

    undated = F.when(F.col("at").isNull(), F.when(good, F.col("late_good")).otherwise(F.col("late_any"))).otherwise(F.when(good, F.col("first_good")).otherwise(F.col("first_any")))
    chosen = F.coalesce(F.when(F.col("at").isNotNull(), F.when(good, nearest("g")).otherwise(nearest("o"))), undated)
    out = seen.withColumn("resolved_timestamp", chosen).withColumn("delta_seconds", F.abs(F.col("at") - start_epoch(F.col("resolved_timestamp"))))
    answers = out.select(key, "instant", "resolved_timestamp", "delta_seconds", F.coalesce(F.col("delta_seconds") > window_days * DAY, F.lit(False)).alias("temporally_distant"), F.coalesce(F.when(good, F.col("n_good")).otherwise(F.col("n_any")), F.lit(0)).alias("considered"))
    return wanted.drop("at").join(answers, [key, "instant"], "left").select("dep_id", key, "referring_timestamp", "resolved_timestamp", "delta_seconds", "temporally_distant", "considered")


def absent_keys(wanted: DataFrame, captures: DataFrame, key: str = "capture_key") -> DataFrame:
    """Wanted keys of which no capture is known."""
    return wanted.select(key).distinct().join(captures.select(key), key, "left_anti")
