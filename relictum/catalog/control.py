"""Queries on what steers an acquisition, on evidence, and on recorded responses."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relictum.catalog.registry import cut, query, table
from relictum.functions.address import blocked_address_reason, destination_refusal
from relictum.operators import acquisition as A
from relictum.operators import captures as C
from relictum.operators import evidence as V
from relictum.operators import report as R
from relictum.sources import cdx
from relictum.sources.fixture import answer, read_fixture
from relictum.streaming.feeds import crawl_sessions as sessions
from relictum.streaming.feeds import windowed_counts as counts

BUDGETS = A.Budgets(max_requests=40, max_index_requests=8, max_total_bytes=1500, max_elapsed_ms=25 * 86400 * 1000)
ATTEMPT = "attempt as (select event_id as ord, user_id % 50 as host, event_type = 'view' as is_index, cast(floor(coalesce(value, 0)) as bigint) as bytes, cast(floor(epoch(ts)) as bigint) * 1000 as at_ms from events), timed as (select *, at_ms - min(at_ms) over (partition by host) as elapsed_ms from attempt)"


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relictum.functions.time import seconds_of

    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), (F.col("user_id") % 50).alias("host"), (F.col("event_type") == "view").alias("is_index"), F.floor(F.coalesce("value", F.lit(0.0))).cast("long").alias("bytes"), (seconds_of(F.col("ts")) * 1000).alias("at_ms"))
    first = e.groupBy("host").agg(F.min("at_ms").alias("first_ms"))
    return e.join(first, "host").withColumn("elapsed_ms", F.col("at_ms") - F.col("first_ms"))


@query(f"""
with {ATTEMPT}, spent as (
  select *, count(*) over w as spent_requests, coalesce(cast(sum(cast(is_index as int)) over w as bigint), 0) as spent_index, coalesce(cast(sum(bytes) over w as bigint), 0) as spent_bytes
  from timed window w as (partition by host order by ord rows between unbounded preceding and 1 preceding))
select ord, host, spent_requests, spent_index, spent_bytes, case when elapsed_ms >= {BUDGETS.max_elapsed_ms} then 'elapsed time' when spent_requests >= {BUDGETS.max_requests} then 'requests'
  when is_index and spent_index >= {BUDGETS.max_index_requests} then 'index requests' when spent_bytes >= {BUDGETS.max_total_bytes} then 'total bytes' end as refused_by from spent
""")
def budget_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ledger(attempts(spark, sf_dir), BUDGETS, key="host").select("ord", "host", "spent_requests", "spent_index", "spent_bytes", "refused_by")


@query(f"""
with {ATTEMPT}, n as (select *, row_number() over (partition by host order by ord) - 1 as n from attempt)
select ord, host, cast(max(at_ms - n * 1500000) over (partition by host order by ord rows unbounded preceding) + n * 1500000 as bigint) as start_ms from n
""")
def rate_limit_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.schedule(attempts(spark, sf_dir), 1_500_000, key="host", arrival="at_ms").select("ord", "host", "start_ms")


@query("""
select event_id as ord, case when s in (301, 302, 303, 307, 308) then case when event_id % 7 < 5 then 'follow' else 'redirect-limit' end
  when s in (429, 503) then case when event_id % 4 < 3 then 'retry' else 'provider-throttled' end
  when s >= 500 or s = 408 then case when event_id % 4 < 3 then 'retry' else 'http-status' end
  when s >= 400 then 'http-status' else 'take' end as verdict
from (select event_id, [200, 301, 404, 408, 429, 500, 503, 304][1 + event_id % 8] as s from events)
""")
def attempt_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.get(F.array(*[F.lit(s) for s in (200, 301, 404, 408, 429, 500, 503, 304)]), (F.col("event_id") % 8).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), A.attempt_verdict(status, F.col("event_id") % 4, F.col("event_id") % 7, A.Budgets()).alias("verdict"))


CHAIN = """
r as (select event_id as ord, user_id % 300 as item, [200, 301, 404, 408, 429, 500, 503, 302, 301, 302][1 + event_id % 10] as status, 'http://a.example/' || event_id % 13 as url, 'http://a.example/' || event_id % 17 as location from events)
"""


@query(f"""
with {CHAIN}, s as (
  select *, case when status in (301, 302, 303, 307, 308) then 1 else 0 end as hop, row_number() over (partition by item order by ord) as n from r
), t as (select *, coalesce(sum(hop) over (partition by item order by ord rows between unbounded preceding and 1 preceding), 0) as hops, list(url) over (partition by item order by ord rows unbounded preceding) as asked from s
), u as (select *, row_number() over (partition by item, hops order by ord) as try from t
), v as (
  select *, case when hop = 1 and list_contains(asked, location) then 'redirect-loop' when hop = 1 then case when hops < 5 then 'follow' else 'redirect-limit' end
    when status in (429, 503) then case when try < 3 then 'retry' else 'provider-throttled' end when status >= 500 or status = 408 then case when try < 3 then 'retry' else 'http-status' end
    when status >= 400 then 'http-status' else 'take' end as verdict from u
), e as (select item, arg_min(verdict, n) as verdict, min(n) as requests, arg_min(hops, n) as hops from v where verdict not in ('follow', 'retry') group by item)
select v.item, coalesce(any_value(e.verdict), 'unfinished') as verdict, cast(coalesce(any_value(e.requests), max(v.n)) as bigint) as requests, cast(coalesce(any_value(e.hops), max(v.hops)) as bigint) as hops
from v left join e on e.item = v.item group by v.item
""")
def settled_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    status = F.get(F.array(*[F.lit(s) for s in (200, 301, 404, 408, 429, 500, 503, 302, 301, 302)]), (e % 10).cast("int"))
    url = lambda n: F.concat(F.lit("http://a.example/"), (e % n).cast("string"))
    rows = table(spark, sf_dir, "events").select(e.alias("ord"), (F.col("user_id") % 300).alias("item"), status.alias("status"), url(13).alias("url"), url(17).alias("location"))
    return A.settle(rows, A.Budgets(), key="item")


@query("""
with h as (select page_id, lower(regexp_extract(url, '://([^/?#:]+)', 1)) as host from pages)
select page_id, host = 'example.com' or ends_with(host, '.example.com') as by_domain, host = 'example.com' as by_host, false as by_prefix, false as by_part from h
""")
def inventory_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relictum.functions.url import host_of

    host = host_of(F.col("url"))
    proves = lambda complete, kind: cdx.proves_absence(complete, False, kind, host, "example.com")
    return table(spark, sf_dir, "pages").select("page_id", proves(True, "domain").alias("by_domain"), proves(True, "host").alias("by_host"), proves(True, "prefix").alias("by_prefix"), proves(False, "domain").alias("by_part"))


#: Customers lead to their orders, orders to their parts, and a part to the one after it, ten parts in a row.
@query("""
with recursive edge as (
  select o_custkey as src, 10000000000 + o_orderkey as dst from orders union select 10000000000 + l_orderkey, 20000000000 + l_partkey from lineitem
  union select 20000000000 + p_partkey, 20000000001 + p_partkey from part where p_partkey % 10 <> 9),
walk as (select c_custkey as node, 0 as wave from customer where c_custkey % 20 = 0 union select e.dst, w.wave + 1 from walk w join edge e on e.src = w.node)
select node, min(wave) as wave from walk group by node
""")
def worklist_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, part = 10_000_000_000, 20_000_000_000
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + order).alias("dst"))
    b = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + order).alias("src"), (F.col("l_partkey") + part).alias("dst"))
    c = table(spark, sf_dir, "part").where("p_partkey % 10 != 9").select((F.col("p_partkey") + part).alias("src"), (F.col("p_partkey") + part + 1).alias("dst"))
    roots = table(spark, sf_dir, "customer").where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("node"), F.lit(0).alias("ord"))
    return A.waves(roots, cut(a.union(b).union(c).distinct(), "edges"), cut).select("node", "wave")


#: Orders as rows of an index, so many keys a page.
KEYS_A_PAGE = 20_000


@query(f"""
with o as (select *, dense_rank() over (order by o_orderkey // {KEYS_A_PAGE}) - 1 as page_ord from orders)
select page_ord, cast(row_number() over (partition by page_ord order by o_orderkey) - 1 as int) as row_ord, '' as urlkey, strftime(o_orderdate, '%Y%m%d%H%M%S') as timestamp, 'http://site.example/' || o_orderkey as original,
  'text/html' as mimetype, '200' as statuscode, cast(o_custkey as varchar) as digest, cast(cast(floor(o_totalprice) as bigint) as varchar) as length
from o
""")
def index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A streamed scan that its budget stops after a page and that goes on from its key."""
    from pyspark.sql import Window

    from relictum.sources.index_stream import recorded_pages, scan_index
    from relictum.workspace import own_folder

    o = table(spark, sf_dir, "orders")
    cells = F.array(F.lit(""), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.concat(F.lit("http://site.example/"), F.col("o_orderkey").cast("string")), F.lit("text/html"), F.lit("200"), F.col("o_custkey").cast("string"), F.floor("o_totalprice").cast("string"))
    held = o.select(F.floor(F.col("o_orderkey") / KEYS_A_PAGE).alias("page"), "o_orderkey", F.to_json(cells).alias("row")).groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "row"))), lambda x: x["row"]), ",").alias("rows"))
    w = Window.orderBy("page")  # one row a page, without its rows
    pages = o.select(F.floor(F.col("o_orderkey") / KEYS_A_PAGE).alias("page")).distinct()
    keyed = held.join(pages.select("page", F.lead("page").over(w).alias("next"), F.lag("page").over(w).alias("last")), "page")
    key = lambda c: F.concat(F.lit("key-"), c.cast("string"))
    more = F.when(F.col("next").isNotNull(), F.concat(F.lit(',[],["'), key(F.col("next")), F.lit('"]'))).otherwise("")
    body = F.concat(F.lit("[" + json.dumps(list(C.FIELDS)) + ","), "rows", more, F.lit("]"))
    root = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    keyed.select(F.when(F.col("last").isNull(), "").otherwise(key(F.col("page"))).alias("resume_key"), body.alias("body"), "page").repartitionByRange("page").sortWithinPartitions("page").drop("page").write.option("parquet.block.size", 8 << 20).parquet(f"{root}/recorded")
    fetch, most = recorded_pages(f"{root}/recorded"), 1_000_000
    scan_index(spark, fetch, f"{root}/scan", limit=KEYS_A_PAGE, most=1)
    pages, _ = scan_index(spark, fetch, f"{root}/scan", limit=KEYS_A_PAGE, most=most)
    return cdx.page_rows(pages)


#: Pages as captures of a site: every fifth answers 503, every fifth leads elsewhere, every fifth is gone. Each 500 rows of the index
#: are a request too, under no budget but that of all requests, and the item that this one refuses has made what was left of them.
@query("""
with p as (select page_id, page_id % 5 as kind, case page_id % 5 when 1 then 3 when 2 then 2 else 1 end as requests from pages),
run as (select *, sum(requests) over (order by page_id) as upto from p), stop as (select min(page_id) as halt from run where upto > 60 - (select count(distinct page_id // 500) from p))
select 'http://site.example/' || page_id as original_url, case when page_id >= halt then 'unattempted' when kind in (1, 3) then 'failed' else 'fetched' end as status,
  case when page_id >= halt then 'unattempted' when kind = 1 then 'rate-limited' when kind = 3 then 'not-archived' else 'ok' end as outcome, cast(case when page_id > halt then 0 when page_id = halt then 60 - (select count(distinct page_id // 500) from p) - (upto - requests) else requests end as bigint) as requests
from run, stop
""")
def acquisition_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relictum.config import Project
    from relictum.plans.acquire import Run
    from relictum.workspace import own_folder

    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("http://site.example/"), F.col("page_id").cast("string")).alias("url"), "html")
    stamp = F.lit("19990101000000")
    row = F.to_json(F.array(F.lit(""), stamp, F.col("url"), F.lit("text/html"), F.lit("200"), F.col("page_id").cast("string"), F.lit("1")))
    header = F.lit(json.dumps(list(C.FIELDS)))
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", row.alias("row")))), lambda x: x["row"]), ",")
    index = pages.groupBy(F.floor(F.col("page_id") / 500).alias("page_ord")).agg(F.concat(F.lit("["), header, F.lit(","), rows, F.lit("]")).alias("body"))
    kind = F.col("page_id") % 5
    status = F.get(F.array(*[F.lit(x) for x in (200, 503, 302, 404, 200)]), kind.cast("int"))
    answers = pages.where("page_id % 5 != 2").select("url", status.alias("http_status"), F.lit(None).cast("string").alias("location"), "html")
    moved = pages.where("page_id % 5 = 2").select("url", F.lit(302).alias("http_status"), F.concat(F.lit("/web/19990102000000/http://elsewhere.example/"), F.col("page_id").cast("string")).alias("location"), F.lit(None).cast("string").alias("html"))
    target = pages.where("page_id % 5 = 2").select(F.concat(F.lit("http://elsewhere.example/"), F.col("page_id").cast("string")).alias("original_url"), F.lit("19990102000000").alias("timestamp"), F.lit(200).alias("http_status"), F.lit(None).cast("string").alias("location"), F.col("html"))
    here = answers.unionByName(moved).select(F.col("url").alias("original_url"), stamp.alias("timestamp"), "http_status", "location", "html")
    responses = here.unionByName(target).withColumn("content_type", F.lit("text/html; charset=utf-8")).withColumn("body", F.col("html").cast("binary")).drop("html")
    project = Project("site", "site.example", start="1999", end="1999", budgets=A.Budgets(max_requests=60, max_index_requests=60, max_pages=1_000_000), reselection_attempts=0)
    items = Run(spark, project, f"{own_folder(spark)}/{uuid.uuid4().hex}").execute(index, responses)["items"]
    return items.select("original_url", "status", "outcome", "requests")


TRIED = """
ranked as (
  select o_custkey as capture_key, cast(row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) - 1 as int) as place, strftime(o_orderdate, '%Y%m%d%H%M%S') as timestamp,
    case when o_orderkey % 3 = 0 then 'ok' when o_orderkey % 3 = 1 then 'parked-domain' else 'http-error' end as outcome from orders)
"""


@query(f"""
with {TRIED}, first as (select capture_key, outcome from ranked where place = 0), s as (
  select f.capture_key, f.outcome = 'parked-domain' as starts, min(case when r.outcome = 'ok' and r.place <= 2 then r.place end) as ok_at, max(case when r.place <= 2 then r.place end) as last, count(*) as known
  from first f join ranked r on r.capture_key = f.capture_key group by all), d as (
  select *, case when starts and ok_at is not null then ok_at else 0 end as used_place, case when not starts then 0 else coalesce(ok_at, last) end as further_attempts,
    case when not starts then 'not-needed' when ok_at is not null then 'ok' when known - 1 > 2 then 'attempt-limit' else 'no-remaining-alternative' end as stop_reason from s)
select d.capture_key, used_place, further_attempts, stop_reason, string_agg(r.timestamp || '=' || r.outcome, ', ' order by r.place) as trail
from d join ranked r on r.capture_key = d.capture_key and r.place <= d.further_attempts group by all
""")
def reselection_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    outcome = F.when(F.col("o_orderkey") % 3 == 0, "ok").when(F.col("o_orderkey") % 3 == 1, "parked-domain").otherwise("http-error")
    ranked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("capture_key"), (F.row_number().over(w) - 1).cast("int").alias("place"), F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("timestamp"), outcome.alias("outcome"))
    return A.reselect(ranked.where("place = 0").select("capture_key", "outcome"), ranked, 2)


#: A wide item table made of orders, so that every kind of gap occurs.
WIDE = {
    "original_url": "'http://site.example/' || o_orderkey",
    "status": "case o_orderkey % 5 when 0 then 'failed' when 1 then 'unattempted' when 2 then 'skipped' else 'fetched' end",
    "unattempted_reason": "case when o_orderkey % 3 = 0 then 'budget-exhausted' end",
    "failure_kind": "case when o_orderkey % 5 = 0 then 'http-status' end",
    "failure_message": "'status 500'",
    "retryable": "o_orderkey % 2 = 0",
    "outcome": "case when o_orderkey % 4 = 0 then 'parked-domain' else 'ok' end",
    "outcome_detail": "'holding page'",
    "validated": "true",
    "body_hash": "'x'",
    "digests": "cast(o_orderkey % 6 as bigint)",
    "resolution_detail": "'chosen by nearness'",
    "removed_nodes": "cast(case when o_orderkey % 11 = 0 then 2 else 0 end as int)",
    "removal_rules": "'wayback-toolbar-insert'",
    "score": "5e-1",
    "band": "case when o_orderkey % 7 = 0 then 'review-required' else 'accept' end",
    "weakest": "'structure'",
    "overridden": "o_orderkey % 14 = 0",
    "from_excluded": "o_orderstatus = 'F'",
    "requested_ts": "'19990101000000'",
    "served_ts": "'20010101000000'",
    "archive_status": "'404'",
    "degraded": "o_orderkey % 17 = 0",
    "replacement_ratio": "25e-2",
    "encoding": "'windows-1252'",
    "truncated": "o_orderkey % 19 = 0",
    "bytes_read": "cast(8388608 as bigint)",
    "distance_seconds": "cast(o_orderkey * 100000 as bigint)",
}
WIDE_SQL = "wide as (select " + ", ".join(f"{v} as {k}" for k, v in WIDE.items()) + " from orders)"
GAPS = f"""
with {WIDE_SQL}, gap as (
  select 'asset-content-drift' as kind, original_url, 'this URL served ' || digests || ' distinct content hashes; ' || resolution_detail as detail, '{V.REMEDY["asset-content-drift"]}' as remedy from wide where digests > 1
  union all select 'archive-injection', original_url, 'the defensive strip removed ' || removed_nodes || ' archive-injected node(s) (' || removal_rules || ')', '{V.REMEDY["archive-injection"]}' from wide where removed_nodes > 0
  union all select 'low-fidelity', original_url, 'fidelity 0.5000 needs review; weakest signal structure', case when overridden then '{V.REMEDY["low-fidelity, overridden"]}' else '{V.REMEDY["low-fidelity"]}' end from wide where band = 'review-required'
  union all select 'non-content-body', original_url, outcome || ': ' || outcome_detail, '{V.REMEDY["non-content-body"]}' from wide where status = 'fetched' and outcome <> 'ok'
  union all select 'failed-fetch', original_url, failure_kind || ': ' || failure_message, case when retryable then '{V.REMEDY["failed-fetch, retryable"]}' else '{V.REMEDY["failed-fetch"]}' end from wide where status = 'failed'
  union all select 'excluded-capture-only', original_url, 'every indexed capture failed the candidate filter; acquired 19990101000000 with archive status 404', '{V.REMEDY["excluded-capture-only"]}' from wide where from_excluded
  union all select 'unattempted', original_url, 'no request was made: ' || coalesce(unattempted_reason, 'queued'), case when unattempted_reason = 'budget-exhausted' then '{V.REMEDY["unattempted, budget"]}' else '{V.REMEDY["unattempted"]}' end from wide where status = 'unattempted'
  union all select 'no-capture', original_url, 'no capture is known for this URL', '{V.REMEDY["no-capture"]}' from wide where status = 'skipped'
  union all select 'degraded-encoding', original_url, 'replacement ratio 0.2500 exceeds 0.01 under windows-1252', '{V.REMEDY["degraded-encoding"]}' from wide where degraded
  union all select 'truncated-body', original_url, 'body hit the response byte cap at 8388608 bytes', '{V.REMEDY["truncated-body"]}' from wide where truncated
  union all select 'capture-era-distance', original_url, 'served capture 20010101000000 is ' || distance_seconds || 's from the requested 19990101000000', '{V.REMEDY["capture-era-distance"]}' from wide where distance_seconds > 365 * 86400
)
"""


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*[F.expr(v).alias(k) for k, v in WIDE.items()])


@query(GAPS + "select kind, original_url, detail, remedy from gap")
def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.gaps(wide(spark, sf_dir))


@query(GAPS + "select kind, count(*) as n from gap group by kind")
def gap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.gaps(wide(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
with {WIDE_SQL} select count(*) as items, count(*) filter (status = 'fetched') as fetched, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'unattempted') as unattempted,
  count(*) filter (status = 'skipped') as skipped, count(*) filter (outcome = 'ok') as eligible, count(*) filter (outcome = 'ok' and not (band = 'review-required' and not overridden)) as promotable from wide
""")
def evidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.evidence_counts(wide(spark, sf_dir).withColumn("promotion_blocked", (F.col("band") == "review-required") & ~F.col("overridden")))


#: What a report reads besides: orders as items of which every third is an asset.
REPORTED = WIDE | {
    "kind": "case when o_orderkey % 3 = 0 then 'dependency' else 'page' end",
    "referring_timestamp": "case when o_orderkey % 3 = 0 then '20000101000000' end",
    "requested_ts": "case when o_orderkey % 10 <> 3 then '19990101000000' end",
    "served_ts": "case when o_orderkey % 13 <> 0 then '20010101000000' end",
    "temporally_distant": "o_orderkey % 8 = 0",
    "index_requests": "cast(o_orderkey % 4 as bigint)",
    "score": "case when o_orderkey % 3 > 0 then 5e-1 end",
    "structure": "case when o_orderkey % 2 = 0 then 1e0 end",
    "boilerplate": "25e-2",
    "encoding_signal": "1e0",
    "promotion_blocked": "o_orderkey % 7 = 0 and not o_orderkey % 14 = 0",
}
REPORTED_SQL = "reported as (select " + ", ".join(f"{v} as {k}" for k, v in REPORTED.items()) + " from orders)"
DISTANT = "(coalesce(temporally_distant, false) or (served_ts is not null and 366 * 86400 > 300 * 86400))"


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "orders").select(*[F.expr(v).alias(k) for k, v in REPORTED.items()])
    return items.drop("encoding", "failure").withColumnRenamed("encoding_signal", "encoding")


def totals_sql(section: str, counts: dict[str, str]) -> str:
    return " union all ".join(f"select '{section}' as section, '{name}' as name, count(*) filter ({test}) as n from reported" for name, test in counts.items())


@query(f"with {REPORTED_SQL} " + " union all ".join([
    totals_sql("counts", {
        "items": "true", "indexed": "true", "fetched": "status = 'fetched'", "failed": "status = 'failed'", "unattempted": "status = 'unattempted'", "skipped": "status = 'skipped'",
        "recoveredFiles": "status = 'fetched' and body_hash is not null and validated", "referenceEligible": "outcome = 'ok'",
    }),
    totals_sql("assets", {
        "assets": "referring_timestamp is not null", "lookups": "referring_timestamp is not null and index_requests > 0", "resolvedFromInventory": "referring_timestamp is not null and requested_ts is not null and index_requests = 0",
        "withoutCapture": "referring_timestamp is not null and requested_ts is null", "temporallyDistant": f"referring_timestamp is not null and {DISTANT}",
    }),
    "select 'assets', 'lookupIndexRequests', cast(sum(index_requests) filter (referring_timestamp is not null) as bigint) from reported",
    totals_sql("fidelity", {
        "scored": "score is not null", "accept": "score is not null and band = 'accept'", "acceptWithWarning": "false", "reviewRequired": "score is not null and band = 'review-required'",
        "promotable": "score is not null and outcome = 'ok' and not promotion_blocked", "overridden": "score is not null and overridden",
    }),
]))
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.total_rows(reported(spark, sf_dir), 300)


@query(f"""
with {REPORTED_SQL} select original_url, requested_ts as resolved_ts, served_ts, case when served_ts is not null then cast(366 * 86400 as bigint) end as served_delta_seconds, {DISTANT} as temporally_distant,
  case when requested_ts is null then 'none' when index_requests > 0 then 'targeted-lookup' else 'inventory' end as source, digests, status from reported where referring_timestamp is not null
""")
def report_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.asset_entries(reported(spark, sf_dir), 300).select("original_url", "resolved_ts", "served_ts", "served_delta_seconds", "temporally_distant", "source", "digests", "status")


@query(f"""
with {REPORTED_SQL}, signal as (select * from (values ('structure', 3e-1), ('boilerplate', 25e-2), ('encoding', 25e-2), ('assets', 15e-2), ('cross-capture', 1e-1)) s(signal, w)),
valued as (select original_url, signal, w, case signal when 'structure' then structure when 'boilerplate' then boilerplate when 'encoding' then encoding_signal end as value from reported, signal where score is not null)
select original_url, signal, value, case when value is null then 0e0 else w end as weight, coalesce(floor(value * w * 10000 + 0.5) / 10000, 0e0) as contribution from valued
""")
def report_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scored(reported(spark, sf_dir)).select("original_url", "signal", "value", "weight", "contribution")


@query(f"with {WIDE_SQL} select status, original_url, row_number() over (partition by status order by original_url) as place, count(*) over (partition by status) as n from wide")
def items_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each item with its place among those of its status; sorted in ranges, so that a status may have very many."""
    ranked = A.running_totals(wide(spark, sf_dir).select("status", "original_url"), ["status", "original_url"], {}, cut)
    each = ranked.groupBy("status").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
    return ranked.join(F.broadcast(each), "status").select("status", "original_url", (F.col("rank") - F.col("first") + 1).alias("place"), "n")  # one row a status


@query("""
with r as (select n_nationkey as run_id, n_nationkey % 2 = 0 as continued, n_nationkey % 3 = 0 as failed, n_nationkey % 5 = 0 as limit_reached from nation)
select run_id, 'the provider offered more rows than were read' as reason from r where continued union all select run_id, 'an index request failed' from r where failed
union all select run_id, 'a page of rows was filled to its limit' from r where limit_reached
""")
def partial_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return V.inventory_reasons(table(spark, sf_dir, "nation").select(n.alias("run_id"), (n % 2 == 0).alias("continued"), (n % 3 == 0).alias("failed"), (n % 5 == 0).alias("limit_reached")))


@query("""
with a as (select s_suppkey, (s_suppkey * 37) % 256 as a, (s_suppkey * 91) % 256 as b, s_suppkey % 3 as c from supplier union all select 100000 + n_nationkey, [0, 10, 127, 100, 169, 172, 192, 192, 198, 224][1 + n_nationkey % 10], [0, 1, 0, 64, 254, 16, 0, 168, 18, 1][1 + n_nationkey % 10], 0 from nation)
select s_suppkey, a || '.' || b || '.' || c || '.9' as address, case when a = 0 then 'unspecified 0.0.0.0/8' when a = 10 then 'private 10.0.0.0/8' when a = 127 then 'loopback 127.0.0.0/8' when a = 100 and b between 64 and 127 then 'carrier-grade NAT 100.64.0.0/10'
  when a = 169 and b = 254 then 'link-local 169.254.0.0/16 (includes cloud metadata)' when a = 172 and b between 16 and 31 then 'private 172.16.0.0/12' when a = 192 and b = 0 and c = 0 then 'IETF protocol assignments 192.0.0.0/24'
  when a = 192 and b = 168 then 'private 192.168.0.0/16' when a = 198 and b in (18, 19) then 'benchmarking 198.18.0.0/15' when a >= 224 then 'multicast or reserved 224.0.0.0/3' end as reason from a
""")
def blocked_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = F.col("s_suppkey"), F.col("n_nationkey")
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (n % 10).cast("int"))
    a = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws(".", (s * 37 % 256).cast("string"), (s * 91 % 256).cast("string"), (s % 3).cast("string"), F.lit("9")).alias("address"))
    b = table(spark, sf_dir, "nation").select((n.cast("long") + 100000).alias("s_suppkey"), F.concat_ws(".", pick((0, 10, 127, 100, 169, 172, 192, 192, 198, 224)).cast("string"), pick((0, 1, 0, 64, 254, 16, 0, 168, 18, 1)).cast("string"), F.lit("0"), F.lit("9")).alias("address"))
    return a.union(b).select("s_suppkey", "address", blocked_address_reason(F.col("address")).alias("reason"))


#: What hosts of pages resolve to: one address for each page, of four families, reserved for some.
@query("""
with h as (select page_id, lower(regexp_extract(url, '://([^/?#:]+)', 1)) as host, (page_id * 37) % 256 as a, (page_id * 91) % 256 as b, page_id % 3 as c from pages),
t as (select *, case page_id % 4 when 0 then a || '.' || b || '.' || c || '.9' when 1 then '::ffff:' || a || '.' || b || '.' || c || '.9' when 2 then printf('%x', 64768 + (page_id * 13) % 768) || '::' || c else '64:ff9b::' || c end as address from h),
r as (select *, case
  when page_id % 4 = 3 then 'NAT64 64:ff9b::/96' when page_id % 4 = 2 then case when (page_id * 13) % 768 < 256 then 'unique local fc00::/7' when (page_id * 13) % 768 between 384 and 447 then 'link-local fe80::/10' when (page_id * 13) % 768 >= 512 then 'multicast ff00::/8' end
  when a = 0 then 'unspecified 0.0.0.0/8' when a = 10 then 'private 10.0.0.0/8' when a = 127 then 'loopback 127.0.0.0/8' when a = 100 and b between 64 and 127 then 'carrier-grade NAT 100.64.0.0/10'
  when a = 169 and b = 254 then 'link-local 169.254.0.0/16 (includes cloud metadata)' when a = 172 and b between 16 and 31 then 'private 172.16.0.0/12' when a = 192 and b = 0 and c = 0 then 'IETF protocol assignments 192.0.0.0/24'
  when a = 192 and b = 168 then 'private 192.168.0.0/16' when a = 198 and b in (18, 19) then 'benchmarking 198.18.0.0/15' when a >= 224 then 'multicast or reserved 224.0.0.0/3' end as reason from t),
f as (select host, min(page_id) filter (reason is not null) as ord from r group by host)
select r.page_id, r.host, r.address, r.reason, case when f.ord is not null then r.host || ' resolves to ' || b.address || ', which is ' || b.reason end as refusal
from r join f using (host) left join r b on b.page_id = f.ord
""")
def guarded_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relictum.functions.address import block_table, blocked_addresses, refused_hosts
    from relictum.functions.url import host_of

    i, text = F.col("page_id"), lambda c: c.cast("string")
    a, b, c = text(i * 37 % 256), text(i * 91 % 256), text(i % 3)
    four = F.concat_ws(".", a, b, c, F.lit("9"))
    six = F.concat(F.lower(F.hex(64768 + i * 13 % 768)), F.lit("::"), c)
    address = F.get(F.array(four, F.concat(F.lit("::ffff:"), four), six, F.concat(F.lit("64:ff9b::"), c)), (i % 4).cast("int"))
    resolved = cut(table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), i.alias("ord"), address.alias("address")), "resolved")
    blocks = block_table(spark)
    return blocked_addresses(resolved, blocks).join(refused_hosts(resolved, blocks), "host").select("page_id", "host", "address", "reason", "refusal")


CASES = (
    ("https://web.archive.example/x", ["93.184.216.34"], None),
    ("ftp://web.archive.example/x", ["93.184.216.34"], "scheme ftp: is not http or https"),
    ("https://u:p@web.archive.example/", ["93.184.216.34"], "URL carries embedded credentials"),
    ("https://web.archive.example:8080/", ["93.184.216.34"], "port 8080 is not in the allowed set"),
    ("https://evil.example/", ["93.184.216.34"], "host evil.example is not an allowed provider host"),
    ("https://web.archive.example/y", ["93.184.216.34", "10.0.0.7"], "web.archive.example resolves to 10.0.0.7, which is private 10.0.0.0/8"),
    ("https://web.archive.example/z", ["::ffff:7f00:1"], "web.archive.example resolves to ::ffff:7f00:1, which is loopback 127.0.0.0/8"),
    ("https://web.archive.example/q", ["fd00::1"], "web.archive.example resolves to fd00::1, which is unique local fc00::/7"),
    ("https://web.archive.example/n", [], "web.archive.example resolved to no addresses"),
)


def literal(x: str | None) -> str:
    return "null" if x is None else "'" + x.replace("'", "''") + "'"


@query("select * from (values " + ", ".join(f"({i}, {literal(u)}, {literal(r)})" for i, (u, _, r) in enumerate(CASES)) + ") t(n, url, refusal)")
def destination_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame([(i, u, a) for i, (u, a, _) in enumerate(CASES)], "n int, url string, addresses array<string>")
    return cases.select("n", "url", destination_refusal(F.col("url"), F.col("addresses"), ["archive.example"]).alias("refusal"))


INDEX_PAGES = (
    (0, [["urlkey", "timestamp", "original", "mimetype", "statuscode", "digest", "length"], ["a", "19990101000000", "http://a.example/", "text/html", "200", "D1", "120"], ["b", "1999", "http://a.example/b", "-", "404", "", ""], [], ["key-2"]]),
    (1, [["timestamp", "original", "statuscode"], ["20000229", "http://a.example/c", "302"]]),
    (2, []),
)


@query("""
select * from (values (0, 0, 'a', '19990101000000', 'http://a.example/', 'text/html', '200', 'D1', '120'), (0, 1, 'b', '1999', 'http://a.example/b', '-', '404', '', ''),
  (1, 0, '', '20000229', 'http://a.example/c', '', '302', '', '')) t(page_ord, row_ord, urlkey, timestamp, original, mimetype, statuscode, digest, length)
""")
def index_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.createDataFrame([(n, json.dumps(rows)) for n, rows in INDEX_PAGES], "page_ord int, body string")
    return cdx.page_rows(pages)


@query("select * from (values (0, 2::bigint, 'key-2', true), (1, 1::bigint, null, false), (2, 0::bigint, null, false)) t(page_ord, n_rows, resume_key, limit_reached)")
def index_page_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.createDataFrame([(n, json.dumps(rows)) for n, rows in INDEX_PAGES], "page_ord int, body string")
    return cdx.page_ends(pages, 2)


@query("""
select page_id, 'https://cdx.example/search?url=' || url_encode(url) || '&matchType=exact&output=json&fl=urlkey%2Ctimestamp%2Coriginal%2Cmimetype%2Cstatuscode%2Cdigest%2Clength&limit=100&from=1999&filter=statuscode%3A200&showResumeKey=true' as index_url from pages
""")
def index_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", cdx.index_url("https://cdx.example/search", F.col("url"), match_type="exact", limit=100, start="1999", filters=("statuscode:200",)).alias("index_url"))


MANIFEST = json.dumps({"rules": [
    {"id": "index", "urlIncludes": ["/cdx"], "respond": [{"status": 200, "bodyUtf8": "[]"}]},
    {"id": "page", "urlIncludes": ["/web/", "a.example"], "urlExcludes": ["logo"], "respond": [{"status": 429}, {"status": 200, "bodyText": "café au lait"}]},
]})


@query("select * from (values (0, 0, 200, '[]', false), (1, 1, 429, '', false), (2, 1, 200, 'caf', true), (3, 1, 200, 'caf', true), (4, -1, 0, '', false)) t(ord, rule_ord, status, body_text, truncated)")
def fixture_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = ("https://x.example/cdx?q", "https://x.example/web/1/a.example/", "https://x.example/web/2/a.example/", "https://x.example/web/3/a.example/", "https://x.example/web/3/a.example/logo.gif")
    requests = spark.createDataFrame(list(enumerate(urls)), "ord int, url string")
    return answer(requests, read_fixture(spark, MANIFEST), 3).select("ord", F.coalesce("rule_ord", F.lit(-1)).alias("rule_ord"), F.coalesce("status", F.lit(0)).alias("status"), F.coalesce(F.decode("body", "ISO-8859-1"), F.lit("")).alias("body_text"), F.coalesce("truncated", F.lit(False)).alias("truncated"))


@query("""
with o as (select user_id, ts, value, ts - lag(ts) over (partition by user_id order by ts) >= interval 30 minutes as cutting from events),
s as (select user_id, ts, value, sum(case when cutting then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as n from o)
select user_id, min(ts) as session_start, max(ts) + interval 30 minutes as session_end, count(*) as requests from s group by user_id, n
""")
def crawl_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of a streaming operator; times leave without a zone, as they came."""
    found = sessions(table(spark, sf_dir, "events"))
    return found.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "requests")


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n from events group by all")
def request_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counts(table(spark, sf_dir, "events"))
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
