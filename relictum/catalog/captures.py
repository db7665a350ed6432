"""Queries on captures. Orders stand in for captures: a customer is a URL, an order one of its captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relictum.catalog.registry import query, table
from relictum.functions import time as T
from relictum.operators import captures as C
from relictum.operators.fidelity import asset_credit

TARGET = "1995"
CAPTURE = """
capture as (
  select o_custkey as capture_key, strftime(o_orderdate, '%Y%m%d%H%M%S') as timestamp, cast(floor(o_totalprice) as bigint) as length,
    o_orderpriority as digest, case o_orderstatus when 'O' then '200' when 'F' then '404' else '302' end as status_code, o_orderkey as ord,
    case when o_orderstatus <> 'O' then 'statuscode:200' end as excluded_by, cast(epoch(o_orderdate) as bigint) as moment
  from orders
), pool as (
  select * from (select *, max(case when excluded_by is null then 1 else 0 end) over (partition by capture_key) as has_good from capture)
  where excluded_by is null or has_good = 0
), target as (select cast(epoch(timestamp '1995-12-31 23:59:59') as bigint) as t)
"""


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.select(
        F.col("o_custkey").alias("capture_key"), F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("timestamp"), F.floor("o_totalprice").cast("string").alias("length"),
        F.col("o_orderpriority").alias("digest"), F.when(F.col("o_orderstatus") == "O", "200").when(F.col("o_orderstatus") == "F", "404").otherwise("302").alias("statuscode"),
        F.col("o_orderkey").alias("ord"), F.concat(F.lit("http://site.example/"), F.col("o_custkey").cast("string")).alias("original"), F.lit("text/html").alias("mimetype"),
    )
    return C.as_candidates(C.tag_exclusions(rows)).drop("original", "mimetype")


@query(f"with {CAPTURE} select ord, capture_key, timestamp, excluded_by from capture")
def candidate_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(spark, sf_dir).select("ord", "capture_key", "timestamp", "excluded_by")


@query(f"with {CAPTURE} select excluded_by, status_code, count(*) as n from capture where excluded_by is not null group by all")
def timeline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(spark, sf_dir).where("excluded_by is not null").groupBy("excluded_by", "status_code").agg(F.count(F.lit(1)).alias("n"))


@query("""
select o_orderkey as ord, regexp_full_match(o_orderpriority, '[1-3].*') and not regexp_full_match(o_orderstatus, 'P') as passes,
  case when not regexp_full_match(o_orderpriority, '[1-3].*') then 'digest:[1-3].*' when regexp_full_match(o_orderstatus, 'P') then '!statuscode:P' end as excluded_by
from orders
""")
def candidate_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("digest"), F.col("o_orderstatus").alias("statuscode"))
    tagged = C.tag_exclusions(rows, ("digest:[1-3].*", "!statuscode:P"))
    return tagged.select("ord", F.col("excluded_by").isNull().alias("passes"), "excluded_by")


MIME = "case o_orderkey % 6 when 0 then 'text/html' when 1 then '-' when 2 then '' when 3 then 'image/gif' when 4 then 'TEXT/PLAIN; charset=x' else 'text/htmlx' end"


@query(f"select o_orderkey as ord, m in ('', '-') or regexp_matches(m, '(?i)^(?:text/html|application/xhtml\\+xml|text/plain)\\b') as seeds_page from (select o_orderkey, {MIME} as m from orders)")
def capture_seed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), C.seeds_a_page(F.expr(MIME)).alias("seeds_page"))


CHOSEN = "capture_key, timestamp, length, digest, ord, considered, has_good = 0 as from_excluded"


def chosen_columns(df: DataFrame) -> DataFrame:
    return df.select("capture_key", "timestamp", "length", "digest", "ord", "considered", "from_excluded")


@query(f"""
with {CAPTURE} select {CHOSEN} from (
  select *, count(*) over (partition by capture_key) as considered,
    row_number() over (partition by capture_key order by abs(moment - t), coalesce(length, -1) desc, timestamp desc, ord) as n
  from pool, target) where n = 1
""")
def select_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_columns(C.select_captures(captures(spark, sf_dir), target=T.selection_target(None, TARGET)))


@query(f"""
with {CAPTURE} select {CHOSEN} from (
  select *, count(*) over (partition by capture_key) as considered, row_number() over (partition by capture_key order by timestamp desc, ord) as n from pool) where n = 1
""")
def select_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_columns(C.select_captures(captures(spark, sf_dir)))


@query(f"""
with {CAPTURE}, early as (select *, count(*) over (partition by capture_key) as considered, min(moment) over (partition by capture_key) as first_at from pool)
select {CHOSEN} from (
  select *, row_number() over (partition by capture_key order by coalesce(length, -1) desc, timestamp, ord) as n from early where moment - first_at <= 90 * 86400) where n = 1
""")
def select_earliest_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_columns(C.select_captures(captures(spark, sf_dir), policy=C.EARLIEST_LARGEST, cluster_days=90))


@query(f"""
with {CAPTURE} select capture_key, timestamp, status_code, considered from (
  select *, count(*) over (partition by capture_key) as considered,
    row_number() over (partition by capture_key order by abs(moment - t), coalesce(length, -1) desc, timestamp desc, ord) as n
  from pool, target) where n = 1 and has_good = 0
""")
def select_excluded_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = C.select_captures(captures(spark, sf_dir), target=T.selection_target(None, TARGET))
    return chosen.where("from_excluded").select("capture_key", "timestamp", "status_code", "considered")


@query(f"""
with {CAPTURE}, ranked as (
  select *, row_number() over (partition by capture_key order by abs(moment - t), coalesce(length, -1) desc, timestamp desc, ord) as n from pool, target
), used as (select capture_key, timestamp from ranked where n = 1
), rest as (
  select c.* from capture c anti join used u on c.capture_key = u.capture_key and c.timestamp = u.timestamp
), good as (select *, max(case when excluded_by is null then 1 else 0 end) over (partition by capture_key) as has_good from rest)
select capture_key, timestamp, ord from (
  select *, row_number() over (partition by capture_key order by abs(moment - t), coalesce(length, -1) desc, timestamp desc, ord) as n
  from good, target where excluded_by is null or has_good = 0) where n = 1
""")
def select_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, target = captures(spark, sf_dir), T.selection_target(None, TARGET)
    used = C.select_captures(known, target=target)
    return C.select_captures(C.unused_captures(known, used), target=target).select("capture_key", "timestamp", "ord")


@query("""
with p as (select o_orderkey as ord, substr(strftime(o_orderdate, '%Y%m%d%H%M%S'), 1, cast(3 + o_orderkey % 12 as int)) as prefix from orders),
q as (select *, length(prefix) as n, case when length(prefix) >= 6 then substr(prefix, 5, 2) else '12' end as m from p)
select ord, prefix,
  case when n < 4 or n = 14 then prefix else substr(prefix, 1, 4) || case when n >= 6 then substr(prefix, 5, 2) else '01' end || case when n >= 8 then substr(prefix, 7, 2) else '01' end
    || case when n >= 10 then substr(prefix, 9, 2) else '00' end || case when n >= 12 then substr(prefix, 11, 2) else '00' end || '00' end as first_instant,
  case when n < 4 or n = 14 then prefix else substr(prefix, 1, 4) || m
    || case when n >= 8 then substr(prefix, 7, 2) else strftime(last_day(make_date(cast(substr(prefix, 1, 4) as int), cast(m as int), 1)), '%d') end
    || case when n >= 10 then substr(prefix, 9, 2) else '23' end || case when n >= 12 then substr(prefix, 11, 2) else '59' end || '59' end as last_instant
from q
""")
def expand_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.date_format("o_orderdate", "yyyyMMddHHmmss")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.substring(ts, F.lit(1), (F.lit(3) + F.col("o_orderkey") % 12).cast("int")).alias("prefix"))
    return rows.select("ord", "prefix", T.expand_timestamp(F.col("prefix"), "start").alias("first_instant"), T.expand_timestamp(F.col("prefix"), "end").alias("last_instant"))


@query("""
select l_orderkey, l_linenumber, abs(cast(epoch(l_shipdate) as bigint) - cast(epoch(o_orderdate) as bigint)) as distance_seconds,
  strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.000Z') as shipped_iso
from lineitem join orders on l_orderkey = o_orderkey
""")
def capture_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = lambda c: F.date_format(c, "yyyyMMddHHmmss")
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.select("l_orderkey", "l_linenumber", T.distance_seconds(stamp("l_shipdate"), stamp("o_orderdate")).alias("distance_seconds"), T.iso_timestamp(stamp("l_shipdate")).alias("shipped_iso"))


@query("""
select o_orderkey as ord, strftime(o_orderdate, '%Y%m%d%H%M%S') as served,
  case when o_orderkey % 3 = 0 then 120 else greatest(0, cast(epoch(o_orderdate) as bigint) - cast(epoch(timestamp '1995-06-01 00:00:00') as bigint)) end as wait_seconds,
  case when o_orderkey < 86400 then o_orderkey || 's' else printf('%.1fd', o_orderkey / 86400.0::double) end as shown
from orders
""")
def served_and_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.concat(F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    retry = F.when(F.col("o_orderkey") % 3 == 0, "120").otherwise(header)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), T.served_timestamp(header, F.lit("")).alias("served"), T.retry_after_seconds(retry, F.lit(801964800).cast("long")).alias("wait_seconds"), T.format_days(F.col("o_orderkey"), quarter="2").alias("shown"))


@query(f"""
with {CAPTURE} select capture_key, timestamp, digest, ord from (
  select *, lag(digest) over (partition by capture_key order by timestamp, ord) as b from capture) where b is null or b <> digest
""")
def collapse_adjacent_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.collapse_adjacent(captures(spark, sf_dir)).select("capture_key", "timestamp", "digest", "ord")


@query(f"with {CAPTURE} select capture_key, digest, min(ord) over (partition by capture_key, digest) as first_seen, ord, timestamp from capture")
def distinct_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.distinct_digests(captures(spark, sf_dir))


@query(f"with {CAPTURE} select capture_key, count(distinct digest) as digests from capture group by capture_key having count(distinct digest) > 1")
def content_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.content_drift(captures(spark, sf_dir))


@query(f"""
with {CAPTURE}, c as (
  select * from (select *, count(*) over (partition by capture_key) as n, row_number() over (partition by capture_key order by abs(moment - t), coalesce(length, -1) desc, timestamp desc, ord) as r from pool, target) where r = 1
), chosen as (
  select k.capture_key, k.timestamp, min(k.ord) as ord from capture k join c on k.capture_key = c.capture_key and k.timestamp = c.timestamp group by all
), base as (select h.capture_key, k.digest, k.moment, h.ord from chosen h join capture k on k.capture_key = h.capture_key and k.ord = h.ord
), near as (
  select * from (select k.capture_key, k.timestamp, k.digest, abs(k.moment - b.moment) as away, row_number() over (partition by k.capture_key order by abs(k.moment - b.moment), k.ord) as r
    from capture k join base b on k.capture_key = b.capture_key and k.ord <> b.ord) where r = 1
), sizes as (select capture_key, count(*) as capture_count from capture group by capture_key)
select b.capture_key, s.capture_count, case when n.digest is null then 'single-capture' when n.digest = b.digest then 'identical' else 'different' end as state,
  n.timestamp as compared_timestamp, coalesce(n.away, -1) as distance_seconds, false as stand_in
from base b join sizes s on s.capture_key = b.capture_key left join near n on n.capture_key = b.capture_key
""")
def cross_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = captures(spark, sf_dir)
    chosen = C.select_captures(known, target=T.selection_target(None, TARGET)).select("capture_key", F.col("timestamp").alias("chosen_timestamp"))
    return C.cross_capture(known, chosen).withColumn("distance_seconds", F.coalesce("distance_seconds", F.lit(-1).cast("long")))


DEPENDENCY = "dep as (select distinct l_orderkey * 10 + l_linenumber as dep_id, o_custkey as capture_key, strftime(l_shipdate, '%Y%m%d%H%M%S') as referring_timestamp, cast(epoch(l_shipdate) as bigint) as t from lineitem join orders on l_orderkey = o_orderkey)"
ASSETS = f"""
with {CAPTURE.replace(", target as (select cast(epoch(timestamp '1995-12-31 23:59:59') as bigint) as t)", "")}, {DEPENDENCY}, asset as (
  select * from (
    select d.dep_id, d.capture_key, d.referring_timestamp, p.timestamp as resolved_timestamp, abs(p.moment - d.t) as delta_seconds, count(*) over (partition by d.dep_id, d.referring_timestamp) as considered,
      row_number() over (partition by d.dep_id, d.referring_timestamp order by abs(p.moment - d.t), coalesce(p.length, -1) desc, p.timestamp desc, p.ord) as n
    from dep d join pool p on p.capture_key = d.capture_key) where n = 1)
"""


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    wanted = met.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("dep_id"), F.col("o_custkey").alias("capture_key"), F.date_format("l_shipdate", "yyyyMMddHHmmss").alias("referring_timestamp")).distinct()
    return C.resolve_assets(wanted, captures(spark, sf_dir))


@query(ASSETS + "select dep_id, capture_key, referring_timestamp, resolved_timestamp, delta_seconds, delta_seconds > 365 * 86400 as temporally_distant, considered from asset")
def asset_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets(spark, sf_dir)


@query(ASSETS + "select capture_key, count(*) as n from asset where delta_seconds > 365 * 86400 group by capture_key")
def temporally_distant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets(spark, sf_dir).where("temporally_distant").groupBy("capture_key").agg(F.count(F.lit(1)).alias("n"))


@query(ASSETS + """select capture_key, count(*) as assets,
  floor(sum(case when dep_id % 7 = 0 then 0 when dep_id % 5 = 0 then 25 when delta_seconds > 365 * 86400 then 60 else 100 end) / count(*)) as credit_hundredths from asset group by capture_key""")
def asset_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    credit = asset_credit(F.col("dep_id") % 7 != 0, F.col("dep_id") % 5 != 0, F.col("temporally_distant"))
    return assets(spark, sf_dir).groupBy("capture_key").agg(F.count(F.lit(1)).alias("assets"), F.floor(F.sum(F.round(credit * 100)) / F.count(F.lit(1))).cast("double").alias("credit_hundredths"))


@query("select distinct c_custkey * 2 as capture_key from customer anti join orders on c_custkey * 2 = o_custkey")
def asset_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.absent_keys(table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("capture_key")), captures(spark, sf_dir))


@query("""
with s as (select o_orderkey as ord, strftime(o_orderdate, '%Y%m%d%H%M%S') as timestamp, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') as iso, (o_orderkey * 2 + 1) * 37 % 500000 as away from orders)
select ord, iso, case when away < 86400 then away || 's' else printf('%.1fd', away / 86400.0) end as away from s
""")
def iso_and_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("timestamp"))
    return o.select("ord", T.iso_timestamp(F.col("timestamp")).alias("iso"), T.format_days((F.col("ord") * 2 + 1) * 37 % 500000, quarter="2").alias("away"))


@query(f"""
with {CAPTURE}, twice as (select * from capture union all select * replace (ord + 100000000 as ord) from capture where ord % 2 = 0)
select capture_key, timestamp, min(ord) as ord from twice group by capture_key, timestamp
""")
def lookup_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = captures(spark, sf_dir)
    again = known.where("ord % 2 = 0").withColumn("ord", F.col("ord") + 100000000)
    return C.first_of_timestamp(known.unionByName(again)).select("capture_key", "timestamp", "ord")
