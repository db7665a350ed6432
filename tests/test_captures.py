"""Selection, filters, history and timestamps on small literal tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from relictum.functions import time as T
from relictum.operators import captures as C

SCHEMA = "capture_key string, timestamp string, length long, digest string, ord long, excluded_by string"
KNOWN = [("u", "19980112000000", 4200, "A", 0, None), ("u", "19980220000000", 9100, "B", 1, None), ("u", "19981101000000", 6000, "B", 2, None), ("u", "19991220000000", 800, "C", 3, None)]


def pick(spark, rows, **options):
    found = C.select_captures(spark.createDataFrame(rows, SCHEMA), **options).collect()
    return found[0] if found else None


@pytest.mark.parametrize("options,expected", [
    ({"target": "1999"}, "19991220000000"),
    ({}, "19991220000000"),
    ({"policy": C.EARLIEST_LARGEST, "cluster_days": 90}, "19980220000000"),
    ({"policy": C.EARLIEST_LARGEST, "cluster_days": 400}, "19980220000000"),
])
def test_policies(spark, options, expected):
    if "target" in options:
        options = {"target": T.selection_target(None, options["target"])}
    assert pick(spark, KNOWN, **options).timestamp == expected


def test_second_choice(spark):
    known = spark.createDataFrame(KNOWN, SCHEMA)
    target = T.selection_target(None, "1999")
    used = C.select_captures(known, target=target)
    assert C.select_captures(C.unused_captures(known, used), target=target).first().timestamp == "19981101000000"


def test_ties(spark):
    at = "19990101000000"
    rows = [("u", at, None, "A", 0, None), ("u", at, 5, "B", 1, None), ("u", at, 5, "C", 2, None)]
    assert pick(spark, rows, target=F.lit("19990601000000")).ord == 1
    assert pick(spark, rows).ord == 0
    assert pick(spark, rows, policy=C.EARLIEST_LARGEST).ord == 1
    two = [("u", "19990101000000", 5, "A", 0, None), ("u", "19990103000000", 5, "B", 1, None)]
    assert pick(spark, two, target=F.lit("19990102000000")).timestamp == "19990103000000"


def test_excluded_captures(spark):
    rows = [("u", "19990101000000", 5, "A", 0, "statuscode:200"), ("u", "20050101000000", 1, "B", 1, None)]
    got = pick(spark, rows, target=F.lit("19990101000000"))
    assert got.timestamp == "20050101000000" and not got.from_excluded and got.considered == 1
    got = pick(spark, rows[:1], target=F.lit("19990101000000"))
    assert got.from_excluded and got.considered == 1
    assert pick(spark, [("u", "not-a-timestamp", 5, "A", 0, None)]) is None


def test_no_capture_has_an_instant(spark):
    rows = [("u", "19999999999999", 1, "A", 0, None), ("u", "19998888888888", 9, "B", 1, None)]
    assert pick(spark, rows, target=F.lit("19990101000000")).ord == 0


@pytest.mark.parametrize("prefix,edge,expected", [
    ("1999", "start", "19990101000000"), ("1999", "end", "19991231235959"), ("199902", "end", "19990228235959"), ("200002", "end", "20000229235959"), ("190002", "end", "19000228235959"),
    ("19990315120000", "end", "19990315120000"), ("1999031512000", "start", "19990315120000"), ("19990", "start", "19990101000000"), ("199913", "end", "19991331235959"), ("abc", "start", "abc"), ("123", "end", "123"), ("", "end", ""),
])
def test_expansion(spark, prefix, edge, expected):
    assert spark.createDataFrame([(prefix,)], "t string").select(T.expand_timestamp(F.col("t"), edge)).first()[0] == expected


@pytest.mark.parametrize("ts,seconds", [("19700101000001", 1), ("20000229000000", 951782400), ("19990229000000", None), ("19990231000000", None), ("1999", None), ("19991301000000", None), ("19990101006100", None), (None, None)])
def test_epochs(spark, ts, seconds):
    assert spark.createDataFrame([(ts,)], "t string").select(T.epoch_seconds(F.col("t"))).first()[0] == seconds


def test_headers(spark):
    row = spark.range(1).select(T.http_date(F.lit("Mon, 01 Mar 1999 12:00:05 GMT")), T.http_date(F.lit("yesterday")), T.retry_after_seconds(F.lit(" 30 "), F.lit(0)), T.retry_after_seconds(F.lit("Thu, 01 Jan 1970 00:01:00 GMT"), F.lit(100)), T.retry_after_seconds(F.lit("soon"), F.lit(0)), T.format_days(F.lit(86399)), T.format_days(F.lit(129600))).first()
    assert list(row) == ["19990301120005", None, 30, 0, None, "86399s", "1.5d"]


def test_filters(spark):
    rows = spark.createDataFrame([("200",), ("2000",), ("404",), (None,)], "statuscode string")
    tagged = lambda *f: [r.excluded_by for r in C.tag_exclusions(rows, f).collect()]
    assert tagged("statuscode:200") == [None, "statuscode:200", "statuscode:200", "statuscode:200"]
    assert tagged("!statuscode:4..", "statuscode:2.*") == [None, None, "!statuscode:4..", "statuscode:2.*"]
    assert tagged() == [None] * 4
    for wrong in ("nonsense", "colour:red", ":x"):
        with pytest.raises(ValueError):
            C.CandidateFilter.parse(wrong)


def test_index_rows(spark):
    rows = spark.createDataFrame([("k", "1999", "http://a/", "", "200", "", " 12kb"), ("k", "", "http://a/", "x", "200", "D", "x"), ("k", "1999", "", "x", "200", "D", "5")], ", ".join(f"{c} string" for c in C.FIELDS))
    got = C.as_candidates(rows).collect()
    assert len(got) == 1 and (got[0].digest, got[0].mimetype, got[0].length) == (None, None, 12)


@pytest.mark.parametrize("digests,chosen,state", [(["A"], "19980112000000", "single-capture"), (["A", "A"], "19980112000000", "identical"), (["A", "B"], "19980112000000", "different"), (["A", ""], "19980112000000", "digest-unavailable"), (["A", "A"], "20200101000000", "identical")])
def test_agreement(spark, digests, chosen, state):
    known = spark.createDataFrame([("u", KNOWN[i][1], 1, d, i, None) for i, d in enumerate(digests)], SCHEMA)
    got = C.cross_capture(known, spark.createDataFrame([("u", chosen)], "capture_key string, chosen_timestamp string")).first()
    assert got.state == state and got.stand_in == chosen.startswith("2020")


def test_assets(spark):
    known = [("both", "19990101000000", 1, "A", 0, None), ("both", "19990401000000", 1, "A", 1, None), ("drift", "19990201000000", 1, "A", 2, None), ("drift", "20030101000000", 1, "B", 3, None), ("late", "20010601000000", 1, "A", 4, None), ("hidden", "19990310000000", 1, "A", 5, "statuscode:200"), ("hidden", "19980101000000", 1, "B", 6, None)]
    wanted = spark.createDataFrame([(i, k, "19990310000000") for i, k in enumerate(("both", "drift", "late", "ghost", "hidden"))] + [(9, "both", None)], "dep_id int, capture_key string, referring_timestamp string")
    got = {r.dep_id: r for r in C.resolve_assets(wanted, spark.createDataFrame(known, SCHEMA)).collect()}
    assert got[0].resolved_timestamp == "19990401000000" and got[0].delta_seconds == 22 * 86400 and not got[0].temporally_distant
    assert got[1].resolved_timestamp == "19990201000000" and got[1].delta_seconds == 37 * 86400
    assert got[2].temporally_distant and got[3].resolved_timestamp is None and got[3].considered == 0
    assert got[4].resolved_timestamp == "19980101000000" and got[4].considered == 1
    assert got[9].resolved_timestamp == "19990401000000" and got[9].delta_seconds is None
