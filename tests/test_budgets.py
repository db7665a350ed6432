"""What stops a run: pages of the index, of lookups, requests and further tries, each charged; guards on every hop; scans that go on."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from relictum.config import parse_project
from relictum.functions.address import block_table, blocked_address_reason, blocked_addresses
from relictum.operators.captures import FIELDS
from relictum.plans.acquire import Run
from relictum.sources.cdx import page_rows
from relictum.sources.index_stream import recorded_pages, scan_index, scan_offset

SITE = "http://a.example/"
T = "19990601000000"
ANSWER = "original_url string, timestamp string, http_status int, content_type string, location string, body binary"
PARKED, REAL = b"<p>this domain is for sale</p>", b"<title>t</title><p>words</p>"


def row(name: str, ts: str = T, mime: str = "text/html") -> list[str]:
    return ["", ts, SITE + name, mime, "200", name + ts, "9"]


def project(**more):
    said = {"projectId": "site", "scope": {"url": "a.example", "from": "1999", "to": "1999"}, "provider": {"allowedHosts": ["web.archive.org"], "minRequestIntervalMs": 1}}
    return parse_project(json.dumps(said | more))


def execute(spark, path, rows, answers, *, lookups=None, previous=None, addresses=None, pages=None, **more):
    index = spark.createDataFrame(pages or [(0, json.dumps([list(FIELDS), *rows]))], "page_ord long, body string")
    run = Run(spark, project(**more), f"file://{path}", addresses=addresses)
    return run.execute(index, spark.createDataFrame(answers, ANSWER), lookups=lookups, previous=previous), run


def named(tables) -> dict:
    return {r.original_url.removeprefix(SITE): r for r in tables["items"].collect()}


STAMPS = ("19991201000000", "19990901000000", "19990601000000", "19990301000000")


@pytest.fixture(scope="module")
def parked_pages():
    rows = [row(n, t) for n in "ab" for t in STAMPS]
    answers = [(SITE + n, t, 200, "text/html", None, PARKED) for n in "ab" for t in STAMPS[:3]]
    return rows, [a for a in answers if a[:2] != (SITE + "b", STAMPS[2])] + [(SITE + "b", STAMPS[2], 200, "text/html", None, REAL)]


def test_tries_are_charged_and_stop_the_run(spark, tmp_path, parked_pages):
    """One page of the index, two first tries, then tries in rounds: a and b, a and b again. Five requests end before a's second try;
    a resumed run makes that try, and b's, and nothing anew."""
    first, run = execute(spark, tmp_path / "1", *parked_pages, budgets={"maxRequests": 5})
    shown = lambda got: {n: (r.requested_ts[4:8], r.outcome, r.reselection.stop, len(r.reselection.attempts)) for n, r in got.items()}
    assert (run.spent.made, run.spent.index_requests) == (5, 1)
    assert shown(named(first)) == {"a": ("0901", "parked-domain", "budget-exhausted", 2), "b": ("0901", "parked-domain", None, 2)}
    second, again = execute(spark, tmp_path / "2", *parked_pages, previous=first, budgets={"maxRequests": 40})
    got = named(second)
    assert shown(got) == {"a": ("0601", "parked-domain", "attempt-limit", 3), "b": ("0601", "ok", "ok", 3)} and again.spent.made == 7
    assert got["a"].reselection_trail == "19991201000000=parked-domain, 19990901000000=parked-domain, 19990601000000=parked-domain"


def test_a_new_capture_brings_its_own_dependencies(spark, tmp_path):
    rows = [row("a", STAMPS[0]), row("a", STAMPS[1]), row("x.gif", mime="image/gif")]
    answers = [(SITE + "a", STAMPS[0], 200, "text/html", None, PARKED), (SITE + "a", STAMPS[1], 200, "text/html", None, b"<title>t</title><p>words</p><img src=/x.gif>"), (SITE + "x.gif", T, 200, "image/gif", None, b"GIF89a")]
    got = named(execute(spark, tmp_path, rows, answers)[0])
    assert got["x.gif"].status == "fetched" and got["x.gif"].referrer == SITE + "a" and got["a"].requested_ts == STAMPS[1]


IMAGES = ("one.gif", "two.gif", "three.gif")


def lookup_pages(spark, name: str, n: int, last_key: bool = False):
    rows = [(SITE + name, p, json.dumps([list(FIELDS), *[row(name, f"199{p}0{1 + k // 28}{1 + k % 28:02}000000", "image/gif") for k in range(3)], *([[], [f"k{p}"]] if p + 1 < n or last_key else [])])) for p in range(n)]
    return spark.createDataFrame(rows, "original_url string, page int, body string")


@pytest.fixture(scope="module")
def gallery(spark):
    rows = [row("")]
    answers = [(SITE, T, 200, "text/html", None, b"<title>t</title>" + b"".join(b"<img src=/%s>" % i.encode() for i in IMAGES))]
    answers += [(SITE + i, f"199{p}010{1 + k}000000", 200, "image/gif", None, b"GIF89a") for i in IMAGES for p in range(9) for k in range(3)]
    lookups = lookup_pages(spark, "one.gif", 2).union(lookup_pages(spark, "two.gif", 3)).union(lookup_pages(spark, "three.gif", 1, last_key=True))
    return rows, answers, lookups


def test_lookups_are_charged_page_by_page(spark, tmp_path, gallery):
    """One page of the index, two of the first lookup, three of the second, one of the third and one that failed. Four index requests
    end after a page of the second lookup, which counts as its answer; the third is asked by a resumed run."""
    rows, answers, lookups = gallery
    parked, near = ("unattempted", 0, None), lambda page: f"199{page}0103000000"
    shown = lambda got: [(got[i].status, got[i].index_requests, got[i].requested_ts) for i in IMAGES]
    first, run = execute(spark, tmp_path / "1", rows, answers, lookups=lookups, budgets={"maxIndexRequests": 4})
    got = named(first)
    assert run.spent.index_requests == 4 == 1 + sum(r.index_requests for r in got.values())
    assert shown(got) == [("fetched", 2, near(1)), ("fetched", 1, near(0)), parked]
    assert {(r.capture_key.removeprefix(SITE), r.timestamp[:4]) for r in first["captures"].collect()} == {("", "1999"), ("one.gif", "1990"), ("one.gif", "1991"), ("two.gif", "1990")}
    assert got["two.gif"].resolution_detail.endswith("the index-requests budget stopped the capture lookup after 1 page(s); later captures were not retrieved")
    second, run = execute(spark, tmp_path / "2", rows, answers, lookups=lookups, previous=first, budgets={"maxIndexRequests": 20})
    got = named(second)
    assert shown(got) == [("fetched", 2, near(1)), ("fetched", 1, near(0)), ("fetched", 2, near(0))] and run.spent.index_requests == 6
    assert got["three.gif"].resolution_detail.endswith("a later page of the capture lookup failed after 1 page(s)") and "lookup" not in got["one.gif"].resolution_detail


def test_index_pages_are_charged(spark, tmp_path):
    pages = [(p, json.dumps([list(FIELDS), row(f"p{p}"), *([[], [f"k{p}"]] if p < 3 else [])])) for p in range(4)]
    answers = [(SITE + f"p{p}", T, 200, "text/html", None, REAL) for p in range(4)]
    first, run = execute(spark, tmp_path / "1", [], answers, pages=pages, budgets={"maxIndexRequests": 2})
    assert set(named(first)) == {"p0", "p1"} and run.spent.index_requests == 2 and first["runs"].first().continued
    second, run = execute(spark, tmp_path / "2", [], answers, pages=pages, previous=first, budgets={"maxIndexRequests": 9})
    got = named(second)
    assert set(got) == {"p0", "p1", "p2", "p3"} and all(r.status == "fetched" for r in got.values()) and run.spent.index_requests == 4 and not second["runs"].first().continued


def test_bodies_of_refused_items_are_not_read(spark, tmp_path):
    rows = [row(f"p{p}") for p in range(6)]
    answers = [(SITE + f"p{p}", T, 200, "text/html", None, REAL + b"%d" % p) for p in range(6)]
    tables, run = execute(spark, tmp_path, rows, answers, budgets={"maxRequests": 4})
    assert run.spent.made == 4 and tables["bodies"].count() == 3
    read = max(tmp_path.glob("*-fetched0"))
    assert spark.read.parquet(f"file://{read}").where("body is not null").count() == 3


HOPS = {
    "port.gif": f"https://web.archive.org:8080/web/{T}id_/{SITE}x", "user.gif": f"https://u:p@web.archive.org/web/{T}id_/{SITE}x", "ftp.gif": f"ftp://web.archive.org/web/{T}id_/{SITE}x",
    "host.gif": f"https://evil.example/web/{T}id_/{SITE}x", "number.gif": f"http://[::1]/web/{T}id_/{SITE}x", "inside.gif": f"https://in.web.archive.org/web/{T}id_/{SITE}x",
    "unknown.gif": f"https://no.web.archive.org/web/{T}id_/{SITE}x", "live.gif": "https://web.archive.org/about", "fine.gif": f"/web/{T}id_/{SITE}x",
}


def test_every_hop_is_guarded(spark, tmp_path):
    rows = [row(""), *[row(n, mime="image/gif") for n in (*HOPS, "x")]]
    answers = [(SITE, T, 200, "text/html", None, b"<title>t</title>" + b"".join(b"<img src=/%s>" % n.encode() for n in HOPS))]
    answers += [(SITE + n, T, 302, None, to, None) for n, to in HOPS.items()] + [(SITE + "x", T, 200, "image/gif", None, b"GIF89a")]
    addresses = spark.createDataFrame([("web.archive.org", 0, "207.241.237.3"), ("IN.web.archive.org", 0, "207.241.237.3"), ("in.web.archive.org", 1, "10.0.0.7"), ("in.web.archive.org", 2, "::1")], "host string, ord int, address string")
    got = named(execute(spark, tmp_path / "run", rows, answers, addresses=addresses)[0])
    said = {n: (got[n].failure.kind, got[n].failure.message) if got[n].failure else None for n in HOPS}
    assert {k for k, v in said.items() if v is None} == {"fine.gif"} and {v[0] for v in said.values() if v} == {"destination-refused"}
    assert [said[n][1] for n in ("port.gif", "user.gif", "ftp.gif", "host.gif")] == ["port 8080 is not in the allowed set", "URL carries embedded credentials", "scheme ftp: is not http or https", "host evil.example is not an allowed provider host"]
    assert said["inside.gif"][1] == "in.web.archive.org resolves to 10.0.0.7, which is private 10.0.0.0/8" and said["unknown.gif"][1] == "cannot resolve no.web.archive.org: no address is recorded"
    assert said["live.gif"][1].endswith("is no capture")
    private = spark.createDataFrame([("web.archive.org", 0, "192.168.0.1")], "host string, ord int, address string")
    assert Run(spark, project(), f"file://{tmp_path}/private", addresses=private).endpoint_refusal == "web.archive.org resolves to 192.168.0.1, which is private 192.168.0.0/16"
    assert Run(spark, project(), f"file://{tmp_path}/none").endpoint_refusal is None


def test_blocks_agree_with_literal_reasons(spark):
    import random

    r = random.Random(9)
    four = [f"{a}.{b}.{c}.{d}" for a in (0, 10, 100, 127, 169, 172, 192, 198, 203, 223, 224, 255) for b in (0, 15, 16, 31, 32, 63, 64, 127, 128, 168, 254) for c, d in ((0, 1), (1, 255))]
    groups = lambda: ":".join(f"{r.choice((0, 1, 0xfc00, 0xfdff, 0xfe00, 0xfe80, 0xfebf, 0xfec0, 0xff00, 0x64, 0xff9b, 0x2001)):x}" for _ in range(8))
    six = [groups() for _ in range(300)] + ["::", "::1", "::2", "1::", "64:ff9b::1.2.3.4", "::ffff:10.0.0.1", "::FFFF:0a00:1", "fe80::1%eth0", "::1.2.3.4"]
    bad = ["", "x", "1.2.3", "1.2.3.4.5", "300.1.1.1", "1::2::3", "12345::", ":::"]
    df = spark.createDataFrame([(a,) for a in [*four, *six, None]], "address string")
    got = {x.address: x.reason for x in blocked_addresses(df, block_table(spark)).collect()}
    want = {x.address: x.reason for x in df.select("address", blocked_address_reason(F.col("address")).alias("reason")).collect()}
    assert got == want | {None: "not an IP address"}
    wrong = blocked_addresses(spark.createDataFrame([(a,) for a in bad], "address string"), block_table(spark)).collect()
    assert {x.reason for x in wrong} == {"not an IP address"}
    assert "NestedLoop" not in blocked_addresses(df, block_table(spark))._jdf.queryExecution().toString()


def test_longer_blocks_win(spark):
    blocks = block_table(spark, (("10.0.0.0/8", "eight"), ("10.1.0.0/16", "sixteen"), ("10.1.2.3/32", "one"), ("::/0", "all")))
    got = {x.address: x.reason for x in blocked_addresses(spark.createDataFrame([(a,) for a in ("10.9.9.9", "10.1.9.9", "10.1.2.3", "9.9.9.9")], "address string"), blocks).collect()}
    assert got == {"10.9.9.9": "eight", "10.1.9.9": "sixteen", "10.1.2.3": "one", "9.9.9.9": "all"}


# the index as a stream


@pytest.fixture
def recorded(spark, tmp_path):
    pages = [("" if p == 0 else f"k{p}", json.dumps([list(FIELDS), *[row(f"p{p}-{i}") for i in range(3)], *([[], [f"k{p + 1}"]] if p < 4 else [])])) for p in range(5)]
    spark.createDataFrame(pages, "resume_key string, body string").write.parquet(f"file://{tmp_path}/recorded")
    return recorded_pages(f"file://{tmp_path}/recorded")


def test_a_scan_goes_on_from_its_key(spark, tmp_path, recorded):
    path = f"file://{tmp_path}/scan"
    pages, at = scan_index(spark, recorded, path, limit=3, most=2)
    assert pages.count() == 2 and (at["key"], at["state"], at["requests"]) == ("k2", "open", 2) and scan_offset(spark, path) == at
    pages, at = scan_index(spark, recorded, path, limit=3, most=9, enough=lambda p: p.count() >= 3)
    assert pages.count() == 3 and at["requests"] == 3
    pages, at = scan_index(spark, recorded, path, limit=3, most=9)
    assert (at["state"], at["requests"]) == ("complete", 5) and [r.page_ord for r in pages.orderBy("page_ord").collect()] == list(range(5)) and page_rows(pages).count() == 15
    again, _ = scan_index(spark, recorded, path, limit=3, most=9)
    assert again.count() == 5


def test_a_scan_that_dies_writes_no_page_twice(spark, tmp_path, recorded):
    """The third batch is planned and its files may be there, but it was never committed."""
    path = f"file://{tmp_path}/scan"
    scan_index(spark, recorded, path, limit=3, most=3)
    for name in ("2", ".2.crc"):
        (tmp_path / "scan" / "checkpoint" / "commits" / name).unlink()
    assert scan_offset(spark, path)["requests"] == 2
    pages, at = scan_index(spark, recorded, path, limit=3, most=9)
    assert sorted(r.page_ord for r in pages.collect()) == list(range(5)) and at["state"] == "complete"


def test_a_request_that_fails_is_charged_and_made_again_later(spark, tmp_path, recorded):
    path = f"file://{tmp_path}/scan"
    pages, at = scan_index(spark, lambda k: None if k == "k2" else recorded(k), path, limit=3, most=9)
    assert (at["state"], at["requests"], at["page"]) == ("failed", 3, 2) and [r.body is None for r in pages.orderBy("page_ord").collect()] == [False, False, True]
    pages, at = scan_index(spark, recorded, path, limit=3, most=9)
    assert pages.where("body is null").count() == 0 and pages.count() == 5 and at["requests"] == 6


def test_a_run_scans_what_it_wants(spark, tmp_path, recorded):
    run = Run(spark, project(budgets={"maxPages": 4}), f"file://{tmp_path}/run")
    pages = run.scan(recorded, f"file://{tmp_path}/scan")
    assert pages.count() == 2  # six pages of the site; four are wanted
    assert run.charged_index(pages)[0].count() == 2 and run.spent.index_requests == 2
