"""Whole acquisitions: every way a request ends, budgets, lookups, long chains, every kind of gap, going on after a stop."""

from __future__ import annotations

import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from relictum.catalog.registry import cut
from relictum.config import parse_project
from relictum.operators import acquisition as A
from relictum.operators import captures as C
from relictum.operators import evidence as V
from relictum.operators.captures import FIELDS
from relictum.plans.acquire import Run

SITE = "http://a.example/"
T = "19990601000000"
PROJECT = {"projectId": "site", "scope": {"url": "a.example", "from": "1999", "to": "1999", "seedUrls": [SITE + "seeded"]}, "provider": {"allowedHosts": ["web.archive.org"], "minRequestIntervalMs": 1}, "budgets": {"maxRequests": 30}, "outcomeReselection": {"maxAttempts": 1}}
IMAGES = ("logo.gif", "far.gif", "moved.gif", "loop.gif", "evil.gif", "busy.gif", "slow.gif", "ghost.gif", "found.gif")
INDEX_PAGES = 2
FRAMES = 5
WORDS = "Words that fill a page about some subject or other. "


def page(*parts: str, title: str = "A page") -> bytes:
    return f"<html><title>{title}</title><body><p>{WORDS * 12}</p>{''.join(parts)}</body></html>".encode()


def capture(name: str, ts: str = T, mime: str = "text/html", status: str = "200", digest: str = "D") -> list[str]:
    return ["", ts, SITE + name, mime, status, digest + name, "100"]


def site(spark):
    index = [list(FIELDS)]
    responses = []

    def add(name: str, body: bytes | None, ts: str = T, mime: str = "text/html", status: int | None = 200, location: str | None = None, call: int = 0, memento: str | None = None, truncated: bool = False):
        responses.append((SITE + name, ts, call, status, mime, location, memento, truncated, body))

    for name in ("", "injected", "broken", "long", "parked", "stub", "era"):
        index.append(capture(name))
    index += [capture("gone", status="404"), capture("parked", "19990301000000", digest="P")]
    add("", page(*(f"<img src=/{i}>" for i in IMAGES), "<frame src=/frame0>", "<a href=/unlisted>no</a>"))
    add("injected", page("<!-- BEGIN WAYBACK TOOLBAR INSERT --><p>bar</p><!-- END WAYBACK TOOLBAR INSERT -->"))
    add("broken", page() + b"\xff\xfe\xff" * 60, mime="text/html; charset=shift_jis")
    add("long", page(), truncated=True)
    add("parked", b"<p>this domain is for sale</p>")
    add("parked", b"<p>this domain is for sale</p>", "19990301000000")
    add("stub", b"<p>x</p>")
    add("era", page("<h2>Era</h2>"), memento="Sat, 01 Jan 2005 00:00:00 GMT")
    add("gone", page("<h2>Gone</h2>"))
    gif = b"GIF89a......"
    for name, ts in (("logo.gif", T), ("logo.gif", "20030101000000"), ("far.gif", "20030101000000"), ("moved.gif", T), ("loop.gif", T), ("evil.gif", T), ("busy.gif", T), ("slow.gif", T)):
        index.append(capture(name, ts, "image/gif", digest="1" if ts == T else "2"))
    add("logo.gif", gif, mime="image/gif")
    add("far.gif", gif, "20030101000000", "image/gif")
    add("moved.gif", None, status=302, location=f"/web/19990702000000im_/{SITE}moved.gif")
    add("moved.gif", gif, "19990702000000", "image/gif")
    add("loop.gif", None, status=301, location=f"https://web.archive.org/web/{T}/{SITE}loop.gif")
    add("evil.gif", None, status=302, location=f"http://evil.example/web/{T}/{SITE}x.gif")
    add("busy.gif", b"", status=429)
    add("slow.gif", b"", status=503)
    add("slow.gif", gif, mime="image/gif", call=1)
    add("found.gif", gif, "19981201000000", "image/gif")
    for i in range(FRAMES):
        index.append(capture(f"frame{i}", mime="application/pdf"))  # no seed: reached from the frame before it alone
        add(f"frame{i}", page(f"<h2>{i}</h2><frame src=/frame{i + 1}>" if i + 1 < FRAMES else "<h2>last</h2>"))
    first = index[:6]
    pages = spark.createDataFrame([(0, json.dumps(first)), (1, json.dumps([index[0], *index[6:], [], ["more"]]))], "page_ord long, body string")
    answers = spark.createDataFrame(responses, "original_url string, timestamp string, call int, http_status int, content_type string, location string, memento string, truncated boolean, body binary")
    lookups = spark.createDataFrame([(SITE + "found.gif", 0, json.dumps([list(FIELDS), capture("found.gif", "19981201000000", "image/gif")])), (SITE + "ghost.gif", 0, "[]")], "original_url string, page int, body string")
    return pages, answers, lookups


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('acquire')}"
    pages, answers, lookups = site(spark)
    project = parse_project(json.dumps(PROJECT))
    first = Run(spark, project, f"{path}/1")
    tables = first.execute(pages, answers, lookups=lookups)
    wide = dataclasses.replace(project, budgets=dataclasses.replace(project.budgets, max_requests=400))
    second = Run(spark, wide, f"{path}/2")
    return (tables, first), (second.execute(pages, answers, lookups=lookups, previous=tables), second)


def named(tables) -> dict:
    return {r.original_url.removeprefix(SITE): r for r in tables["items"].collect()}


def test_every_end_of_a_request(runs):
    got = named(runs[0][0])
    ends = {n: (r.status, r.failure.kind if r.failure else None, r.requests) for n, r in got.items()}
    assert {n: ends[n] for n in IMAGES} == {
        "logo.gif": ("fetched", None, 1), "far.gif": ("fetched", None, 1), "moved.gif": ("fetched", None, 2), "loop.gif": ("failed", "redirect-loop", 1), "evil.gif": ("failed", "destination-refused", 1),
        "busy.gif": ("failed", "provider-throttled", 3), "slow.gif": ("fetched", None, 2), "ghost.gif": ("skipped", None, 0), "found.gif": ("fetched", None, 1),
    }
    assert got["moved.gif"].served_ts == "19990702000000" and got["found.gif"].requested_ts == "19981201000000" and got["found.gif"].index_requests == got["ghost.gif"].index_requests == 1
    assert ends["seeded"] == ("failed", "transport-error", 3) and ends["long"][:2] == ("failed", "oversized-body") and "unlisted" not in ends


def test_a_budget_stops_the_list(runs):
    (tables, run), _ = runs
    items = sorted(tables["items"].collect(), key=lambda r: r.ord)
    parked = [r.status == "unattempted" for r in items]
    assert any(parked) and parked == sorted(parked) and all(r.unattempted_reason == "budget-exhausted" for r in items if r.status == "unattempted")
    assert INDEX_PAGES + sum(r.requests + r.index_requests for r in items) == run.spent.made <= 30
    assert tables["spend"].first().asDict() == dataclasses.asdict(run.spent)
    assert [r.ord for r in items] == list(range(len(items)))


def test_every_kind_of_gap(runs):
    kinds = {r.kind for r in runs[0][0]["gaps"].collect()}
    assert kinds == set(V.GAP_KINDS)
    unknown = runs[0][0]["gaps"].where(F.col("detail").contains("unknown") & (F.col("kind") != "low-fidelity"))
    assert unknown.count() == 0, unknown.collect()


def test_a_resumed_run_goes_on(runs):
    (first, _), (second, run) = runs
    before, after = named(first), named(second)
    assert set(before) <= set(after) and not [n for n, r in after.items() if r.status == "unattempted"]
    assert [after[f"frame{i}"].status for i in range(FRAMES)] == ["fetched"] * FRAMES and after[f"frame{FRAMES - 1}"].wave >= FRAMES
    further = {n: len(r.reselection.attempts) - 1 for n, r in after.items() if r.reselection and r.reselection.attempts}
    # every capture of the site answers at its first try, so a further try is one request, kept on its page
    assert all(after[n].requests == r.requests + further.get(n, 0) for n, r in before.items() if r.status != "unattempted")
    assert further["parked"] == 1
    # what the refused item had asked for by then stays charged, and it is asked for anew
    assert run.spent.requests == sum(r.requests for r in after.values()) + sum(r.requests for r in before.values() if r.status == "unattempted")
    assert {r.hash for r in first["bodies"].select("hash").collect()} < {r.hash for r in second["bodies"].select("hash").collect()}


def test_a_signal_parks_what_waits(spark, tmp_path):
    pages, answers, _ = site(spark)
    tables = Run(spark, parse_project(json.dumps(PROJECT)), f"file://{tmp_path}/run").execute(pages, answers, signal=lambda: "pause")
    assert {(r.status, r.unattempted_reason) for r in tables["items"].collect()} == {("unattempted", "paused")}


# order over many tasks


def test_running_totals_are_those_of_one_window(spark):
    rows = [(i * 7 % 1000, i % 5) for i in range(1000)]
    got = A.running_totals(spark.createDataFrame(rows, "ord long, n long"), ["ord"], {"before": "n"}, cut).collect()
    total, want = 0, {}
    for rank, (o, n) in enumerate(sorted(rows)):
        want[o] = (rank, total)
        total += n
    assert {r.ord: (r.rank, r.before) for r in got} == want


def test_a_hot_ledger_and_schedule_in_blocks(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 4}", i % 4 == 0, i % 11, i * 3 % 50 + i, 0) for i in range(400)]
    df = spark.createDataFrame(rows, "ord long, host string, is_index boolean, bytes long, arrival_ms long, elapsed_ms long")
    one, many = ({r.ord: tuple(r) for r in A.ledger(df, A.Budgets(), key="host", width=w).select("ord", "spent_requests", "spent_index", "spent_bytes", "refused_by").collect()} for w in (10**6, 13))
    assert one == many and one[397][1] == sum(x[1] == rows[397][1] for x in rows[:397])
    starts = {r.ord: r.start_ms for r in A.schedule(df, 5, key="host", width=13).collect()}
    last: dict[str, int] = {}
    for o, host, _, _, arrival, _ in rows:
        last[host] = max(arrival, last.get(host, -(10**9)) + 5)
        assert starts[o] == last[host]


def test_histories_in_spans(spark):
    """Nearest captures and collapsed digests of one URL over years, against plain versions."""
    import random

    r = random.Random(5)
    stamps = sorted({f"{r.randrange(1996, 2006)}{r.randrange(1, 13):02}{r.randrange(1, 29):02}{r.randrange(24):02}0000" for _ in range(150)})
    rows = [(i, "u", t, None if r.random() < 0.6 else "statuscode:200", r.randrange(5), r.choice("ABC") if r.random() < 0.9 else None) for i, t in enumerate(stamps)]
    captures = spark.createDataFrame(rows, "ord long, capture_key string, timestamp string, excluded_by string, length long, digest string")
    kept = [x.ord for x in C.collapse_adjacent(captures).orderBy("ord").collect()]
    assert kept == [i for i, x in enumerate(rows) if not i or rows[i - 1][5] is None or x[5] != rows[i - 1][5]]
    from datetime import datetime

    second = lambda t: int(datetime.strptime(t + "+0000", "%Y%m%d%H%M%S%z").timestamp())
    wanted = [(i, "u", f"{r.randrange(1994, 2009)}{r.randrange(1, 13):02}15120000") for i in range(80)]
    got = {x.dep_id: x.resolved_timestamp for x in C.resolve_assets(spark.createDataFrame(wanted, "dep_id long, capture_key string, referring_timestamp string"), captures).collect()}
    good = [x for x in rows if x[3] is None]
    for i, _, t in wanted:
        assert got[i] == max(good, key=lambda x: (-abs(second(x[2]) - second(t)), x[4], x[2], -x[0]))[2]
