"""Links, outcomes, fidelity, evidence, and whole runs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from relictum.catalog.registry import cut
from relictum.cli import main, report
from relictum.config import ConfigError, parse_project
from relictum.operators import acquisition as A
from relictum.operators import fidelity as FI
from relictum.operators import links as L
from relictum.operators import outcomes as O
from relictum.operators.report import asset_entries, sections, totals
from relictum.plans.acquire import Run
from relictum.sources import store
from relictum.sources.store import Snapshots, bodies_by_hash, compact_bodies, load_job, load_manifest, read_bodies, recorded_revisions, revision, save_job, stored_bodies, summary, write_bodies


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, t) for i, (u, t) in enumerate(rows)], "page_id int, original_url string, html string")


def test_links_of_a_page(spark):
    html = """<base href="http://b.example/d/"><LINK rel=x href=s.css><script src="j.js"></script><a href="p.html#f">1</a><a href='p.html'>2</a><a href="mailto:x@y">3</a><a href="#top">4</a>
    <a href="doc.PDF">5</a><img src=i.gif><frame src="f.html"><a href="javascript:x()">6</a><a href="">7</a><td background="t.gif"><object data="o.swf"></object>"""
    got = [(r.relation, r.resolved_url, r.location) for r in L.discover_links(pages(spark, ("http://a.example/", html))).orderBy("rule_ord", "match_ord").collect()]
    assert got == [
        ("stylesheet", "http://b.example/d/s.css", "<link href>"), ("script", "http://b.example/d/j.js", "<script src>"), ("image", "http://b.example/d/i.gif", "<img src>"), ("image", "http://b.example/d/t.gif", "<td background>"),
        ("frame", "http://b.example/d/f.html", "<frame src>"), ("object", "http://b.example/d/o.swf", "<object data>"), ("link", "http://b.example/d/p.html", "<a href>"), ("document", "http://b.example/d/doc.PDF", "<a href>"),
    ]


def test_links_are_capped_in_order(spark):
    html = "".join(f"<a href=/{i}>x</a>" for i in range(600)) + "<img src=/i.gif>"
    got = L.discover_links(pages(spark, ("http://a.example/", html)))
    assert got.count() == 500 and got.where("relation = 'image'").count() == 1 and got.where("raw_url = '/498'").count() == 1 and got.where("raw_url = '/499'").count() == 0


NAV, FOOT = "<div>Home Articles About Contact</div>", "<div>Copyright the site, all rights reserved</div>"


def collection(spark):
    long = "".join(f"<p>Sentence number {i} of the article says something of its own.</p>" for i in range(12))
    rows = [
        ("http://a.example/article", f"<title>Article</title>{NAV}{long}<a href='/about'>about</a>{FOOT}"), ("http://a.example/about", f"<title>About</title>{NAV}<p>We are a small group of people who write on this and that.</p><a href='/article'>a</a>{FOOT}"),
        ("http://a.example/stub", f"<title>Soon</title>{NAV}<p>coming soon</p>{FOOT}"), ("http://a.example/bare", f"{NAV}{FOOT}"), ("http://a.example/other", f"<title>Other</title>{NAV}<p>Another page.</p>{FOOT}"),
    ]
    return pages(spark, *rows)


def test_scores_fall_with_content_and_damage(spark):
    p = collection(spark)
    segs = FI.page_segments(p)
    shared = FI.boilerplate(segs, FI.segment_frequency(segs))
    form = FI.structure(p, segs, L.discover_links(p), p.select("original_url"))
    out = {}
    for ratio in (0.0, 0.04, 0.2):
        signals = form.join(shared, "page_id").join(p.select("page_id", "original_url"), "page_id").select("original_url", "structure", "boilerplate", FI.encoding_signal(F.lit(ratio)).alias("encoding"), F.lit(None).cast("double").alias("assets"), F.lit(None).cast("double").alias("cross-capture"))
        out[ratio] = {r.original_url.rpartition("/")[2]: r for r in FI.composite(signals).collect()}
    assert out[0.0]["article"].score == 1.0 and out[0.04]["article"].score == 0.75 and out[0.2]["article"].score == 0.6875
    assert [out[0.0][x].score for x in ("article", "about", "stub", "bare")] == sorted((out[0.0][x].score for x in ("article", "about", "stub", "bare")), reverse=True)
    assert out[0.0]["article"].band == "accept" and out[0.0]["bare"].band == "review-required" and out[0.0]["bare"].promotion_blocked


def test_overrides_and_bands(spark):
    signals = spark.createDataFrame([("u", 0.5, 0.5, 0.5, None, None), ("v", 1.0, 1.0, 1.0, 1.0, 1.0), ("w", None, None, None, None, None)], "original_url string, structure double, boilerplate double, encoding double, assets double, `cross-capture` double")
    overrides = spark.createDataFrame([("u", "kept"), ("v", "kept")], "original_url string, reason string")
    got = {r.original_url: r for r in FI.composite(signals, overrides).collect()}
    assert got["u"].overridden and not got["u"].promotion_blocked and not got["v"].overridden and got["v"].score == 1.0
    assert got["w"].score == 0.0 and got["w"].promotion_blocked and got["w"].weakest is None and got["u"].weakest == "structure"


def test_outcomes_in_order(spark):
    text = {
        "a": "<p>job failed this domain is for sale", "b": "<p>this domain is for sale</p><meta http-equiv=refresh content='0;url=/x'>", "c": "<meta http-equiv=refresh content='0;url=/x'><title>404</title>",
        "d": "<frameset><frame src=/gone></frameset>", "e": "<frameset><frame src=/kept></frameset>", "f": "<title>404</title>", "g": "<p>fine", "h": None,
    }
    p = spark.createDataFrame([(i, i, f"http://a.example/{k}", t, "200") for i, (k, t) in enumerate(text.items())], "page_id int, ord int, original_url string, text string, archive_status string")
    held = spark.createDataFrame([("http://a.example/kept",)], "original_url string")
    frames = O.declared_frames(L.discover_links(p, text="text").where("relation = 'frame'"), held, key="page_id")
    got = {r.original_url[-1]: r.outcome for r in O.classify_text(p, O.error_templates(p), frames, key="page_id").collect()}
    assert got == {"a": "archive-interstitial", "b": "parked-domain", "c": "meta-refresh-redirect", "d": "frameset-only", "e": "ok", "f": "unverified-soft-404", "g": "ok", "h": "ok"}


def test_templates_stay_with_their_host(spark):
    error = "<body>the document that you asked for is no longer on this server</body>"
    p = spark.createDataFrame([(0, 0, "http://a.example/1", error, "404"), (1, 1, "http://a.example/2", error, "200"), (2, 2, "http://b.example/1", error, "200")], "page_id int, ord int, original_url string, text string, archive_status string")
    none = spark.createDataFrame([], "page_id int, frames long, held_frames long")
    got = {r.page_id: (r.outcome, r.matched_template) for r in O.classify_text(p, O.error_templates(p), none, key="page_id").collect()}
    assert got[0][0] == got[1][0] == "origin-soft-404" and got[1][1].startswith("a.example:") and got[2][0] == "ok"


@pytest.mark.parametrize("after,attempts,expected", [(["parked-domain", "ok"], 2, ("ok", 1, "d0=parked-domain, d1=ok")), (["parked-domain"] * 4, 2, ("attempt-limit", 2, "d0=parked-domain, d1=parked-domain, d2=parked-domain")), (["parked-domain"], 2, ("no-remaining-alternative", 0, "d0=parked-domain")), (["ok", "ok"], 2, ("not-needed", 0, "d0=ok"))])
def test_reselection(spark, after, attempts, expected):
    ranked = spark.createDataFrame([("u", i, f"d{i}", o) for i, o in enumerate(after)], "capture_key string, place int, timestamp string, outcome string")
    r = A.reselect(ranked.where("place = 0").select("capture_key", "outcome"), ranked, attempts).first()
    assert (r.stop_reason, r.further_attempts, r.trail) == expected


def test_waves_stop(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    roots = spark.createDataFrame([(1, 0)], "node long, ord long")
    assert sorted((r.node, r.wave) for r in A.waves(roots, edges, cut, max_waves=9).collect()) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert A.waves(roots, edges, cut, max_waves=9, most=2).count() == 2


PROJECT = {"projectId": "demo", "scope": {"url": "http://a.example/", "from": "1999", "to": "1999"}, "budgets": {"maxRequests": 50}}


def test_projects():
    p = parse_project(json.dumps(PROJECT))
    assert p.budgets.max_requests == 50 and p.budgets.max_pages == 30 and p.policy == "nearest" and p.candidate_filters == ("statuscode:200",)
    for wrong in ({}, {"projectId": "Bad Name", "scope": {"url": "x"}}, PROJECT | {"budgets": {"maxRequests": 0}}, PROJECT | {"selection": {"policy": "best"}}, PROJECT | {"candidateFilters": ["x"]}, PROJECT | {"scope": {"url": "x", "from": "soon"}}):
        with pytest.raises((ConfigError, ValueError)):
            parse_project(json.dumps(wrong))
    with pytest.raises(ConfigError):
        parse_project("{")


HOME = b"<html><title>Home</title><body><p>" + b"Words of the home page. " * 30 + b"</p><img src=/logo.gif><a href=/news>n</a><img src=/late.gif><img src=/ghost.gif></body></html>"
INDEX = [["urlkey", "timestamp", "original", "mimetype", "statuscode", "digest", "length"]] + [[u, t, f"http://a.example/{u}", m, s, d, "100"] for u, t, m, s, d in (
    ("", "19990601000000", "text/html", "200", "H1"), ("", "19980601000000", "text/html", "200", "H1"), ("news", "19990701000000", "text/html", "200", "N1"), ("gone", "19990801000000", "text/html", "404", "G1"),
    ("logo.gif", "19990501000000", "image/gif", "200", "L1"), ("logo.gif", "20030501000000", "image/gif", "200", "L2"), ("late.gif", "20020101000000", "image/gif", "200", "E1"), ("empty", "19990301000000", "text/html", "200", "E"),
)]
RESPONSES = [
    ("http://a.example/", "19990601000000", 200, "text/html", HOME, False), ("http://a.example/news", "19990701000000", 200, "text/html; charset=utf-8", b"<p>this domain is for sale</p>", False), ("http://a.example/gone", "19990801000000", 404, "text/html", b"", False),
    ("http://a.example/logo.gif", "19990501000000", 200, "image/gif", b"GIF89a...", False), ("http://a.example/late.gif", "20020101000000", 200, "image/gif", b"<html>oops</html>", False), ("http://a.example/empty", "19990301000000", 200, "text/html", b"", False),
]


@pytest.fixture(scope="module")
def inputs(spark):
    index = spark.createDataFrame([(0, json.dumps(INDEX))], "page_ord long, body string")
    return index, spark.createDataFrame(RESPONSES, "original_url string, timestamp string, http_status int, content_type string, body binary, truncated boolean")


def test_a_whole_run(spark, inputs, tmp_path):
    tables = Run(spark, parse_project(json.dumps(PROJECT)), f"file://{tmp_path}/run").execute(*inputs)
    got = {r.original_url.rpartition("/")[2]: r for r in tables["items"].collect()}
    assert set(got) == {"", "news", "gone", "empty", "logo.gif", "late.gif", "ghost.gif"}
    assert {k: r.outcome for k, r in got.items()} == {"": "ok", "news": "parked-domain", "gone": "not-archived", "empty": "empty-body", "logo.gif": "ok", "late.gif": "content-type-mismatch", "ghost.gif": "not-archived"}
    assert got["logo.gif"].requested_ts == "19990501000000" and got["late.gif"].temporally_distant and got[""].score is not None
    kinds = {(r.kind, r.original_url.rpartition("/")[2]) for r in tables["gaps"].collect()}
    assert {("no-capture", "ghost.gif"), ("failed-fetch", "gone"), ("non-content-body", "news"), ("excluded-capture-only", "gone"), ("temporally-distant-asset", "late.gif")} <= kinds


def test_pages_without_content_get_another_capture(spark, tmp_path):
    index = [INDEX[0]] + [["a", t, "http://a.example/a", "text/html", "200", t, "9"] for t in ("19991201000000", "19990901000000", "19990601000000", "19990301000000")] + [["b", "19991201000000", "http://a.example/b", "text/html", "200", "b", "9"]]
    parked, real = b"<p>this domain is for sale</p>", b"<title>t</title><p>words</p>"
    responses = [("http://a.example/a", "19991201000000", 200, "text/html", parked, False), ("http://a.example/a", "19990901000000", 500, "text/html", b"", False), ("http://a.example/a", "19990601000000", 200, "text/html", real, False), ("http://a.example/b", "19991201000000", 200, "text/html", parked, False)]
    tables = Run(spark, parse_project(json.dumps(PROJECT)), f"file://{tmp_path}/run").execute(spark.createDataFrame([(0, json.dumps(index))], "page_ord long, body string"), spark.createDataFrame(responses, "original_url string, timestamp string, http_status int, content_type string, body binary, truncated boolean"))
    got = {r.original_url[-1]: r for r in tables["items"].collect()}
    assert set(got) == {"a", "b"} and got["a"].outcome == "ok" and got["a"].requested_ts == "19990601000000" and got["a"].score is not None
    assert got["a"].reselection_trail == "19991201000000=parked-domain, 19990901000000=http-error, 19990601000000=ok"
    assert got["b"].outcome == "parked-domain" and got["b"].reselection_trail == "19991201000000=parked-domain"


def test_report_of_a_run(spark, inputs, tmp_path):
    declared = PROJECT | {"fidelity": {"thresholds": {"accept": 0.99, "acceptWithWarning": 0.98}, "overrides": [{"originalUrl": "http://A.example/#top", "reason": "seen", "recordedBy": "n"}]}}
    run = Run(spark, parse_project(json.dumps(declared)), f"file://{tmp_path}/run")
    tables = run.execute(*inputs)
    said, lists = report(tables), {k: [r.asDict() for r in v.collect()] for k, v in sections(tables).items()}
    assert said["counts"] == {"items": 7, "indexed": 7, "fetched": 3, "failed": 3, "unattempted": 0, "skipped": 1, "recoveredFiles": 3, "referenceEligible": 2, "timelineRows": 1}
    assert said["counts"]["items"] == sum(said["outcomes"].values()) and said["spend"]["requests"] == run.spent.requests
    assert said["assets"] == {"windowDays": 365, "assets": 3, "lookupIndexRequests": 0, "lookups": 0, "resolvedFromInventory": 2, "withoutCapture": 1, "temporallyDistant": 1}
    # declared thresholds and overrides count
    assert said["fidelity"] == {"scored": 1, "accept": 0, "acceptWithWarning": 0, "reviewRequired": 1, "promotable": 1, "overridden": 1}
    assert said["scope"]["url"] == PROJECT["scope"]["url"] and said["budgets"]["max_requests"] > 0 and said["runState"] == "completed"
    assert [e["kind"] for e in said["events"]] == ["started", "completed"] and said["events"][1]["at_ms"] >= said["events"][0]["at_ms"]
    assert {k: len(v) for k, v in lists.items() if k not in ("gaps", "events")} == {"indexed": 7, "fetched": said["counts"]["fetched"], "failed": said["counts"]["failed"], "unattempted": 0, "recovered_files": said["counts"]["recoveredFiles"], "assets": 3, "lookups": 0, "fidelity": 5, "timeline": 1}
    late = next(a for a in lists["assets"] if a["original_url"].endswith("late.gif"))
    assert late["temporally_distant"] and late["source"] == "inventory" and late["candidates"] == 1 and late["referring_page"] == "http://a.example/" and late["local_path"] == "site/a.example/late.gif"
    signals = lists["fidelity"]
    assert abs(sum(s["contribution"] for s in signals) / sum(s["weight"] for s in signals) - signals[0]["score"]) < 1e-3 and all(s["overridden"] for s in signals)


def test_an_asset_served_from_another_era_is_distant(spark):
    row = ("http://a/x.gif", "19990101000000", "19990102000000", "20030101000000", False, 86400, 0, "fetched")
    items = spark.createDataFrame([row, ("http://a/y.gif", "19990101000000", None, None, None, None, 2, "skipped")], "original_url string, referring_timestamp string, requested_ts string, served_ts string, temporally_distant boolean, delta_seconds long, index_requests long, status string")
    got = {r.original_url[-5]: r for r in asset_entries(items).collect()}
    assert got["x"].temporally_distant and got["x"].served_delta_seconds == 1461 * 86400 and got["x"].source == "inventory"
    assert not got["y"].temporally_distant and got["y"].source == "none" and got["y"].served_delta_seconds is None
    assert asset_entries(items, 2000).where("temporally_distant").count() == 0
    one = totals(items).first()
    assert (one.assets.assets, one.assets.lookupIndexRequests, one.assets.temporallyDistant, one.assets.withoutCapture) == (2, 2, 1, 1)
    none = totals(items.limit(0)).first()
    assert none.counts["items"] == none.assets.lookupIndexRequests == none.fidelity.scored == 0


def test_command_line(spark, inputs, tmp_path, capsys):
    root = f"file://{tmp_path}"
    (tmp_path / "project.json").write_text(json.dumps(PROJECT))
    inputs[0].write.parquet(f"{root}/index")
    inputs[1].write.parquet(f"{root}/responses")
    args = ["--project", f"{root}/project.json", "--index", f"{root}/index", "--responses", f"{root}/responses", "--job", f"{root}/job"]
    assert main(["acquire", *args]) == 0
    first = json.loads(capsys.readouterr().out)
    assert first["counts"]["items"] == 7 and first["outcomes"]["ok"] == 2 and first["outcomes"]["rate-limited"] == 0
    assert main(["report", "--job", f"{root}/job"]) == 0 and json.loads(capsys.readouterr().out) == first
    assert main(["reclassify", "--job", f"{root}/job", "--out", f"{root}/report"]) == 0 and json.loads(capsys.readouterr().out) == first
    assert main(["reclassify", "--job", f"{root}/job", "--out", f"{root}/report"]) == 0
    assert recorded_revisions(spark, f"{root}/report") == [{"code": "relictum-1"}] and "parked-domain 1" in summary(first)
    kept = json.loads(spark.read.text(f"{root}/report", wholetext=True).first().value)
    assert spark.read.json(kept["lists"]["indexed"]).count() == 7 and spark.read.json(kept["lists"]["gaps"]).count() == sum(first["gaps"].values())
    assert main(["acquire", *args]) == 1  # a job is there
    capsys.readouterr()
    assert main(["acquire", *args, "--resume"]) == 0 and json.loads(capsys.readouterr().out)["counts"] == first["counts"]
    assert main(["nonsense"]) == 2
    (tmp_path / "bad.json").write_text("{}")
    assert main(["acquire", "--project", f"{root}/bad.json", *args[2:]]) == 1


def test_bodies_are_stored_once(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    df = spark.createDataFrame([(bytearray(b"one"),), (bytearray(b"one"),), (bytearray(b"two"),)], "bytes binary")
    assert sorted(r.references for r in bodies_by_hash(df).collect()) == [1, 2]
    write_bodies(df, path)
    write_bodies(df.union(spark.createDataFrame([(bytearray(b"three"),)], "bytes binary")), path)
    assert stored_bodies(spark, path).count() == 3
    wanted = bodies_by_hash(df).select("hash").union(spark.createDataFrame([("0" * 64,)], "hash string"))
    assert sorted(bytes(r.bytes or b"-") for r in read_bodies(spark, path, wanted).collect()) == [b"-", b"one", b"two"]


def test_two_writers_of_one_body(spark, tmp_path, monkeypatch):
    """A writer that another one overtakes between its look at the store and its commit: both parts stay, readers see one copy, and
    a compaction leaves one."""
    path = f"file://{tmp_path}/store"
    df = spark.createDataFrame([(bytearray(b"one"),), (bytearray(b"two"),)], "bytes binary")
    plain = store.write_part

    def overtaken(fresh, at):
        part = plain(fresh, at)
        monkeypatch.setattr(store, "write_part", plain)
        write_bodies(df.limit(1), at)
        return part

    monkeypatch.setattr(store, "write_part", overtaken)
    write_bodies(df, path)
    assert stored_bodies(spark, path).count() == 3 and Snapshots(spark, path).numbers() == [1, 2]
    wanted = bodies_by_hash(df).select("hash")
    assert read_bodies(spark, path, wanted.union(wanted)).count() == 4
    assert compact_bodies(spark, path) and stored_bodies(spark, path).count() == 2
    assert len(Snapshots(spark, path).sweep("parts", age_s=-5)) == 0  # the manifest before still names them
    write_bodies(df, path, most_parts=1)
    assert stored_bodies(spark, path).count() == 2 and len(Snapshots(spark, path).sweep("parts", age_s=-5)) == 2


def test_a_save_that_dies_leaves_the_job(spark, tmp_path):
    path = f"file://{tmp_path}/job"
    assert load_job(spark, path) is None
    save_job({"a": spark.range(3), "b": spark.range(4)}, path)
    broken = spark.range(5).select(F.when(F.col("id") > 2, F.raise_error(F.lit("gone"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="gone"):
        save_job({"a": spark.range(9), "b": broken}, path)
    assert {n: t.count() for n, t in load_job(spark, path).items()} == {"a": 3, "b": 4}
    job = load_job(spark, path)
    save_job({"a": job["a"].union(job["b"]), "b": job["b"]}, path)  # what is read stays while it is written anew
    assert {n: t.count() for n, t in load_job(spark, path).items()} == {"a": 7, "b": 4}
    taken = Snapshots(spark, path)
    assert not taken.commit(max(taken.numbers()), {}) and max(taken.numbers()) == 2


def test_jobs_and_manifests(spark, tmp_path):
    path = f"file://{tmp_path}/job"
    save_job({"t": spark.range(3)}, path)
    assert load_job(spark, path)["t"].count() == 3
    assert Snapshots(spark, path).commit(2, {"version": 1, "tables": [], "parts": []})
    with pytest.raises(ValueError):
        load_job(spark, path)
    (tmp_path / "m.json").write_text('{"rules": []}')
    assert load_manifest(spark, f"file://{tmp_path}/m.json") == '{"rules": []}' and len(revision(spark, f"file://{tmp_path}/m.json")) == 64
    (tmp_path / "n.json").write_text("{}")
    with pytest.raises(ValueError):
        load_manifest(spark, f"file://{tmp_path}/n.json")
