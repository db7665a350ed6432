"""Queries against their SQL on small tables that hold what the given ones lack."""

from __future__ import annotations

import hashlib
import os

import duckdb
import pytest

from relictum.queries import oracle_sql, queries


@pytest.fixture
def same(spark, tmp_path, sf_dir):
    """Whether a query says what its SQL says on tables that are made here, with the given ones for the rest."""

    def check(name: str, **made: str) -> list:
        con = duckdb.connect()
        for f in os.listdir(sf_dir):
            t = f.removesuffix(".parquet")
            con.execute(f"create view given_{t} as select * from '{sf_dir}/{f}'")
            con.execute(f"copy ({made.get(t, f'select * from given_{t}')}) to '{tmp_path}/{f}' (format parquet)")
            con.execute(f"create view {t} as select * from '{tmp_path}/{f}'")
        df = queries()[name](spark, str(tmp_path))
        found = con.execute(oracle_sql()[name])
        order = [df.columns.index(d[0]) for d in found.description]
        got, want = sorted((tuple(r[i] for i in order) for r in df.collect()), key=repr), sorted(found.fetchall(), key=repr)
        assert got == want
        return got

    return check


def test_spacing_beyond_32_bits(same):
    """2,000 requests of a host, 25 minutes apart, are more milliseconds than an int holds."""
    assert len(same("rate_limit_schedule", events="select i as event_id, timestamp '2024-01-01' + interval (i) second as ts, 50 as user_id, 'view' as event_type, 1e0 as value from range(2000) t(i)")) == 2000


def test_a_run_over_many_index_pages(same):
    """22 pages of the index are more than the budget of index requests that a project has unless it says otherwise."""
    assert len(same("acquisition_run", pages="select i * 500 as page_id, '' as url, '<p>words of a page</p>' as html from range(22) t(i)")) == 22


def test_scores_with_a_capture_at_any_instant(same):
    """The first capture and the one nearest to it agree; one of New Year 1995 agrees with none."""
    orders = """select c * 10 + k as o_orderkey, c as o_custkey, 'O' as o_orderstatus, 1e0 as o_totalprice, timestamp '1994-12-01' + interval (31 * (k % 2) + 3 * (k // 2)) day as o_orderdate,
      case when k in (0, 2) then 'A' else 'B' || k end as o_orderpriority from range(120) t(c), range(4) u(k)"""
    assert len(same("collection_scores", orders=orders)) > 0


def test_a_host_alone_is_not_those_below_it(same):
    hosts = ("casino-win.example.net", "blog.casino-win.example.net", "example.com", "a.example.com", "notexample.com")
    made = " union all ".join(f"select {i} as page_id, 'http://{h}/x' as url, '' as html" for i, h in enumerate(hosts))
    assert [r[2] for r in sorted(same("host_scope", pages=made))] == [True, False, True, True, False]


def test_days_are_rounded_from_the_exact_value(spark, same):
    """Halves of the last digit: what lies below them in binary goes down, above them up, and quarter days are ties."""
    rows = same("served_and_retry", orders="select 4320 * i as o_orderkey, 1 as o_custkey, 'O' as o_orderstatus, 1e0 as o_totalprice, timestamp '1996-01-01' as o_orderdate, 'A' as o_orderpriority from range(400) t(i)")
    assert "1.2d" in {r[3] for r in rows}

    from pyspark.sql import functions as F

    from relictum.functions.time import format_days

    shown = spark.range(5, 8).select(format_days(F.col("id") * 21600).alias("s"))
    assert [r.s for r in shown.collect()] == ["1.3d", "1.5d", "1.8d"]


def test_a_long_scan_takes_few_batches(spark, tmp_path):
    """Forty pages, each with the key of the next one; the recorded table is opened once, and a page is parsed once."""
    import json

    from relictum.operators.captures import FIELDS
    from relictum.sources.cdx import page_rows
    from relictum.sources.index_stream import recorded_pages, scan_index

    pages = [("" if p == 0 else f"k{p}", json.dumps([list(FIELDS), ["", f"{p}"], ["", "x"], *([[], [f"k{p + 1}"]] if p < 39 else [])])) for p in range(40)]
    spark.createDataFrame(pages, "resume_key string, body string").write.parquet(f"file://{tmp_path}/recorded")
    found, at = scan_index(spark, recorded_pages(f"file://{tmp_path}/recorded"), f"file://{tmp_path}/scan", limit=2, most=99)
    rows = page_rows(found)
    assert at["state"] == "complete" and at["requests"] == 40 and found.where("resume_key = 'k' || page_ord").count() == 39
    assert [r.timestamp for r in rows.where("row_ord = 0").orderBy("page_ord").collect()] == [str(p) for p in range(40)] and rows.count() == 80
    assert len([f for f in (tmp_path / "scan" / "checkpoint" / "commits").iterdir() if f.name.isdigit()]) < 20
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_few_captures_meet_their_dependencies_in_one_join(spark):
    """Keys with few captures and keys with many get the answers of the sorted way, odd rows included, and few need few shuffles."""
    import random

    from relictum.operators import captures as C

    draw = random.Random(7)
    stamp = lambda: draw.choice(["1999", "19991301000000", "bad", *[f"199{draw.randrange(10)}0{draw.randrange(1, 10)}{draw.randrange(10, 29)}000000"] * 9])
    known = [(f"u{min(draw.randrange(9), 6)}", stamp(), draw.choice([None, 5, 9]), "D", i, draw.choice([None, "x"]) if i % 3 else "x") for i in range(150)]
    known += [("only-excluded", "19990101000000", 1, "D", 200, "x"), ("undated", "19991301000000", 1, "D", 201, None)]
    captures = spark.createDataFrame(known, "capture_key string, timestamp string, length long, digest string, ord long, excluded_by string")
    keys = [f"u{i}" for i in range(7)] + ["only-excluded", "undated", "unknown"]
    asked = spark.createDataFrame([(i, draw.choice(keys), draw.choice([None, stamp()])) for i in range(300)], "dep_id long, capture_key string, referring_timestamp string")
    listed = C.resolve_assets(asked, captures)
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(listed) == rows(C.resolve_assets(asked, captures, most=0)) == rows(C.resolve_assets(asked, captures, most=20)) and listed.count() == 300


def test_a_fingerprint_reads_a_page_once(spark):
    """Letters are worked out once, not once for each mention; addresses go, whatever runs of letters stand before them."""
    from pyspark.sql import functions as F

    from relictum.functions.markup import error_fingerprint

    page = lambda a: f"<p>{'the page that was asked for is not here ' * 3}{a} more</p>"
    df = spark.createDataFrame([(page("-http://x.example/a"),), (page("9.ab.c+d://q"),), (page("  "),), ("<p>short ftp://x.example/longer/than/it/is</p>",)], "t string")
    found = df.select(error_fingerprint(F.col("t")).alias("f"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("[^a-z ]+") == 1
    rows = [r.f for r in found.collect()]
    assert rows[0] == rows[1] == rows[2] is not None and rows[3] is None


def test_totals_of_removals_take_no_pages_back(spark):
    """What Python hands back are names and numbers, made a few pages at a time and in the order of the pages."""
    from pyspark.sql import functions as F

    from relictum.functions.injection import injection_removals, strip_injection

    marked = '<!-- FILE ARCHIVED ON 1999 --><div id="wm-ipp">x</div>'
    pages = spark.range(0, 300, 1, 1).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.repeat(F.lit("a"), (F.col("id") % 5).cast("int")), F.when(F.col("id") % 3 == 0, marked).otherwise("plain"))).alias("t"))
    both = pages.select("id", strip_injection(F.col("t")).alias("s"), injection_removals(F.col("t")).alias("r"))
    assert both.where("s.rules != r.rules or s.removed_characters != r.removed_characters").count() == 0
    assert {(r.n, tuple(r.rules)) for r in both.select(F.col("r.removed_characters").alias("n"), "r.rules").collect()} == {(0, ()), (54, ("file-archived-comment", "wayback-toolbar-element"))}
    assert "residual" not in queries()["injection_totals"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("n", [3, 63, 64, 65, 300])
def test_totals_count_every_injected_part(spark, tmp_path, n):
    """A page may hold any number of injected parts beside the one that the query adds."""
    comment, bar = "<!-- FILE ARCHIVED ON 2001 -->", "<div id='wm-ipp'>bar</div>"
    html = f"case id % 3 when 0 then repeat('{comment}', {n}) || 'text' when 1 then repeat(\"{bar}\", {n}) || 'text' else 'text' end"
    spark.sql(f"select id as page_id, '' as url, {html} as html from range(9)").write.parquet(f"{tmp_path}/pages.parquet")
    gone = (30 + n * len(comment), 37 + n * len(bar), 0)
    found = {r.rule: (r.pages, r.removed_characters) for r in queries()["injection_totals"](spark, str(tmp_path)).collect()}
    assert found == {"file-archived-comment": (3, 3 * gone[0]), "wayback-toolbar-element": (3, 3 * gone[1])}
    stripped = {r.page_id: (r.clean_hash, r.removed_characters) for r in queries()["injection_strip"](spark, str(tmp_path)).collect()}
    assert stripped == {i: (hashlib.sha256(b"text").hexdigest(), gone[i % 3]) for i in range(9)}


def test_totals_see_what_any_rule_finds(spark, tmp_path):
    """Pages that hold none of the markers as written, but something that a rule takes out."""
    alone = ("<script src='//archive.org/includes/a.js'></script>", "<DIV ID=WM-IPP></DIV>", "<p>wm_ipp archive.org</p>")
    spark.createDataFrame([(2 + 3 * i, "", html) for i, html in enumerate(alone)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {tuple(r) for r in queries()["injection_totals"](spark, str(tmp_path)).select("rule", "pages", "removed_characters").collect()}
    assert found == {("replay-analytics-script", 1, len(alone[0])), ("wayback-toolbar-element", 1, len(alone[1]))}
