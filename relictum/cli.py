"""Command line: acquire from a fixture, report, reclassify. Exit codes: 0 done, 1 failed, 2 wrong call."""

from __future__ import annotations

import argparse
import json
import sys
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from relictum.catalog.registry import cut
from relictum.config import ConfigError, parse_project
from relictum.operators import evidence, outcomes
from relictum.operators import report as report_of
from relictum.plans.acquire import Run, widened
from relictum.plans.collection import classify_collection, override_table
from relictum.sources.store import load_job, save_job, write_report

#: Names the code in recorded revisions.
CODE = "relictum-1"


def report(tables: dict) -> dict:
    """A job's report without its lists: what was declared and spent, and totals. Small aggregates alone reach the driver."""
    items, project = tables["items"], declared(tables)
    found = report_of.totals(items, project["window_days"]).first().asDict(recursive=True)
    tally = lambda df, c: {r[c]: r.n for r in df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).collect()}
    partial = sorted(r.reason for r in evidence.inventory_reasons(tables["runs"]).select("reason").distinct().collect())
    events = [r.asDict() for r in tables["events"].orderBy("seq").collect()]  # a few for each run
    return {
        "projectId": project["project_id"],
        "runState": events[-1]["kind"],
        "scope": {k: project[k] for k in ("url", "match_type", "start", "end", "seed_urls", "dependency_hosts")},
        "budgets": project["budgets"],
        "spend": tables["spend"].first().asDict(),
        "inventory": {"runs": [r.asDict() for r in tables["runs"].collect()], "candidateFilters": project["candidate_filters"], "timeline": tally(tables["captures"], "excluded_by"), "partial": bool(partial), "partialReasons": partial},
        "assets": {"windowDays": project["window_days"], **found["assets"]},
        "fidelity": found["fidelity"],
        "counts": found["counts"] | {"timelineRows": tables["captures"].where("excluded_by is not null").count()},
        "outcomes": {r.outcome: r.n for r in outcomes.outcome_counts(items).collect()},
        "bands": tally(items, "band"),
        "gaps": tally(tables["gaps"], "kind"),
        "events": events,
    }


def declared(tables: dict) -> dict:
    return json.loads(tables["project"].first().document)


def reclassify(tables: dict) -> dict:
    """A job's tables with new outcomes, scores and gaps."""
    decided = ("outcome", "outcome_source", "outcome_detail", "reference_eligible", "structure", "boilerplate", "encoding", "assets", "cross-capture", "applied_weight", "weakest", "score", "band", "overridden", "promotion_blocked", "override_reason", "matched_template", "redirect_raw")
    project = declared(tables)
    overrides, thresholds = override_table(tables["items"].sparkSession, project["overrides"]), (project["accept"], project["accept_with_warning"])
    done = classify_collection(tables["items"].drop(*decided), tables["assets"], tables["captures"], cut, overrides=overrides, thresholds=thresholds)
    partial = evidence.inventory_gaps(tables["runs"], project["url"])
    return tables | {"items": done, "gaps": evidence.gaps(widened(done, project["window_days"])).unionByName(partial)}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="relictum")
    sub = parser.add_subparsers(dest="command", required=True)
    run = sub.add_parser("acquire", help="index pages and responses (Parquet) to a job")
    for name in ("--project", "--index", "--responses", "--job"):
        run.add_argument(name, required=True)
    run.add_argument("--lookups", help="recorded answers to lookups of one URL (Parquet)")
    run.add_argument("--resume", action="store_true", help="go on with the job that is there")
    run.add_argument("--retry-failed", action="store_true", help="with --resume: try again what failed for a passing reason")
    for name, said in (("report", "totals of a job as JSON"), ("reclassify", "outcomes and scores again from what a job stores, without a request")):
        again = sub.add_parser(name, help=said)
        again.add_argument("--job", required=True)
        again.add_argument("--out", help="where to keep the report, with the revisions that it had")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    spark = SparkSession.builder.appName("relictum").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if args.command == "acquire":
            project = parse_project(spark.read.text(args.project, wholetext=True).first().value, args.project)
            previous = load_job(spark, args.job)
            if previous is not None and not args.resume:
                raise ValueError(f"a job exists in {args.job}; pass --resume to go on with it")
            lookups = spark.read.parquet(args.lookups) if args.lookups else None
            run_of = Run(spark, project, f"{args.job}/work/{uuid.uuid4().hex}")
            tables = run_of.execute(spark.read.parquet(args.index), spark.read.parquet(args.responses), lookups=lookups, previous=previous, retry_failed=args.retry_failed)
            save_job(tables, args.job)
        tables = load_job(spark, args.job)
        if tables is None:
            raise ValueError(f"no job in {args.job}")
        if args.command == "reclassify":
            tables = reclassify(tables)
        said = report(tables)
        if getattr(args, "out", None):
            write_report(spark, said, args.out, {"code": CODE}, report_of.sections(tables, declared(tables)["window_days"]))
        print(json.dumps(said, indent=2, sort_keys=True))
    except (ConfigError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
