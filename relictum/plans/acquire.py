"""An acquisition over recorded responses: index, choice of captures, waves of requests under budgets, classification, evidence.

Nothing here opens a connection: responses come from a table, made by the fixture source or loaded beforehand. What a run
decides is what working through its list one by one would decide: the list is in waves, each in a fixed order, and running
sums over that order find the first item that a budget refuses. That item and all after it stay unattempted, with the reason.
Pages of the index, pages of lookups, requests of items and further tries of pages without content are charged to one spend.
What a wave costs is decided on the statuses and sizes of answers; only bodies of what the budgets admit are read.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relictum.config import Project
from relictum.functions.address import block_table, is_literal, refused_hosts, url_refusal
from relictum.functions.time import distance_seconds, format_days, selection_target, served_timestamp
from relictum.functions.url import IDENTITY_MODIFIER, capture_key, host_matches, host_of, item_id, local_path, replay_modifier, replay_parts, replay_url, resolve_url
from relictum.operators import acquisition as A
from relictum.operators import captures as C
from relictum.operators import evidence, links, outcomes, report
from relictum.plans.collection import classify_collection, decode_bodies, item_outcomes, override_table, validated
from relictum.sources.cdx import page_ends, page_rows, proves_absence
from relictum.sources.index_stream import Fetch, scan_index

ENDPOINT = "https://web.archive.org/web"
#: A row's place in the index: page and row in one number, two to the power of 32 rows a page.
PAGE_ROWS = 1 << 32
#: Optional columns of recorded responses.
RECORDED = {"call": "int", "location": "string", "memento": "string", "retry_after": "long", "truncated": "boolean"}
#: What an item carries from the list into its request.
LISTED = "original_url string, ord long, wave int, kind string, relation string, requested_ts string, archive_status string, from_excluded boolean, referrer string, referring_timestamp string"
PAGES = ("page", "frame")
#: Rows that one page of a lookup may have.
LOOKUP_ROWS = 100
#: The captures that a page tried one after the other, and why it stopped.
RESELECTION = "struct<attempts:array<struct<timestamp:string,outcome:string>>,stop:string>"
#: What an item's requests cost, its further tries included.
COSTS = ("requests", "bytes_read", "wait_ms")
SETTLED = ("ok", "attempt-limit", "no-remaining-alternative")
ALWAYS_GO = lambda: "continue"


def widened(items: DataFrame, window_days: int = report.DEFAULT_WINDOW_DAYS) -> DataFrame:
    """Classified items with the flat columns that evidence reads. An asset is from another era if what was chosen is, or what was
    served."""
    items = with_missing(items, {c: report.ITEM[c] for c in ("referring_timestamp", "served_ts", "temporally_distant", "delta_seconds")})
    far = format_days(F.coalesce(report.served_delta(), "delta_seconds"))
    return items.withColumns({"distance_text": far, "failure_kind": F.col("failure.kind"), "failure_message": F.col("failure.message"), "retryable": F.col("failure.retryable"), "distant": report.distant(window_days), "degraded": F.col("decoded.degraded"), "encoding": F.col("decoded.chosen_encoding")})


def with_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def failure(kind: Column, message: Column, status: Column, retryable: Column) -> Column:
    return F.struct(kind.alias("kind"), message.alias("message"), status.cast("int").alias("http_status"), retryable.alias("retryable"))


@dataclass
class Spent:
    """What a job has spent so far."""

    requests: int = 0
    index_requests: int = 0
    bytes: int = 0
    wait_ms: int = 0
    pages: int = 0
    dependencies: int = 0
    listed: int = 0

    @property
    def made(self) -> int:
        """Requests of either kind."""
        return self.requests + self.index_requests


@dataclass
class State:
    """What a run holds between waves."""

    known: DataFrame
    runs: DataFrame
    items: DataFrame | None
    bodies: DataFrame | None
    listed: DataFrame
    number: int
    stop: str | None = None


@dataclass
class Run:
    """Tables of one run in a shared folder; each is written once and read back."""

    spark: SparkSession
    project: Project
    path: str
    endpoint: str = ENDPOINT
    #: host, ord and address of what hosts resolve to; without it addresses are not looked at.
    addresses: DataFrame | None = None
    spent: Spent = field(default_factory=Spent)
    number: int = 0
    #: What happened to the run as a whole: (kind, detail, at_ms).
    events: list[tuple[str, str, int]] = field(default_factory=list)

    def note(self, kind: str, detail: str) -> None:
        """An event, at the time that the spacing of requests adds up to."""
        self.events.append((kind, detail, self.spent.made * self.project.min_interval_ms + self.spent.wait_ms))

    def history(self, previous: dict[str, DataFrame] | None) -> DataFrame:
        """Events of all runs of the job in order; a few for each run."""
        earlier = [tuple(r) for r in previous["events"].orderBy("seq").collect()] if previous and "events" in previous else []
        rows = earlier + [(len(earlier) + i, *e) for i, e in enumerate(self.events)]
        return self.cut(self.spark.createDataFrame(rows, "seq int, kind string, detail string, at_ms long"), "events")

    def declared(self) -> DataFrame:
        """The project as it was declared for this run, as JSON."""
        return self.cut(self.spark.createDataFrame([(self.project.project_id, json.dumps(asdict(self.project), sort_keys=True))], "project_id string, document string"), "project")

    @functools.cached_property
    def hosts(self) -> DataFrame | None:
        """(host, refusal) of all hosts whose addresses are known."""
        return None if self.addresses is None else self.cut(refused_hosts(self.addresses, block_table(self.spark)), "hosts")

    @functools.cached_property
    def endpoint_refusal(self) -> str | None:
        """Why the endpoint itself must not be asked."""
        return self.with_refusal(self.spark.createDataFrame([(self.endpoint,)], "url string"), F.col("url")).first().refusal

    def with_refusal(self, df: DataFrame, url: Column) -> DataFrame:
        """`df` with the reason why a URL must not be requested, if there is one."""
        own = df.withColumn("refusal", url_refusal(url, list(self.project.allowed_hosts)))
        if self.hosts is None:
            return own
        by = self.hosts.select(F.col("host").alias("__host"), F.coalesce("refusal", F.lit("")).alias("__refusal"))
        met = own.join(by, host_of(url) == F.col("__host"), "left")
        unknown = F.concat(F.lit("cannot resolve "), host_of(url), F.lit(": no address is recorded"))
        resolved = F.when(is_literal(url) | url.isNull(), F.lit(None)).otherwise(F.nullif(F.coalesce("__refusal", unknown), F.lit("")))
        return met.withColumn("refusal", F.coalesce("refusal", resolved)).drop("__host", "__refusal")

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        self.number += 1
        at = f"{self.path}/{self.number:04}-{name}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    # the index

    def typed(self, rows: DataFrame, key: Column) -> DataFrame:
        tagged = C.tag_exclusions(rows, self.project.candidate_filters)
        return C.as_candidates(tagged.withColumn("capture_key", key)).drop("page_ord", "row_ord", "of")

    def inventory(self, index_pages: DataFrame) -> DataFrame:
        """Captures of the index pages (page_ord, body), told apart by the candidate filters, each timestamp of a URL once."""
        rows = page_rows(index_pages).withColumn("ord", F.col("page_ord").cast("long") * PAGE_ROWS + F.col("row_ord"))
        return self.cut(C.first_of_timestamp(self.typed(rows, capture_key(F.col("original")))), "captures")

    def charged_index(self, index_pages: DataFrame) -> tuple[DataFrame, bool]:
        """The pages of the index that the budgets let be asked for, each one request, and whether more are there."""
        budgets, spent = self.project.budgets, self.spent
        room = max(0, min(budgets.max_index_requests - spent.index_requests, budgets.max_requests - spent.made))
        first = index_pages.select("page_ord").orderBy("page_ord").limit(room + 1).collect()  # at most a budget of numbers
        asked = [r.page_ord for r in first[:room]]
        spent.index_requests += len(asked)
        return index_pages.where(F.col("page_ord") <= asked[-1] if asked else F.lit(False)), len(first) > room

    def scan(self, fetch: Fetch, path: str) -> DataFrame:
        """Pages of the index, asked for one after the other as far as the budgets go and pages are wanted; a scan at `path` that was
        cut off goes on. `execute` charges them."""
        budgets = self.project.budgets

        def enough(pages: DataFrame) -> bool:
            seen = page_rows(pages).where(C.seeds_a_page(F.col("mimetype"))).select(capture_key(F.col("original"))).distinct()
            return seen.limit(budgets.max_pages).count() >= budgets.max_pages

        return scan_index(self.spark, fetch, path, limit=self.index_limit, most=min(budgets.max_index_requests, budgets.max_requests), enough=enough)[0]

    @property
    def index_limit(self) -> int:
        """Rows that a page of the index may have."""
        return min(self.project.budgets.max_pages * 4, 1000)

    def index_runs(self, index_pages: DataFrame, cut_short: bool = False) -> DataFrame:
        """How the inventory ended: one row with run_id, continued, failed and limit_reached. A page without a body failed."""
        ends = page_ends(index_pages, self.index_limit)
        last = F.max_by(F.coalesce("resume_key", F.lit("")), "page_ord")
        found = ends.agg(F.coalesce(last != "", F.lit(False)).alias("continued"), F.coalesce(F.max("limit_reached"), F.lit(False)).alias("limit_reached"))
        failed = index_pages.agg((F.count_if(F.col("body").isNull()) > 0).alias("failed"), F.coalesce(F.max(F.when(F.col("body").isNotNull(), F.col("page_ord"))), F.lit(-1)).cast("long").alias("through"))
        return self.cut(found.crossJoin(failed).select(F.lit(0).alias("run_id"), (F.col("continued") | F.lit(cut_short)).alias("continued"), "failed", "limit_reached", "through"), "runs")  # one row each

    def absence_proved(self, runs: DataFrame, url: Column) -> Column:
        project = self.project
        complete = evidence.inventory_reasons(runs).isEmpty()
        bare = project.url.partition("://")[2] or project.url
        host = bare.partition("/")[0].partition(":")[0].lower()
        return F.coalesce(proves_absence(complete, bool(project.start or project.end), project.match_type, host_of(url), host), F.lit(False))

    def choose(self, known: DataFrame) -> DataFrame:
        target = selection_target(self.project.start, self.project.end)
        has_target = bool(self.project.start or self.project.end)
        return C.select_captures(known, policy=self.project.policy, target=target if has_target else None, cluster_days=self.project.cluster_days)

    # the list

    def listed(self, wanted: DataFrame, order: list[str], wave: int, name: str) -> DataFrame:
        """The next items of the list, in order, as far as the job's caps on pages and dependencies allow."""
        spent, budgets = self.spent, self.project.budgets
        is_page = (F.col("kind") == "page").cast("long")
        run = A.running_totals(wanted.withColumns({"__page": is_page, "__other": 1 - is_page}), order, {"pages_before": "__page", "others_before": "__other"}, self.cut)
        room = F.when(F.col("kind") == "page", F.col("pages_before") < budgets.max_pages - spent.pages).otherwise(F.col("others_before") < budgets.max_dependencies - spent.dependencies)
        placed = run.where(room).withColumns({"ord": F.col("rank") + spent.listed, "wave": F.lit(wave)})
        front = self.cut(placed.select([c.split()[0] for c in LISTED.split(", ")]), name)
        counts = front.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "page").alias("p")).first()
        spent.pages, spent.dependencies, spent.listed = spent.pages + counts.p, spent.dependencies + counts.n - counts.p, spent.listed + run.count()
        return front

    def seeds(self, chosen: DataFrame, listed: DataFrame | None = None) -> DataFrame:
        """Page items: what the index shows to be a page, and after them declared seeds that it lacks; without those `listed`."""
        fields = [F.col("capture_key").alias("original_url"), F.col("timestamp").alias("requested_ts"), F.col("status_code").alias("archive_status"), "from_excluded"]
        seen = chosen.where(C.seeds_a_page(F.col("mimetype"))).select(*fields, "ord", F.lit(0).alias("rank_of"))
        given = self.spark.createDataFrame(list(enumerate(self.project.seed_urls)), "ord long, url string").select(capture_key(F.col("url")).alias("original_url"), "ord").groupBy("original_url").agg(F.min("ord").alias("ord"))
        known = chosen.select(*fields)
        instant = F.lit(self.project.end or self.project.start).cast("string")
        extra = given.join(seen.select("original_url"), "original_url", "left_anti").join(known, "original_url", "left").withColumns({"requested_ts": F.coalesce("requested_ts", instant), "rank_of": F.lit(1)})
        typed = seen.unionByName(extra).withColumns({"kind": F.lit("page"), "relation": F.lit("page"), "referrer": F.lit(None).cast("string"), "referring_timestamp": F.lit(None).cast("string")})
        if listed is not None:
            typed = typed.join(listed.select("original_url"), "original_url", "left_anti")
        return self.listed(typed, ["rank_of", "ord", "original_url"], 0, "wave0")

    def found(self, read: DataFrame, items: DataFrame, wave: int) -> DataFrame:
        """What the pages of a wave refer to and the list does not hold; the first reference counts."""
        project = self.project
        pages = read.where(F.col("relation").isin(*PAGES) & F.coalesce("validated", F.lit(False)) & F.col("text").isNotNull())
        own = pages.select("item_id", "original_url", F.coalesce("served_ts", "requested_ts").alias("referring_timestamp"), F.col("ord").alias("page_ord"))
        near = links.discover_links(pages, key="item_id", url="original_url", text="text").join(own, "item_id")
        hosts = list(project.dependency_hosts)
        inside = links.in_scope(F.col("resolved_url"), hosts) if hosts else F.coalesce(host_matches(host_of(F.col("resolved_url")), host_of(F.col("original_url"))), F.lit(False))
        wanted = near.where(inside & links.followed(F.col("relation"), list(project.follow_relations), project.follow_page_links))
        order = ["page_ord", "rule_ord", "match_ord"]
        first = wanted.groupBy("resolved_url").agg(F.min_by(F.struct("relation", F.col("original_url").alias("referrer"), "referring_timestamp", *order), F.struct(*order)).alias("f"))
        fresh = first.select(F.col("resolved_url").alias("original_url"), "f.*").join(items.select("original_url"), "original_url", "left_anti")
        nothing = {"requested_ts": "string", "archive_status": "string", "from_excluded": "boolean"}
        return self.listed(with_missing(fresh, nothing).withColumn("kind", F.when(F.col("relation") == "link", "page").otherwise("dependency")), [*order, "original_url"], wave, f"wave{wave}")

    # captures of dependencies

    def looked_up(self, front: DataFrame, known: DataFrame, runs: DataFrame, lookups: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """The front with index_requests, index_refused, lookup_failed and lookup_note, and the captures that its lookups found, with
        the item that asked: a dependency that the inventory neither holds nor proves absent is looked up page by page, as far as
        pages are recorded and the budget of index requests goes. Pages that came before a refusal or failure count as the answer;
        without any the item waits, or fails. Without recorded lookups none is made."""
        nothing = {"index_requests": F.lit(0).cast("long"), "index_refused": F.lit(False), "lookup_failed": F.lit(False), "lookup_note": F.lit(None).cast("string")}
        if lookups is None:
            return front.withColumns(nothing), known.withColumn("asker", F.lit(None).cast("long")).where("false")
        most = self.project.max_lookup_pages
        asking = front.where(F.col("referring_timestamp").isNotNull() & ~self.absence_proved(runs, F.col("original_url"))).select(F.col("original_url").alias("capture_key"), F.col("ord").alias("asker"))
        absent = self.cut(asking.join(C.absent_keys(asking, known), "capture_key"), "absent")
        given = lookups.select(capture_key(F.col("original_url")).alias("capture_key"), F.col("page").cast("int").alias("page"), "body").where(F.col("page") < most)
        # page after page, as far as each is there: the first gap ends a lookup
        asked = absent.join(given, "capture_key")
        gap = asked.groupBy("capture_key").agg(F.collect_set(F.when(F.col("body").isNotNull(), F.col("page"))).alias("there"))
        upto = F.array_min(F.array_except(F.sequence(F.lit(0), F.lit(most)), F.col("there")))
        there = absent.join(gap, "capture_key", "left").select("capture_key", "asker", F.coalesce(upto, F.lit(0)).alias("there"))
        last = page_ends(asked.join(there.select("capture_key", "there"), "capture_key").where(F.col("page") == F.col("there") - 1), LOOKUP_ROWS, key="capture_key")
        # where the last recorded page says that more follow, one more request was made, and failed
        more = F.coalesce(F.col("resume_key").isNotNull(), F.lit(True)) & (F.col("there") < most)
        wants = there.join(last.select("capture_key", "resume_key", F.lit(True).alias("read")), "capture_key", "left").withColumn("wanted", (F.col("there") + F.when(F.when(F.col("read").isNull(), F.lit(True)).otherwise(F.col("resume_key").isNotNull()) & more, 1).otherwise(0)).cast("long"))
        turns = A.running_totals(wants, ["asker"], {"before": "wanted"}, self.cut)
        granted = F.least("wanted", F.greatest(F.lit(self.project.budgets.max_index_requests - self.spent.index_requests) - F.col("before"), F.lit(0)))
        turns = turns.withColumn("granted", granted.cast("long")).withColumn("pages", F.least("there", "granted").cast("int"))
        pages_said = F.concat(F.col("pages").cast("string"), F.lit(" page(s)"))
        note = (
            F.when(F.col("pages") == 0, F.lit(None).cast("string"))
            .when(F.col("granted") < F.col("wanted"), F.concat(F.lit("the index-requests budget stopped the capture lookup after "), pages_said, F.lit("; later captures were not retrieved")))
            .when(F.col("granted") > F.col("pages"), F.concat(F.lit("a later page of the capture lookup failed after "), pages_said))
            .when(F.col("resume_key").isNotNull(), F.concat(F.lit("capped after "), pages_said, F.lit(f" (assetResolution.maxLookupPages={most}); later captures were not retrieved")))
        )
        turns = self.cut(turns.select("capture_key", "granted", "pages", "there", note.alias("note")), "lookups")
        read = asked.join(turns.select("capture_key", "pages"), "capture_key").where(F.col("page") < F.col("pages")).withColumn("of", F.struct("capture_key", "page", "asker"))
        rows = page_rows(read, key="of").withColumn("ord", F.col("of.page").cast("long") * PAGE_ROWS + F.col("row_ord"))
        who = absent.select("capture_key", "asker")
        found = C.first_of_timestamp(self.typed(rows, F.col("of.capture_key"))).select(known.columns).join(who, "capture_key")
        marked = front.join(turns.withColumnRenamed("capture_key", "original_url"), "original_url", "left")
        return marked.withColumns({
            "index_requests": F.coalesce("granted", F.lit(0).cast("long")),
            "index_refused": F.coalesce(F.col("granted") == 0, F.lit(False)),
            "lookup_failed": F.coalesce((F.col("granted") > 0) & (F.col("there") == 0), F.lit(False)),
            "lookup_note": F.col("note"),
        }).drop("granted", "pages", "there", "note"), self.cut(found, "found")

    def resolved(self, front: DataFrame, known: DataFrame) -> DataFrame:
        """Dependencies aim at the capture nearest to their page's."""
        keyed = front.withColumn("item_id", item_id(F.col("original_url")))
        asked = keyed.where("referring_timestamp is not null").select(F.col("item_id").alias("dep_id"), F.col("original_url").alias("capture_key"), "referring_timestamp")
        answers = C.resolve_assets(asked, known, window_days=self.project.window_days).select(F.col("dep_id").alias("item_id"), "resolved_timestamp", "delta_seconds", "temporally_distant", "considered")
        drift = C.content_drift(known).select(F.col("capture_key").alias("original_url"), F.col("digests").cast("long").alias("digests"))
        status = known.select(F.col("capture_key").alias("original_url"), F.col("timestamp").alias("resolved_timestamp"), F.col("status_code").alias("resolved_status"), F.col("excluded_by").isNotNull().alias("resolved_excluded"))
        met = keyed.join(answers, "item_id", "left").join(status, ["original_url", "resolved_timestamp"], "left").join(drift, "original_url", "left")
        asset = F.col("referring_timestamp").isNotNull()
        said = F.when(asset & F.col("resolved_timestamp").isNotNull(), F.concat(F.lit("nearest of "), F.col("considered").cast("string"), F.lit(" captures is "), F.col("resolved_timestamp")))
        return met.withColumns({
            "requested_ts": F.when(asset, F.col("resolved_timestamp")).otherwise(F.col("requested_ts")),
            "archive_status": F.coalesce("archive_status", "resolved_status"),
            "from_excluded": F.coalesce("from_excluded", "resolved_excluded", F.lit(False)),
            "digests": F.when(asset, F.col("digests")),
            "resolution_detail": F.when(said.isNotNull() & F.col("lookup_note").isNotNull(), F.concat(said, F.lit("; "), F.col("lookup_note"))).otherwise(F.coalesce(said, "lookup_note")),
            "distance_text": format_days(F.col("delta_seconds")),
        }).drop("resolved_timestamp", "resolved_status", "resolved_excluded")

    # requests

    def recorded(self, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Recorded responses by normalised URL and capture: their bodies, and for each its tries without bodies. An item makes at
        most `max_attempts` tries of a URL, so later calls do not matter; the last call answers all that follow."""
        known = with_missing(responses, RECORDED).withColumns({"at_url": capture_key(F.col("original_url")), "at_ts": F.col("timestamp"), "call": F.coalesce("call", F.lit(0))})
        most = self.project.budgets.max_response_bytes
        known = known.where(F.col("call") < self.project.budgets.max_attempts).withColumns({
            "truncated": F.coalesce("truncated", F.lit(False)) | F.coalesce(F.octet_length("body") > most, F.lit(False)),
            "body": F.substring("body", 1, most),
        })
        known = self.cut(known.select("at_url", "at_ts", "call", "http_status", "content_type", "location", "memento", "retry_after", "truncated", "body"), "responses")
        size = F.coalesce(F.octet_length("body"), F.lit(0)).cast("long").alias("size")
        tries = known.groupBy("at_url", "at_ts").agg(F.sort_array(F.collect_list(F.struct("call", "http_status", "location", "retry_after", size))).alias("tries"))
        return known, self.cut(tries, "tries")

    def chain(self, front: DataFrame, tries: DataFrame) -> DataFrame:
        """How the requests of each item end: redirects are followed and failures tried again within the budgets of an item. Where
        a redirect leads is guarded like the endpoint: by scheme, credentials, port, host, and what the host resolves to."""
        project, budgets = self.project, self.project.budgets
        if self.endpoint_refusal is not None:
            none = {"at_url": "string", "at_ts": "string", "call": "int", "http_status": "int"}
            refused = failure(F.lit("destination-refused"), F.lit(self.endpoint_refusal), F.lit(None), F.lit(False))
            zero = {c: F.lit(0).cast("long") for c in ("requests", "bytes_read", "bytes_before_last", "wait_ms")}
            asked = front.where("requested_ts is not null and not lookup_failed").select("item_id")
            return with_missing(asked, none).withColumns({"failure": refused, **zero, "redirects": F.array().cast("array<string>")})
        backoff = max(project.min_interval_ms, 1000)
        walk = front.where("requested_ts is not null and not lookup_failed").select("item_id", F.col("requested_ts").alias("at_ts"), F.col("original_url").alias("at_url"), F.array(F.concat_ws(" ", "requested_ts", "original_url")).alias("visited"), F.lit(0).cast("long").alias("requests"), F.lit(0).cast("long").alias("bytes_read"), F.lit(0).cast("long").alias("wait_ms"))
        ended = []
        for hop in range(budgets.max_redirects + 1):
            met = walk.join(tries, ["at_url", "at_ts"], "left")
            made = met.withColumn("made", F.transform(F.sequence(F.lit(0), F.lit(budgets.max_attempts - 1)), lambda k: F.get("tries", F.least(k, F.size("tries") - 1))))
            again = lambda x: x["http_status"].isNull() | x["http_status"].isin(*A.THROTTLES) | (x["http_status"] >= 500)
            settled = F.array_position(F.transform("made", lambda x: ~F.coalesce(again(x), F.lit(True))), True)
            made = made.withColumn("n", F.when(settled > 0, settled).otherwise(F.lit(budgets.max_attempts)).cast("int")).withColumn("fails", F.when(settled > 0, F.col("n") - 1).otherwise(F.col("n")))
            last = F.get("made", F.col("n") - 1)
            total = lambda xs, of: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(of(x), F.lit(0)).cast("long"))
            status, location = last["http_status"], last["location"]
            parts = replay_parts(location)
            made = made.withColumns({
                "requests": F.col("requests") + F.col("n"),
                "bytes_before_last": F.col("bytes_read") + total(F.slice("made", 1, F.col("n") - 1), lambda x: x["size"]),
                "bytes_read": F.col("bytes_read") + total(F.slice("made", 1, F.col("n")), lambda x: x["size"]),
                "wait_ms": F.col("wait_ms") + total(F.slice("made", 1, F.col("fails")), lambda x: F.coalesce(x["retry_after"] * 1000, F.lit(backoff))),
                "call": F.coalesce(last["call"], F.lit(0)), "http_status": status, "location": location,
                "next_ts": parts["timestamp"], "next_url": capture_key(parts["original_url"]),
            })
            redirect = F.col("http_status").isin(*A.REDIRECTS)
            here = replay_url(F.lit(self.endpoint), F.col("at_ts"), F.col("at_url"), F.lit(IDENTITY_MODIFIER))
            made = made.withColumn("target", resolve_url(F.when(redirect, F.col("location")), here))
            made = self.with_refusal(made, F.col("target")).withColumn("refusal", F.when(redirect & (F.coalesce("location", F.lit("")) != ""), F.coalesce("refusal", F.when(F.col("target").isNull(), F.concat(F.lit("redirect target "), F.col("location"), F.lit(" is not a URL"))), F.when(F.col("next_url").isNull(), F.concat(F.lit("redirect target "), F.col("location"), F.lit(" is no capture"))))))
            to = F.concat_ws(" ", "next_ts", "next_url")
            kind = (
                F.when(F.col("http_status").isNull(), "transport-error")
                .when(F.col("http_status").isin(*A.THROTTLES), "provider-throttled")
                .when(redirect & (F.coalesce("location", F.lit("")) == ""), "http-status")
                .when(redirect & F.col("refusal").isNotNull(), "destination-refused")
                .when(redirect & F.array_contains("visited", to), "redirect-loop")
                .when(redirect & F.lit(hop == budgets.max_redirects), "redirect-limit")
                .when(redirect, "follow")
                .when(F.col("http_status") >= 400, "http-status")
            )
            step = self.cut(made.withColumns({"verdict": kind, "visited": F.when(redirect & F.col("next_url").isNotNull(), F.concat("visited", F.array(to))).otherwise(F.col("visited"))}).drop("tries", "made", "n", "fails", "target"), f"hop{hop}")
            ended.append(step.where("verdict is null or verdict != 'follow'"))
            walk = step.where("verdict = 'follow'").select("item_id", F.col("next_ts").alias("at_ts"), F.col("next_url").alias("at_url"), "visited", "requests", "bytes_read", "wait_ms")
            if walk.isEmpty():
                break
        done = functools.reduce(DataFrame.unionByName, ended)
        retryable = F.col("http_status").isNull() | F.col("http_status").isin(*A.THROTTLES, 408) | (F.col("http_status") >= 500)
        said = F.coalesce(F.when(F.col("verdict") == "destination-refused", F.col("refusal")), F.concat(F.lit("status "), F.coalesce(F.col("http_status").cast("string"), F.lit("none"))))
        failed = F.when(F.col("verdict").isNotNull(), failure(F.col("verdict"), said, F.col("http_status"), F.col("verdict").isin("transport-error", "provider-throttled", "http-status") & retryable))
        return done.select("item_id", "at_url", "at_ts", "call", "http_status", failed.alias("failure"), "requests", "bytes_read", "bytes_before_last", "wait_ms", F.slice("visited", 2, F.size("visited")).alias("redirects"))

    def asked(self, front: DataFrame, tries: DataFrame) -> DataFrame:
        """Items with the end of their requests: status, failure and what it cost; no body is read."""
        met = front.join(self.chain(front, tries), "item_id", "left")
        lost = failure(F.lit("transport-error"), F.lit("the capture lookup for this URL failed"), F.lit(None), F.lit(True))
        failed = F.when(F.col("lookup_failed"), lost).otherwise(F.col("failure"))
        status = F.when(failed.isNotNull(), "failed").when(F.col("requested_ts").isNull(), "skipped").otherwise("fetched")
        return met.withColumns({
            "failure": failed, "status": status, "local_path": local_path(F.col("original_url")),
            **{c: F.coalesce(c, F.lit(0).cast("long")) for c in ("requests", "bytes_read", "bytes_before_last", "wait_ms")},
            "unattempted_reason": F.when(status == "skipped", "out-of-scope"),
        })

    def answered(self, asked: DataFrame, responses: DataFrame) -> DataFrame:
        """Items with the bodies of those that were fetched."""
        answers = responses.select("at_url", "at_ts", "call", "content_type", "memento", "truncated", "body")
        got = asked.where("status = 'fetched'").select("item_id", "at_url", "at_ts", "call").join(answers, ["at_url", "at_ts", "call"], "left").select("item_id", "content_type", "memento", "truncated", "body")
        taken = F.col("status") == "fetched"
        final = replay_url(F.lit(self.endpoint), F.col("at_ts"), F.col("at_url"), replay_modifier(F.col("relation")))
        met = asked.join(got, "item_id", "left").withColumns({
            "body_hash": F.when(taken & F.col("body").isNotNull(), F.sha2("body", 256)),
            "served_ts": F.when(taken, served_timestamp(F.col("memento"), final)),
        })
        return met.withColumn("distance_seconds", distance_seconds(F.col("requested_ts"), F.col("served_ts"))).drop("at_url", "at_ts", "memento", "call", "index_refused")

    def admitted(self, asked: DataFrame) -> tuple[DataFrame, int | None]:
        """What was asked for as the budgets leave it, and the place of the item that one refused: from there on nothing is
        attempted. A request starts the spacing of requests after the one before it, plus what was waited for. Requests that the
        refused item had made by then stay charged."""
        budgets, spent, gap = self.project.budgets, self.spent, self.project.min_interval_ms
        sums = {"requests_before": "requests", "index_before": "index_requests", "bytes_sum": "bytes_read", "wait_sum": "wait_ms"}
        run = A.running_totals(asked.select("item_id", "ord", "requests", "index_requests", "index_refused", "bytes_read", "bytes_before_last", "wait_ms"), ["ord"], sums, self.cut)
        before = F.col("requests_before") + F.col("index_before") + spent.made
        own = F.col("requests") + F.col("index_requests")
        waited = F.col("wait_sum") + spent.wait_ms
        start = (before + own - 1) * gap + waited + F.col("wait_ms")
        reason = (
            F.when(F.col("index_refused"), "index requests")
            .when(own == 0, F.lit(None).cast("string"))
            .when(start >= budgets.max_elapsed_ms, "elapsed time")
            .when(before + own > budgets.max_requests, "requests")
            .when((F.col("requests") > 0) & (F.col("bytes_sum") + F.col("bytes_before_last") + spent.bytes >= budgets.max_total_bytes), "total bytes")
        )
        by_time = F.ceil((F.lit(budgets.max_elapsed_ms) - waited) / gap) - before if gap else F.lit(0)
        made = F.when(reason == "requests", budgets.max_requests - before).when(reason == "elapsed time", by_time).when(reason == "total bytes", own - 1).otherwise(0)
        made = F.greatest(F.lit(0), F.least(own - 1, made)).cast("long")
        refused = run.where(reason.isNotNull()).select("ord", F.least("index_requests", made).alias("index_made"), made.alias("made")).orderBy("ord").first()
        if refused is not None:
            asked = self.parked(asked, F.col("ord") >= refused.ord, "budget-exhausted")
            here = F.col("ord") == refused.ord
            asked = asked.withColumns({"index_requests": F.when(here, refused.index_made).otherwise(F.col("index_requests")).cast("long"), "requests": F.when(here, refused.made - refused.index_made).otherwise(F.col("requests")).cast("long")})
        went = asked.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("requests", "index_requests", "bytes_read", "wait_ms")]).first()
        spent.requests, spent.index_requests, spent.bytes, spent.wait_ms = spent.requests + went.requests, spent.index_requests + went.index_requests, spent.bytes + went.bytes_read, spent.wait_ms + went.wait_ms
        return asked, None if refused is None else refused.ord

    @staticmethod
    def parked(items: DataFrame, which: Column, reason: str) -> DataFrame:
        """Items that were not attempted: nothing of a request stays on them."""
        kinds = dict(items.dtypes)
        gone = [c for c in ("failure", "body", "body_hash", "served_ts", "distance_seconds", "content_type", "http_status", "truncated", "redirects", "delta_seconds", "temporally_distant", "distance_text", "digests", "considered", "resolution_detail", "lookup_note") if c in kinds]
        none = {c: F.when(~which, F.col(c)) for c in gone}
        zero = {c: F.when(which, F.lit(0).cast("long")).otherwise(F.col(c)) for c in ("requests", "index_requests", "bytes_read", "bytes_before_last", "wait_ms") if c in kinds}
        asset = {"requested_ts": F.when(which & F.col("referring_timestamp").isNotNull(), F.lit(None).cast("string")).otherwise(F.col("requested_ts"))}
        return items.withColumns({**none, **zero, **asset, "status": F.when(which, "unattempted").otherwise(F.col("status")), "unattempted_reason": F.when(which, reason).otherwise(F.col("unattempted_reason"))})

    def waiting(self, front: DataFrame, reason: str) -> DataFrame:
        """A front that is not attempted at all."""
        kinds = {"status": "string", "unattempted_reason": "string", "requests": "long", "index_requests": "long", "bytes_read": "long", "wait_ms": "long"}
        return self.parked(with_missing(front.withColumn("item_id", item_id(F.col("original_url"))), kinds), F.lit(True), reason)

    # the run

    def read_bodies(self, items: DataFrame, bodies: DataFrame) -> DataFrame:
        """Items with decoded, validated texts. A body that does not pass is a failed item."""
        read = validated(decode_bodies(items.drop("body"), bodies).withColumn("replacement_ratio", F.col("decoded.replacement_ratio")))
        return read.withColumn("status", F.when((F.col("status") == "fetched") & F.col("failure").isNotNull(), "failed").otherwise(F.col("status")))

    @staticmethod
    def contents(answered: DataFrame) -> DataFrame:
        return answered.where("body_hash is not null").select(F.col("body_hash").alias("hash"), F.col("body").alias("bytes")).dropDuplicates(["hash"])

    def wave(self, front: DataFrame, known: DataFrame, runs: DataFrame, lookups: DataFrame | None, recorded: tuple[DataFrame, DataFrame], number: int) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
        """One wave: (items with their texts, bodies, captures, whether a budget stopped it)."""
        responses, tries = recorded
        front, more = self.looked_up(front, known, runs, lookups)
        every = known.unionByName(more.drop("asker"))
        asked, refused = self.admitted(self.cut(self.asked(self.resolved(front, every), tries), f"asked{number}"))
        if lookups is not None:  # what was found for items that were not reached is not known
            known = self.cut(known.unionByName((more if refused is None else more.where(F.col("asker") <= refused)).drop("asker")), "captures")
        answered = self.cut(self.answered(asked, responses), f"fetched{number}")
        bodies = self.cut(self.contents(answered), f"bodies{number}")
        return self.cut(self.read_bodies(answered, bodies), f"read{number}"), bodies, known, refused is not None

    def work(self, state: State, front: DataFrame, lookups: DataFrame | None, recorded: tuple[DataFrame, DataFrame], signal: Callable[[], str]) -> None:
        """Waves from a front until nothing is left or something stops them; what is not reached is listed as unattempted."""
        while not front.isEmpty():
            state.stop = state.stop or {"pause": "paused", "cancel": "cancelled"}.get(signal())
            if state.stop:
                state.items = self.joined(state.items, self.waiting(front, state.stop))
                return
            read, held, state.known, exhausted = self.wave(front, state.known, state.runs, lookups, recorded, state.number)
            state.items, state.bodies = self.joined(state.items, read), held if state.bodies is None else state.bodies.unionByName(held)
            state.number += 1
            state.stop = "budget-exhausted" if exhausted else None
            front = self.found(read, state.listed, state.number)
            state.listed = state.listed.select("original_url").unionByName(front.select("original_url"))
            if state.number % 8 == 0:  # so that the plan does not grow with the waves
                state.items, state.bodies, state.listed = self.cut(state.items, "items"), self.cut(state.bodies, "bodies"), self.cut(state.listed, "listed")

    def reselect(self, state: State, lookups: DataFrame | None, recorded: tuple[DataFrame, DataFrame], signal: Callable[[], str]) -> None:
        """Pages without content try their next best captures, one a round: each try is a request like any other, in the order of
        the list, and what a page then refers to is acquired before the next round. A try that brings bytes takes the page's place, ok
        or not; one that fails leaves it. A page stops when a try is ok, its tries are spent or no capture is left; a budget that
        refuses a try stops the run."""
        project, most = self.project, self.project.reselection_attempts
        responses, tries = recorded
        target = selection_target(project.start, project.end) if project.start or project.end else None
        listed = [c.split()[0] for c in LISTED.split(", ")]
        attempt = lambda timestamp: F.struct(timestamp.alias("timestamp"), F.col("outcome").alias("outcome"))
        old = ("outcome", "outcome_source", "outcome_detail", "reference_eligible", "matched_template", "redirect_raw")
        now = None  # the list with its outcomes, as far as nothing came to it
        for _ in range(most):
            state.items = self.cut(state.items, "items")
            made = F.coalesce("reselection.attempts", F.array().cast("array<struct<timestamp:string,outcome:string>>"))
            further = F.greatest(F.size(made) - 1, F.lit(0))
            open_ = (F.col("kind") == "page") & F.col("requested_ts").isNotNull() & ~F.coalesce(F.col("reselection.stop").isin(*SETTLED), F.lit(False)) & (further < most)
            now = item_outcomes(state.items.drop(*old), self.cut)[0] if now is None else now.drop("reselection", *COSTS).join(state.items.select("item_id", "reselection", *COSTS), "item_id")
            poor = now.where(open_ & F.when(F.size(made) > 0, F.col("outcome") != "ok").otherwise(F.col("outcome").isin(*outcomes.RESELECTABLE)))
            poor = self.cut(poor.select("item_id", *listed, F.when(F.size(made) > 0, made).otherwise(F.array(attempt(F.col("requested_ts")))).alias("attempts"), F.struct(*COSTS).alias("paid")), "poor")
            if poor.isEmpty():
                return
            if said := {"pause": "paused", "cancel": "cancelled"}.get(signal()):
                state.stop = said
                return
            used = poor.select(F.col("original_url").alias("capture_key"), F.explode("attempts.timestamp").alias("timestamp")).unionByName(poor.select(F.col("original_url").alias("capture_key"), F.col("requested_ts").alias("timestamp")))
            own = state.known.join(poor.select(F.col("original_url").alias("capture_key")), "capture_key", "left_semi")
            pick = C.select_captures(C.unused_captures(own, used), policy=project.policy, target=target, cluster_days=project.cluster_days)
            picked = pick.select(F.col("capture_key").alias("original_url"), F.col("timestamp").alias("requested_ts"), F.col("status_code").alias("archive_status"), "from_excluded")
            met = self.cut(poor.drop("requested_ts", "archive_status", "from_excluded").join(picked, "original_url", "left"), "picked")
            nothing = {"index_requests": F.lit(0).cast("long"), "index_refused": F.lit(False), "lookup_failed": F.lit(False)}
            front = met.where("requested_ts is not null")
            asked, refused = self.admitted(self.cut(self.asked(front.drop("attempts", "paid").withColumns(nothing), tries), "tries"))
            went = asked if refused is None else asked.where(F.col("ord") < refused)
            answered = self.cut(self.answered(went, responses), "tried")
            held = self.cut(self.contents(answered), "bodies")
            looked = self.cut(self.read_bodies(answered, held), "looked")
            # What each try is called takes the collection as it then stands.
            better = looked.where("validated")
            rest = state.items.join(better.select("item_id"), "item_id", "left_anti")
            now, _, _ = item_outcomes(self.joined(rest, better).drop(*old), self.cut)
            called = now.join(better.select("item_id"), "item_id", "left_semi").select("item_id", "outcome")
            if not (lost := looked.where("not validated")).isEmpty():
                called = called.unionByName(item_outcomes(lost, self.cut)[0].select("item_id", "outcome"))
            record = met.join(called.select("item_id", F.col("outcome").alias("outcome"), F.lit(True).alias("went")), "item_id", "left")
            # A try costs its page, whether it takes its place or not; so the items add up to the spend.
            record = record.join(asked.select("item_id", F.struct(*COSTS).alias("cost")), "item_id", "left")
            paid = F.struct(*[(F.coalesce(F.col("paid")[c], F.lit(0)) + F.coalesce(F.col("cost")[c], F.lit(0))).cast("long").alias(c) for c in COSTS])
            tried = F.when(F.col("went"), F.concat("attempts", F.array(attempt(F.col("requested_ts"))))).otherwise(F.col("attempts"))
            stop = F.when(F.col("requested_ts").isNull(), "no-remaining-alternative").when(F.col("went").isNull(), F.when(F.col("ord") == F.lit(refused), "budget-exhausted")).when(F.col("outcome") == "ok", "ok").when(F.size("attempts") >= most, "attempt-limit")
            record = self.cut(record.select("item_id", F.struct(tried.alias("attempts"), stop.alias("stop")).cast(RESELECTION).alias("record"), paid.alias("paid")), "record")
            items = self.joined(rest, better.withColumn("reselection", F.lit(None).cast(RESELECTION)))
            # A page that a budget kept from its first try has not begun.
            begun = F.when((F.size("record.attempts") > 1) | F.col("record.stop").isNotNull(), F.col("record"))
            charged = {c: F.coalesce(F.col("paid")[c], F.col(c)) for c in COSTS}
            state.items = self.cut(items.join(record, "item_id", "left").withColumns({"reselection": F.coalesce(begun, "reselection"), **charged}).drop("record", "paid"), "items")
            state.bodies = held if state.bodies is None else state.bodies.unionByName(held)
            if refused is not None:
                state.stop = "budget-exhausted"
                return
            if looked.isEmpty():
                return
            front = self.found(better, state.listed, state.number)
            if front.isEmpty():
                continue
            state.listed = state.listed.select("original_url").unionByName(front.select("original_url"))
            self.work(state, front, lookups, recorded, signal)
            now = None
            if state.stop:
                return

    def resumed(self, items: DataFrame, retry_failed: bool, spend: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(what an earlier run settled, what is queued again in its order); what that run spent counts."""
        again = (F.col("status") == "unattempted") & (F.coalesce("unattempted_reason", F.lit("queued")) != "out-of-scope")
        if retry_failed:
            again = again | ((F.col("status") == "failed") & F.coalesce(F.col("failure.retryable"), F.lit(False)))
        queued = items.where(again).withColumn("requested_ts", F.when(F.col("referring_timestamp").isNull(), F.col("requested_ts")))
        front = self.cut(queued.select([c.split()[0] for c in LISTED.split(", ")]), "queued")
        sums = items.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("requests", "index_requests", "bytes_read", "wait_ms")], F.count_if(F.col("kind") == "page").alias("p"), F.count(F.lit(1)).alias("n"), F.coalesce(F.max("ord") + 1, F.lit(0)).alias("listed")).first()
        self.spent = Spent(sums.requests, sums.index_requests, sums.bytes_read, sums.wait_ms, sums.p, sums.n - sums.p, sums.listed)
        if spend is not None:
            self.spent = Spent(**spend.first().asDict())
        return items.where(~again), front

    def index_goes_on(self, index_pages: DataFrame, known: DataFrame, runs: DataFrame, settled: DataFrame, front: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """An inventory that had more to come takes in the pages that are there by now: (captures, runs, front)."""
        last = runs.first()
        if not (last.continued or last.failed):
            return known, runs, front
        asked, cut_short = self.charged_index(index_pages.where(F.col("page_ord") > last.through))
        if asked.isEmpty():
            return known, runs, front
        now = self.index_runs(asked, cut_short).select("run_id", "continued", "failed", (F.col("limit_reached") | F.lit(last.limit_reached)).alias("limit_reached"), F.greatest(F.col("through"), F.lit(last.through)).alias("through"))
        known = self.cut(C.first_of_timestamp(known.unionByName(self.inventory(asked))), "captures")
        listed = settled.select("original_url").unionByName(front.select("original_url"))
        return known, self.cut(now, "runs"), self.cut(front.unionByName(self.seeds(self.cut(self.choose(known), "chosen"), listed)), "queued")

    def execute(self, index_pages: DataFrame, responses: DataFrame, *, lookups: DataFrame | None = None, previous: dict[str, DataFrame] | None = None, retry_failed: bool = False, signal: Callable[[], str] = ALWAYS_GO) -> dict[str, DataFrame]:
        """All tables of a run: captures, runs, items, bodies, assets, gaps, spend, events and project. `lookups` holds recorded answers to lookups of one
        URL: original_url, page (from 0) and body. `previous` holds the tables of an earlier run of this job, which goes on
        where that one stopped. `signal` is asked before each wave and may say pause or cancel."""
        recorded = self.recorded(responses)
        settled = bodies = None
        self.events = []
        if previous is None:
            self.note("started", f"project {self.project.project_id}")
            asked, cut_short = self.charged_index(index_pages)
            known, runs = self.inventory(asked), self.index_runs(asked, cut_short)
            front = self.seeds(self.cut(self.choose(known), "chosen"))
        else:
            known, runs, bodies = previous["captures"], previous["runs"], previous["bodies"]
            settled, front = self.resumed(previous["items"], retry_failed, previous.get("spend"))
            self.note("resumed", f"{front.count()} item(s) queued")
            known, runs, front = self.index_goes_on(index_pages, known, runs, settled, front)
        number = 0 if settled is None else previous["items"].agg(F.coalesce(F.max("wave"), F.lit(0))).first()[0]
        listed = front if settled is None else settled.select("original_url").unionByName(front.select("original_url"))
        state = State(known, runs, settled, bodies, listed, number)
        self.work(state, front, lookups, recorded, signal)
        tables = self.finished(state, lookups, recorded, signal)
        self.note(*{None: ("completed", "nothing is left"), "budget-exhausted": ("paused", "budget exhausted")}.get(state.stop, (state.stop, "stopped by a signal")))
        return tables | {"events": self.history(previous), "project": self.declared()}

    @staticmethod
    def joined(items: DataFrame | None, more: DataFrame) -> DataFrame:
        return more if items is None else items.unionByName(more, allowMissingColumns=True)

    def finished(self, state: State, lookups: DataFrame | None, recorded: tuple[DataFrame, DataFrame], signal: Callable[[], str]) -> dict[str, DataFrame]:
        """Further captures of pages without content, then classification, fidelity and evidence of what was acquired."""
        known, runs, items = state.known, state.runs, state.items
        if items is None or "decoded" not in items.columns:  # nothing was attempted
            empty, _, known, _ = self.wave(self.spark.createDataFrame([], LISTED), known, runs, None, recorded, 0)
            items = self.joined(empty, items) if items is not None else empty
        fresh = {"outcome", "outcome_source", "outcome_detail", "reference_eligible", "structure", "boilerplate", "encoding", "assets", "cross-capture", "applied_weight", "weakest", "score", "band", "overridden", "promotion_blocked", "matched_template", "redirect_raw", "reselection_trail"}
        state.known, state.items = known, with_missing(items.drop(*fresh), {"reselection": RESELECTION})
        if state.stop is None:
            self.reselect(state, lookups, recorded, signal)
        tried = F.array_join(F.transform("reselection.attempts", lambda x: F.concat(x["timestamp"], F.lit("="), x["outcome"])), ", ")
        read, known, bodies = self.cut(state.items.withColumn("reselection_trail", tried), "items"), state.known, state.bodies
        bodies = self.cut((bodies if bodies is not None else self.spark.createDataFrame([], "hash string, bytes binary")).dropDuplicates(["hash"]), "bodies")
        assets = self.cut(read.where("referrer is not null").select(F.col("referrer").alias("page_url"), "original_url", (F.col("requested_ts").isNotNull()).alias("resolved"), (F.col("status") == "fetched").alias("acquired"), F.coalesce("temporally_distant", F.lit(False)).alias("distant")), "assets")
        overrides, thresholds = override_table(self.spark, self.project.overrides), (self.project.accept, self.project.accept_with_warning)
        done = self.cut(classify_collection(read, assets, known, self.cut, overrides=overrides, thresholds=thresholds), "done")
        partial = evidence.inventory_gaps(runs, self.project.url)
        spend = self.spark.createDataFrame([tuple(asdict(self.spent).values())], ", ".join(f"{c} long" for c in asdict(self.spent)))
        return {"captures": known, "runs": runs, "items": done, "bodies": bodies, "assets": assets, "gaps": self.cut(evidence.gaps(widened(done, self.project.window_days)).unionByName(partial), "gaps"), "spend": self.cut(spend, "spend")}
