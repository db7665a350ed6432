"""A scan of the capture index as a stream: one page after the other, each asked for with the key that the one before gave.

An offset says which page comes next, by which key, how many requests were made and how the scan stands, so the checkpoint of the
stream is the scan's own record: a scan that was cut off, in whatever moment, goes on from it, and the pages are written exactly
once by the file sink's log. Pages whose batch was cut off before it was written are asked for once more.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from relictum.sources.cdx import page_end

PAGES = "page_ord long, resume_key string, body string"
OPEN, COMPLETE, FAILED = "open", "complete", "failed"
#: Pages of so many characters together are written at once, so that a page does not cost what a batch costs; but at most a quarter
#: of those before them, since a batch that is cut off asks for its pages again.
BATCH_CHARS = 32 << 20
#: Gives the body of the page that a key leads to (None: the first one), or None if the request failed.
Fetch = Callable[[str | None], str | None]


class IndexReader(SimpleDataSourceStreamReader):
    def __init__(self, fetch: Fetch, limit: int, most: int, run: str) -> None:
        self.fetch, self.limit, self.most, self.run = fetch, limit, most, run

    def initialOffset(self) -> dict:
        return {"page": 0, "key": "", "requests": 0, "state": OPEN, "run": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """The next pages, as many as make up a batch; nothing once the scan is complete, its requests are spent, or one has failed in
        this run."""
        pages, at, size = [], start, 0
        while size < BATCH_CHARS and len(pages) <= start["page"] // 4 and not (at["state"] == COMPLETE or at["requests"] >= self.most or (at["state"] == FAILED and at["run"] == self.run)):
            body = self.fetch(at["key"] or None)
            made = at | {"requests": at["requests"] + 1, "run": self.run}
            if body is None:
                at = made | {"state": FAILED}
                break
            key, _ = page_end(body, self.limit)
            pages.append((at["page"], at["key"], body))
            at, size = made | {"page": at["page"] + 1, "key": key or "", "state": OPEN if key else COMPLETE}, size + len(body)
        return iter(pages), at

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        key = start["key"]
        for page in range(start["page"], end["page"]):
            body = self.fetch(key or None)
            if body is None:
                raise RuntimeError(f"page {page} of the index cannot be read again")
            yield page, key, body
            key = page_end(body, self.limit)[0] or ""


def index_source(fetch: Fetch, limit: int) -> type[DataSource]:
    """`spark.readStream.format("capture-index")` over `fetch`; options: most (requests in all) and run (a name for this run)."""

    class IndexSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "capture-index"

        def schema(self) -> str:
            return PAGES

        def simpleStreamReader(self, schema) -> IndexReader:
            return IndexReader(fetch, limit, int(self.options["most"]), self.options["run"])

    return IndexSource


def scan_offset(spark: SparkSession, path: str) -> dict | None:
    """Where the scan at `path` stands; None if it has not begun."""
    jvm = spark._jvm.org.apache.hadoop.fs
    folder = jvm.Path(f"{path}/checkpoint/commits")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    done = [int(n) for f in fs.listStatus(folder) if (n := f.getPath().getName()).isdigit()]
    lines = spark.read.text(f"{path}/checkpoint/offsets/{max(done)}", wholetext=True).first().value.splitlines() if done else []
    return json.loads(lines[-1]) if lines else None


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """The pages that a scan has written."""
    return spark.read.schema(PAGES).parquet(f"{path}/pages")


def scan_index(spark: SparkSession, fetch: Fetch, path: str, *, limit: int, most: int, enough: Callable[[DataFrame], bool] | None = None) -> tuple[DataFrame, dict]:
    """(page_ord, resume_key, body) of an index scan kept at `path`, and where it stands. It goes on from where an earlier call, or one
    that was cut off, left it, until the index ends, a request fails, `most` requests were made in all, or `enough` says of the
    pages so far that no more are needed. A request that failed is a last row without a body."""
    spark.dataSource.register(index_source(fetch, limit))
    run = uuid.uuid4().hex

    def go(upto: int) -> dict:
        pages = spark.readStream.format("capture-index").option("most", upto).option("run", run).load()
        query = pages.coalesce(1).writeStream.format("parquet").option("path", f"{path}/pages").option("checkpointLocation", f"{path}/checkpoint").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return scan_offset(spark, path) or {"page": 0, "key": "", "requests": 0, "state": OPEN, "run": ""}

    if enough is None:
        at = go(most)
    else:
        before, at = None, scan_offset(spark, path) or {"requests": 0, "state": OPEN}
        while at != before and at["requests"] < most and at["state"] != COMPLETE and not (at["requests"] and enough(scanned(spark, path))):
            before, at = at, go(at["requests"] + 1)
            if at["state"] == FAILED:
                break
    pages = scanned(spark, path) if at["requests"] else spark.createDataFrame([], PAGES)
    if at["state"] == FAILED:
        pages = pages.unionByName(spark.range(1).select(F.lit(at["page"]).cast("long").alias("page_ord"), F.lit(at["key"]).alias("resume_key"), F.lit(None).cast("string").alias("body")))
    return pages, at


def recorded_pages(path: str) -> Fetch:
    """Answers from recorded pages: a Parquet table (resume_key, body) in a folder that the driver can open by its address. Where a key
    lies is read once, from the keys alone; of bodies one row group at a time is held."""
    places, held = {}, {}

    def fetch(key: str | None) -> str | None:
        import pyarrow.dataset as ds

        if not places:
            for fragment in ds.dataset(path, format="parquet").get_fragments():
                for group in fragment.split_by_row_group():
                    for row, k in enumerate(group.to_table(columns=["resume_key"]).column(0).to_pylist()):
                        places.setdefault(k, (group, row))
        if (key or "") not in places:
            return None
        group, row = places[key or ""]
        if held.get("group") is not group:
            held.update(group=group, bodies=group.to_table(columns=["body"]).column(0))
        return held["bodies"][row].as_py()

    return fetch
