"""Capture-index pages: the request for one, and its rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relictum.functions.markup import let
from relictum.operators.captures import FIELDS

CELLS = "array<array<string>>"


def index_url(endpoint: str, url: Column, *, match_type: str, limit: int, start: str | None = None, end: str | None = None, collapse: str | None = None, filters: tuple[str, ...] = (), resume_key: Column | None = None) -> Column:
    """The request for a page of the index."""
    pair = lambda name, value: F.concat(F.lit(name + "="), F.url_encode(value if isinstance(value, Column) else F.lit(str(value))))
    parts = [pair("url", url), pair("matchType", match_type), pair("output", "json"), pair("fl", ",".join(FIELDS)), pair("limit", limit)]
    parts += [pair(n, v) for n, v in (("from", start), ("to", end), ("collapse", collapse)) if v]
    parts += [pair("filter", f) for f in filters]
    parts.append(pair("showResumeKey", "true"))
    if resume_key is not None:
        parts.append(F.when(F.coalesce(resume_key, F.lit("")) != "", pair("resumeKey", resume_key)))
    return F.concat(F.lit(endpoint + "?"), F.concat_ws("&", *parts))


def parsed(body: Column) -> Column:
    return F.from_json(F.trim(body), CELLS)


def page_rows(pages: DataFrame, *, key: str = "page_ord", body: str = "body") -> DataFrame:
    """Rows of index pages: an array of arrays whose first one names the columns. The data end at the first empty array.
    Missing columns and cells are empty strings."""
    name_of = lambda header, name: F.array_position(header, name).cast("int")

    def data(rest: Column, end: Column) -> Column:
        return F.when(end > 0, F.slice(rest, 1, F.greatest(end - 1, F.lit(0)).cast("int"))).otherwise(rest)

    def rows_of(cells: Column) -> Column:
        header = F.coalesce(F.get(cells, 0), F.array().cast("array<string>"))
        places = F.struct(*[name_of(header, n).alias(n) for n in FIELDS])
        rest = F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))
        kept = let(rest, lambda r: let(F.array_position(F.transform(r, lambda x: F.size(x) == 0), True), lambda e: data(r, e)))
        cell = lambda row, at, n: F.coalesce(F.when(at[n] > 0, F.get(row, at[n] - 1)), F.lit("")).alias(n)
        return let(places, lambda at: F.transform(kept, lambda row: F.struct(*[cell(row, at, n) for n in FIELDS])))

    # one generator does it all, so that a page is parsed once, not once for each mention of its cells
    found = pages.select(key, F.posexplode(let(parsed(F.col(body)), rows_of)).alias("row_ord", "row"))
    return found.select(key, "row_ord", *[F.col("row")[n].alias(n) for n in FIELDS])


def page_ends(pages: DataFrame, limit: int, *, key: str = "page_ord", body: str = "body") -> DataFrame:
    """For each page: its number of rows, the key that resumes after it, and whether it filled the limit."""
    cells = pages.select(key, parsed(F.col(body)).alias("cells"))
    rest = F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0)))
    end = F.array_position(F.transform(rest, lambda r: F.size(r) == 0), True)
    n = F.when(end > 0, end - 1).otherwise(F.greatest(F.size("cells") - 1, F.lit(0))).cast("long")
    after = F.get(rest, end.cast("int"))
    return cells.select(key, F.coalesce(n, F.lit(0)).alias("n_rows"), F.when((end > 0) & (F.size(after) == 1), F.get(after, 0)).alias("resume_key"), (F.coalesce(n, F.lit(0)) >= limit).alias("limit_reached"))


def proves_absence(complete: bool, bounded: bool, match_type: str, host: Column, inventory_host: str) -> Column:
    """Whether an inventory that lacks a URL shows that no capture exists."""
    if not complete or bounded or match_type not in ("domain", "host"):
        return F.lit(False)
    same = host == inventory_host
    return same | host.endswith("." + inventory_host) if match_type == "domain" else same


def page_end(body: str, limit: int) -> tuple[str | None, bool]:
    """The key that resumes after a page, and whether it filled the limit."""
    rows = json.loads(body)[1:]
    end = next((i for i, r in enumerate(rows) if not r), len(rows))
    after = rows[end + 1] if end + 1 < len(rows) else []
    return (after[0] if len(after) == 1 else None), end >= limit
