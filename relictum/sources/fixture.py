"""A Python data source of recorded responses: what a provider would have answered, from a manifest of rules."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from relictum.operators.acquisition import running_totals
from relictum.workspace import cut

RULES = "description string, dns map<string,array<string>>, rules array<struct<id:string,urlIncludes:array<string>,urlExcludes:array<string>,respond:array<struct<error:string,status:int,headers:map<string,string>,bodyText:string,bodyUtf8:string,bodyBytes:array<int>>>>>"
ROWS = "rule_ord int, rule_id string, includes array<string>, excludes array<string>, call int, last boolean, error string, status int, headers map<string,string>, body binary"


class RulePartition(InputPartition):
    def __init__(self, number: int, rule: dict) -> None:
        self.number, self.rule = number, rule


class FixtureReader(DataSourceReader):
    def __init__(self, manifest: str) -> None:
        self.rules = json.loads(manifest)["rules"]

    def partitions(self) -> list[InputPartition]:
        return [RulePartition(i, r) for i, r in enumerate(self.rules)]

    def read(self, partition: RulePartition) -> Iterator[tuple]:
        rule = partition.rule
        for call, r in enumerate(rule["respond"]):
            if r.get("bodyBytes") is not None:
                body = bytes(r["bodyBytes"])
            elif r.get("bodyUtf8") is not None:
                body = r["bodyUtf8"].encode()
            else:
                body = (r.get("bodyText") or "").encode("latin-1", errors="replace")
            yield partition.number, rule["id"], rule["urlIncludes"], rule.get("urlExcludes") or [], call, call == len(rule["respond"]) - 1, r.get("error"), r.get("status"), r.get("headers") or {}, body


class FixtureSource(DataSource):
    """`spark.read.format("fixture").option("manifest", json text)`."""

    @classmethod
    def name(cls) -> str:
        return "fixture"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> FixtureReader:
        return FixtureReader(self.options["manifest"])


def read_fixture(spark: SparkSession, manifest: str) -> DataFrame:
    spark.dataSource.register(FixtureSource)
    return spark.read.format("fixture").option("manifest", manifest).load()


def answer(requests: DataFrame, fixture: DataFrame, max_bytes: int) -> DataFrame:
    """Each request (ord, url) with its response: the first rule all of whose parts the URL holds and none of whose
    exclusions; a rule's nth request gets its nth response, and the last one repeats. Bodies are cut at `max_bytes`. Rules come
    from a manifest that the driver reads, so they are few; their bodies are joined by rule and call."""
    rules = fixture.select("rule_ord", "includes", "excludes").distinct()
    fits = F.forall("includes", lambda x: F.col("url").contains(x)) & ~F.exists("excludes", lambda x: F.col("url").contains(x))
    matched = requests.join(F.broadcast(rules), fits, "left").groupBy("ord", "url").agg(F.min("rule_ord").alias("rule_ord"))
    ranked = running_totals(matched, ["rule_ord", "ord"], {}, cut)
    calls = fixture.groupBy("rule_ord").agg(F.max("call").alias("last_call"))
    first = ranked.groupBy("rule_ord").agg(F.min("rank").alias("first_rank")).join(calls, "rule_ord")
    numbered = ranked.join(first, "rule_ord", "left").withColumn("call", F.least(F.col("rank") - F.col("first_rank"), F.col("last_call")).cast("int"))
    met = numbered.join(fixture.select("rule_ord", "call", "error", "status", "headers", "body"), ["rule_ord", "call"], "left")
    body = F.substring("body", 1, max_bytes)
    return met.select("ord", "url", "rule_ord", "error", "status", "headers", body.alias("body"), (F.octet_length("body") > max_bytes).alias("truncated"))
