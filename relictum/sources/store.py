"""Stored tables: bodies by the hash of their content, and the tables of a job behind a version.

Both are kept in snapshots: a writer puts files where no reader looks, then one small manifest, by a rename that fails if its
number is taken. Readers follow the manifest of the highest number, so they see all of a commit or nothing of it, and a writer
that another one overtook joins its files to the newer manifest. Files that no kept manifest names are swept.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relictum.functions.url import store_path

JOB_VERSION = 5
STORED = "hash string, byte_length long, store_path string, bytes binary, prefix string"
MANIFEST = re.compile(r"manifest-(\d{12})\.json")
#: Manifests that a sweep keeps, and the age below which files may belong to a writer at work.
KEPT_MANIFESTS, SWEEP_AGE_S = 2, 24 * 3600
REPORT_VERSION = 6


def bodies_by_hash(bodies: DataFrame, column: str = "bytes") -> DataFrame:
    """One row for each content: hash, byte_length, store_path, bytes and how many rows held it."""
    hashed = bodies.select(F.sha2(column, 256).alias("hash"), F.col(column).alias("bytes"))
    once = hashed.groupBy("hash").agg(F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("references"))
    return once.select("hash", F.octet_length("bytes").cast("long").alias("byte_length"), store_path(F.col("hash")).alias("store_path"), "bytes", "references")


class Snapshots:
    """The manifests of one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.jvm = spark._jvm.org.apache.hadoop.fs
        self.folder = self.jvm.Path(path)
        self.fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        if not self.fs.exists(self.folder):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self.folder)]
        return sorted(int(m[1]) for n in names if (m := MANIFEST.fullmatch(n)))

    def named(self, number: int) -> str:
        return f"{self.path}/manifest-{number:012}.json"

    def read(self, number: int | None = None) -> tuple[int, dict]:
        """The manifest of a number, or the newest one; (0, {}) if there is none."""
        if number is None:
            number = max(self.numbers(), default=0)
        return (number, json.loads(self.spark.read.text(self.named(number), wholetext=True).first().value)) if number else (0, {})

    def commit(self, number: int, said: dict) -> bool:
        """Make `said` the manifest of a number; False if another writer has taken it."""
        draft = self.jvm.Path(f"{self.path}/_draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(json.dumps(said, sort_keys=True).encode())
        out.close()
        taken = self.fs.exists(self.jvm.Path(self.named(number)))
        done = not taken and self.fs.rename(draft, self.jvm.Path(self.named(number)))
        if not done:
            self.fs.delete(draft, False)
        return done

    def sweep(self, folder: str, age_s: int = SWEEP_AGE_S) -> list[str]:
        """Delete old manifests, and parts below `folder` that none of those kept names and no writer can still be at work on."""
        numbers = self.numbers()
        for n in numbers[:-KEPT_MANIFESTS]:
            self.fs.delete(self.jvm.Path(self.named(n)), False)
        held = {p for n in numbers[-KEPT_MANIFESTS:] for p in self.read(n)[1]["parts"]}
        top = self.jvm.Path(f"{self.path}/{folder}")
        found = self.fs.listStatus(top) if self.fs.exists(top) else []
        old = [f for f in found if f"{folder}/{f.getPath().getName()}" not in held and f.getModificationTime() <= (time.time() - age_s) * 1000]
        for f in old:
            self.fs.delete(f.getPath(), True)
        return [f.getPath().getName() for f in old]


def stored_bodies(spark: SparkSession, path: str) -> DataFrame:
    """All that a store holds, part by part; a content that two writers added at once is there twice."""
    parts = Snapshots(spark, path).read()[1].get("parts", [])
    if not parts:
        return spark.createDataFrame([], STORED)
    return reduce(DataFrame.unionByName, [spark.read.schema(STORED).parquet(f"{path}/{p}") for p in parts])


def write_part(fresh: DataFrame, path: str) -> str:
    """Contents into a part that no manifest names yet; files are parted by the first two letters of the hash, and written by as
    many tasks as the first three tell apart."""
    part = f"parts/{uuid.uuid4().hex}"
    fresh.withColumn("prefix", F.substring("hash", 1, 2)).repartition("prefix", F.substring("hash", 3, 1)).write.partitionBy("prefix").parquet(f"{path}/{part}")
    return part


def write_bodies(bodies: DataFrame, path: str, *, most_parts: int = 64) -> None:
    """Add the contents that the store lacks. The store is compacted when it has more than `most_parts` parts."""
    spark = bodies.sparkSession
    held = stored_bodies(spark, path).select("prefix", "hash")
    fresh = bodies_by_hash(bodies).drop("references").withColumn("prefix", F.substring("hash", 1, 2)).join(held, ["prefix", "hash"], "left_anti").drop("prefix")
    part = write_part(fresh, path)
    snapshots = Snapshots(spark, path)
    while True:  # a writer that was overtaken adds its part to the newer manifest
        number, said = snapshots.read()
        parts = [*said.get("parts", []), part]
        if snapshots.commit(number + 1, {"parts": parts}):
            break
    if len(parts) > most_parts:
        compact_bodies(spark, path)


def compact_bodies(spark: SparkSession, path: str) -> bool:
    """One part in place of all, each content once; False, and nothing changed, if a writer came between."""
    snapshots = Snapshots(spark, path)
    number, said = snapshots.read()
    once = stored_bodies(spark, path).groupBy("hash").agg(F.first("byte_length").alias("byte_length"), F.first("store_path").alias("store_path"), F.first("bytes").alias("bytes"))
    done = snapshots.commit(number + 1, {"parts": [write_part(once, path)]}) if said.get("parts") else False
    return done


def read_bodies(spark: SparkSession, path: str, hashes: DataFrame) -> DataFrame:
    """Stored contents of the hashes, each once; a hash that the store lacks has null bytes. The prefix takes part in the join, so
    that only the parts that are asked for are read."""
    parted = hashes.withColumn("prefix", F.substring("hash", 1, 2))
    keys = parted.select("prefix", "hash").distinct()
    held = keys.join(stored_bodies(spark, path), ["prefix", "hash"]).groupBy("hash").agg(F.first("byte_length").alias("byte_length"), F.first("store_path").alias("store_path"), F.first("bytes").alias("bytes"))
    return parted.drop("prefix").join(held, "hash", "left")


def save_job(tables: dict[str, DataFrame], path: str) -> None:
    """Every table of a job into a folder of its own, then the manifest that makes them the job. The job that was there stays
    whole until then, so its tables may be among those that are read."""
    spark = next(iter(tables.values())).sparkSession
    snapshots, folder = Snapshots(spark, path), f"saves/{uuid.uuid4().hex}"
    number, said = snapshots.read()
    for name, df in tables.items():
        df.write.parquet(f"{path}/{folder}/{name}")
    if not snapshots.commit(number + 1, {"version": JOB_VERSION, "parts": [folder], "tables": sorted(tables)}):
        raise RuntimeError(f"the job in {path} was saved by another run")
    snapshots.sweep("saves")


def load_job(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The tables of a job, None if there is none; a job of another version is refused."""
    number, said = Snapshots(spark, path).read()
    if not number:
        return None
    if said["version"] != JOB_VERSION:
        raise ValueError(f"job version {said['version']} is not {JOB_VERSION}")
    return {name: spark.read.parquet(f"{path}/{said['parts'][0]}/{name}") for name in said["tables"]}


def load_manifest(spark: SparkSession, path: str) -> str:
    """A fixture manifest as text, checked for its rules."""
    text = spark.read.text(path, wholetext=True).first().value
    if not isinstance(json.loads(text).get("rules"), list):
        raise ValueError(f"{path} has no rules")
    return text


def revision(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def recorded_revisions(spark: SparkSession, path: str) -> list[dict]:
    """Revisions that an earlier report at `path` records; none if there is no report."""
    try:
        return json.loads(spark.read.text(path, wholetext=True).first().value).get("revisions", [])
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []


def write_report(spark: SparkSession, report: dict, path: str, revision_now: dict, lists: dict[str, DataFrame] | None = None) -> None:
    """A report as JSON. Revisions recorded before stay; a new one is added once. Its lists go as lines of JSON to a folder beside
    it that the report names, new for each report, so that totals and lists are always of one job."""
    kept = recorded_revisions(spark, path)
    revisions = kept if revision_now in kept else [*kept, revision_now]
    if lists:
        report = report | {"lists": {name: f"{path}.lists/{uuid.uuid4().hex}/{name}" for name in lists}}
        for name, df in lists.items():
            df.write.json(report["lists"][name])
    text = json.dumps(report | {"schemaVersion": REPORT_VERSION, "revisions": revisions}, indent=2, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def summary(report: dict) -> str:
    """One screen of counts."""
    lines = [", ".join(f"{k} {v}" for k, v in report["counts"].items())]
    for name in ("outcomes", "bands", "gaps"):
        lines += [f"{name}: " + ", ".join(f"{k} {v}" for k, v in sorted(report[name].items()) if v)]
    return "\n".join(lines)
