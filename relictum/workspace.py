"""The folder that driver and executors share, and the tables that a session keeps there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def workdir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`, or that of SparkContext.setCheckpointDir. Only a local session may do without: it
    gets a folder of this machine."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="relictum-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def own_folder(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{workdir(spark)}/relictum/{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write a table in the shared folder and read it back: this cuts the lineage and survives lost executors. Spark deletes the
    shuffle files of a written table; that setting is made once for the session, so that threads do not undo it, and stays on.
    `by` names a column of few values whose rows lie apart, so that a filter on it reads nothing else."""
    spark = df.sparkSession
    if spark.conf.get(CLEANUP, "false") != "true":
        spark.conf.set(CLEANUP, "true")
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def clear_tables(spark: SparkSession) -> None:
    """Delete the tables of this application. Results that were not written yet are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
