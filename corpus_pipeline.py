"""A corpus from the table of documents: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relictum.llm.common import free_name, materialize, table
from relictum.llm.decontaminate import drop_leaks
from relictum.llm.queries import QUALITY_THRESHOLD, mixed
from relictum.llm.quality import fit_quality, score_quality
from relictum.llm.secret_scan import redact_secrets
from relictum.llm.simhash_wide import drop_similar


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return score_quality(docs, model, score_col=score).where(F.col(score) >= QUALITY_THRESHOLD).drop(score)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies stays: those alike in four fifths of their five-word shingles."""
    return drop_similar(docs, similarity=0.8)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text give way to a mark, and n_chars follows where it is known."""
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(F.coalesce("text", F.lit(""))).cast("long")))


def draw_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by calibrated probabilities; an inverse probability weights each."""
    return mixed(docs, texts=True).where("selected").withColumn("weight", 1 / F.col("probability")).drop("selected")


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", keep_uncontaminated),
    ("secret scans", remove_secrets),
    ("mixing sources to target weights", draw_mixture),
]

#: Trained scores, fingerprints and alignments are beyond SQL; tests compare each stage with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, f"stage{number}")
    return docs
