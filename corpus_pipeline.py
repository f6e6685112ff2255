"""Documents to packed training sequences: each stage works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.lineage import read, written
from tidepanel.llm.mixing import mixed
from tidepanel.llm.packing import pack
from tidepanel.llm.quality import keep_good
from tidepanel.llm.simhash import keep_one
from tidepanel.llm.substrings import without_repeats

ARROW_ROWS = 1000  # of a batch at most: whole texts differ much in length, and a worker and its executor each hold batches


def in_small_batches(stage: Callable) -> Callable:
    """``stage`` in a session whose Arrow batches have at most ``ARROW_ROWS`` rows; a session that names fewer keeps its number."""

    @wraps(stage)
    def wrapped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
            spark.conf.set(key, str(ARROW_ROWS))
        return stage(spark, docs, sf_dir)

    return wrapped


@in_small_batches
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


@in_small_batches
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return keep_one(docs)


@in_small_batches
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; ``n_chars`` follows the text."""
    out = without_repeats(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else out


@in_small_batches
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as it is taken."""
    return mixed(docs)


@in_small_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their token ids."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Not expressible: classifier, XXH64 fingerprints and tokenizer are outside SQL. tests/llm/test_pipeline.py checks run() instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
