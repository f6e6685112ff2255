"""Cutting lineage through the shared checkpoint folder, and links to connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _ready(spark: SparkSession):
    """The context, its checkpoint folder set. Where the session names none, one machine gets a temporary folder; a cluster fails."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context


def cut(df: DataFrame) -> DataFrame:
    """``df`` read back from a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names.

    Only where the session names none (tests on one machine) a temporary folder is set.
    """
    _ready(df.sparkSession)
    return df.checkpoint(eager=True)


def components(links: DataFrame) -> DataFrame:
    """Connected components of an undirected graph of links (``a``, ``b``: long, no nulls).

    Returns ``id``, ``component`` (the smallest id reachable) for every vertex that can reach a smaller
    one. Vertices without a row are the smallest of their component, or alone. Repeated links and both directions are fine; no links give no rows.

    Alternates large-star and small-star steps (each a join of links with per-vertex minima, and a
    distinct), which shrink any graph to stars in a logarithmic number of rounds. Minima are combined
    before each shuffle and the joins may be split where a vertex has many links. Each round is cut by a
    checkpoint; nothing but a count and a checksum comes to the driver.
    """
    edges = cut(links.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    state = _checksum(edges)
    while state[0]:
        both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
        least = both.groupBy(F.col("a").alias("k")).agg(F.least(F.min("b"), F.min("a")).alias("m"))
        edges = both.where("b > a").join(least, F.col("a") == F.col("k")).where("b <> m").selectExpr("b AS a", "m AS b").distinct()
        least = edges.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        linked = edges.join(least, F.col("a") == F.col("k"))
        edges = cut(linked.selectExpr("inline(array(struct(a, m AS b), struct(b AS a, m AS b)))").where("a <> b").distinct())
        now = _checksum(edges)
        if now == state:
            break
        state = now
    return edges.selectExpr("a AS id", "b AS component")


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spared(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with the columns that are called like one of ``names`` (in any case) renamed; the order stays."""
    out = list(df.columns)
    for i, c in enumerate(out):
        while c.lower() in names:
            c = f"_{c}"
            while c.lower() in {o.lower() for o in out}:
                c = f"_{c}"
        out[i] = c
    return df.toDF(*out)


def written(df: DataFrame) -> DataFrame:
    """``df`` read back from Parquet files in the checkpoint folder: smaller than :func:`cut` for large tables.

    Like checkpoints of sessions that ended, the files stay until the folder is cleared.
    """
    context = _ready(df.sparkSession)
    path = f"{context.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
