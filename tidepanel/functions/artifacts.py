"""Intermediate tables that several queries build on: written once per session, read back with a short plan."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame

_known: dict[tuple, DataFrame] = {}


def folder(df: DataFrame) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where the session names none, one machine gets a temporary one; a cluster fails."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="artifacts-"))
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """``df`` as Parquet files in the shared folder, read back: later plans start from a scan, with pruning and pushdown."""
    path = f"{folder(df)}/artifacts/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def artifact(f):
    """Makes ``f(spark, path)`` a table that is computed once per session and input path."""

    @functools.wraps(f)
    def get(spark, path):
        key = (spark.sparkContext.applicationId, f.__module__, f.__name__, path)
        if key not in _known:
            _known[key] = materialise(f(spark, path))
        return _known[key]

    return get
