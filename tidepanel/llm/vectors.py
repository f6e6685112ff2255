"""Vectors of Arrow list columns: which are usable, and distinct ones with their rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """True for vectors that are neither null nor empty nor zero and have only finite components."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose rows have one length and no nulls, as rows of float32 (float64 if it holds doubles)."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0), np.float32)


def by_length(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length that the vectors of a list column have."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return [(rows := np.flatnonzero(lengths == d), matrix(column.take(pa.array(rows)))) for d in np.unique(lengths)]


def sample(df: DataFrame, vector: str, key: str, most: int) -> list[np.ndarray]:
    """The ``most`` vectors with the smallest hashed keys; one matrix for each length."""
    got = df.select(F.col(vector).alias("v"), F.xxhash64(F.lit(17), key).alias("h"), F.col(key).alias("k")).orderBy("h", "k").limit(most).select("v").toArrow()
    return [m.astype(np.float64) for _, m in by_length(got.column(0).combine_chunks())] if got.num_rows else []
