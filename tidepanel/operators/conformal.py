"""Hierarchical conformal calibration: the finest cell with enough calibration rows decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.columns import finite, linear_quantile, rank_quantile, upper_rank

LEVELS = (("model", "hp_type", "horizon", "temperature_regime"), ("model", "hp_type", "horizon"), ("model", "horizon"), ("model",))


def temperature_thresholds(calibration: DataFrame, quantile: float = 0.05, temperature: str = "temperature_c") -> DataFrame:
    """(``hp_type``, ``cold_below``): the linear quantile of each type's finite temperatures."""
    t = finite(F.col(temperature))
    return linear_quantile(calibration.select("hp_type", t.alias("_t")), ["hp_type"], "_t", quantile, "cold_below")


def with_regime(df: DataFrame, thresholds: DataFrame, temperature: str = "temperature_c") -> DataFrame:
    """Adds ``temperature_regime``: cold, normal, or unknown where temperature or threshold is missing."""
    t = finite(F.col(temperature))
    joined = df.join(F.broadcast(thresholds), "hp_type", "left")
    regime = F.when(t.isNull() | F.col("cold_below").isNull(), "unknown").when(t <= F.col("cold_below"), "cold").otherwise("normal")
    return joined.withColumn("temperature_regime", regime).drop("cold_below")


def score(y: Column, low: Column, high: Column) -> Column:
    return F.greatest(low - y, y - high, F.lit(0.0))


def corrections(calibration: DataFrame, alpha: float = 0.2, least: int = 100, levels=LEVELS) -> DataFrame:
    """One row per cell with at least ``least`` rows, and the pooled one: level, its keys, correction and size.

    One pass: every row goes to each of its levels, and one window ranks all cells.
    """
    keys = list(dict.fromkeys(k for level in levels for k in level))
    scored = calibration.select(*keys, score(F.col("y_true"), F.col("q10"), F.col("q90")).alias("_s"))
    cells = F.array(*(F.struct(F.lit(i).alias("level"), *(F.col(k).alias(k) if k in level else F.lit(None).cast(calibration.schema[k].dataType).alias(k) for k in keys)) for i, level in enumerate((*levels, ()))))
    rows = scored.select("_s", F.explode(cells).alias("c")).select("_s", "c.*")
    table = rank_quantile(rows, ["level", *keys], "_s", upper_rank(F.col("n"), 1 - alpha), "correction")
    return table.where((F.col("n") >= least) | (F.col("level") == len(levels)))


def calibrate(predictions: DataFrame, table: DataFrame, levels=LEVELS) -> DataFrame:
    """Widens the intervals by the first level's correction that ``table`` has; null keys match null keys.

    Adds ``q10_raw``, ``q90_raw``, ``conformal_correction``, ``conformal_calibration_n`` (null if pooled) and
    ``conformal_level``. The table has one row per cell and is as small as the cells are few; Spark
    broadcasts it if it is.
    """
    out, found = predictions, []
    for i, level in enumerate(levels):
        cell = table.where(F.col("level") == i).select(*(F.col(k).alias(f"_{i}_{k}") for k in level), F.struct("correction", "n", F.lit("+".join(level)).alias("name")).alias(f"_{i}"))
        on = [F.col(k).eqNullSafe(F.col(f"_{i}_{k}")) for k in level]
        condition = on[0]
        for c in on[1:]:
            condition = condition & c
        out = out.join(cell, condition, "left").drop(*(f"_{i}_{k}" for k in level))
        found.append(F.col(f"_{i}"))
    pooled = table.where(F.col("level") == len(levels)).select(F.struct("correction", F.lit(None).cast("long").alias("n"), F.lit("pooled").alias("name")).alias("_p"))
    out = out.crossJoin(F.broadcast(pooled.limit(1))).withColumn("_c", F.coalesce(*found, F.col("_p")))
    out = out.withColumns({"q10_raw": F.col("q10"), "q90_raw": F.col("q90"), "conformal_correction": F.col("_c.correction"), "conformal_calibration_n": F.col("_c.n"), "conformal_level": F.col("_c.name")})
    out = out.withColumns({"q10": F.greatest(F.col("q10") - F.col("conformal_correction"), F.lit(0.0)), "q90": F.col("q90") + F.col("conformal_correction")})
    return out.drop("_c", "_p", *(f"_{i}" for i in range(len(levels))))
