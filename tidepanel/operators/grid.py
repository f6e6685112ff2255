"""Irregular readings to regular panels. Time is a whole number of steps (``step``), so grids are integer ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import last_value, next_value

ID, STEP, Y = "household_id", "step", "y"


def by_time(id_col: str = ID, step: str = STEP):
    return Window.partitionBy(id_col).orderBy(step)


def back_in_time(id_col: str = ID, step: str = STEP):
    return Window.partitionBy(id_col).orderBy(F.col(step).desc())


def dedup_last(readings: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the last by ``order``; rows with a null key go. Combined before the shuffle."""
    rest = [c for c in readings.columns if c not in keys]
    kept = readings.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return kept.select(*keys, "_r.*")


def regular_grid(readings: DataFrame, id_col: str = ID, step: str = STEP, common: bool = False) -> DataFrame:
    """Each series on all steps from its first to its last (``common``: from the first to the last of all).

    Spans are few small rows that grow to all rows of the grid, so they are dealt to all cores: joined by their size, they would all grow in one. Dealt by
    the series alone they would lie as the aggregate left them, and Spark drops such a repartition.
    """
    spans = readings.groupBy(id_col).agg(F.min(step).alias("_a"), F.max(step).alias("_b"))
    if common:
        ends = readings.agg(F.min(step).alias("_a"), F.max(step).alias("_b"))
        spans = readings.select(id_col).distinct().crossJoin(F.broadcast(ends))
    tasks = readings.sparkSession.sparkContext.defaultParallelism
    grid = spans.where("_a IS NOT NULL").repartition(tasks, id_col, "_a").select(id_col, F.explode(F.sequence("_a", "_b")).alias(step))
    return grid.join(readings, [id_col, step], "left")


def gap_runs(panel: DataFrame, value: str = Y) -> DataFrame:
    """Adds ``missing``, ``run_id`` (islands of equal ``missing`` from 1) and ``run_size``."""
    w = by_time()
    flagged = panel.withColumn("missing", F.col(value).isNull())
    change = F.coalesce((F.col("missing") != F.lag("missing").over(w)).cast("long"), F.lit(1))
    runs = flagged.withColumn("run_id", change).withColumn("run_id", F.sum("run_id").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.withColumn("run_size", F.count("*").over(Window.partitionBy(ID, "run_id")))


def _between(value: str, w, back, step: str = STEP) -> Column:
    """Linear in time between the neighbours that have a value."""
    before = last_value(F.when(F.col(value).isNotNull(), F.struct(F.col(step).alias("t"), F.col(value).alias("v"))), w)
    after = next_value(F.when(F.col(value).isNotNull(), F.struct(F.col(step).alias("t"), F.col(value).alias("v"))), back)
    return F.when(F.col(value).isNotNull(), F.col(value)).otherwise(before["v"] + (after["v"] - before["v"]) * (F.col(step) - before["t"]) / (after["t"] - before["t"]))


def fill_short_gaps(panel: DataFrame, limit: int = 1, value: str = Y) -> DataFrame:
    """Fills gaps of at most ``limit`` steps between two values; adds ``originally_missing``."""
    runs = gap_runs(panel, value)
    filled = F.when(F.col(value).isNull() & (F.col("run_size") <= limit), _between(value, by_time(), back_in_time())).otherwise(F.col(value))
    return runs.withColumn("_f", filled).withColumn("originally_missing", F.col(value).isNull().cast("int")).drop(value, "missing", "run_id", "run_size").withColumnRenamed("_f", value)


def interpolate_onto(target: DataFrame, source: DataFrame, value: str, limit: int = 3) -> DataFrame:
    """``target``'s rows with ``value`` of ``source`` interpolated in time over the union of both time axes.

    Only up to ``limit`` union rows after a value are filled, and nothing before the first or after the last.
    """
    axis = target.select(ID, STEP).union(source.select(ID, STEP)).distinct().join(source.select(ID, STEP, value), [ID, STEP], "left")
    w = by_time()
    seen = F.sum(F.col(value).isNotNull().cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = axis.withColumn("_k", seen)
    nth = F.row_number().over(Window.partitionBy(ID, "_k").orderBy(STEP)) - 1
    filled = numbered.withColumn("_n", nth).withColumn("_v", _between(value, w, back_in_time()))
    values = filled.select(ID, STEP, F.when((F.col("_n") <= limit) & (F.col("_k") > 0), F.col("_v")).alias(value))
    return target.join(values, [ID, STEP], "left")


def lagged(panel: DataFrame, value: str, steps: int, name: str) -> DataFrame:
    return panel.withColumn(name, F.lag(value, steps).over(by_time()))


def causal_fill(panel: DataFrame, value: str, name: str, every: int) -> DataFrame:
    """Values at whole multiples of ``every`` steps carried forward without bound: what was known by then."""
    exact = F.when(F.col(STEP) % every == 0, F.col(value))
    return panel.withColumn(name, last_value(exact, by_time()))


def visit_segments(panel: DataFrame, visits: DataFrame, visit: str = "visit_step") -> DataFrame:
    """Adds ``segment_id``, the number of the household's visits up to the row: a running count over rows and visits in one order."""
    marks = visits.where(F.col(ID).isNotNull() & F.col(visit).isNotNull()).select(ID, F.col(visit).alias("_at"), F.lit(1).alias("_visit"))
    rows = panel.withColumns({"_at": F.col(STEP), "_visit": F.lit(0)}).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(ID).orderBy("_at", F.col("_visit").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("segment_id", F.sum("_visit").over(w)).where("_visit = 0").drop("_at", "_visit")


def continuous_sequences(panel: DataFrame, least: int, value: str = Y) -> DataFrame:
    """Rows of gap-free runs of at least ``least`` observed rows, with ``sequence_id`` and ``time_idx``."""
    invalid = (F.col(value).isNull() | (F.col("originally_missing") == 1)).cast("long")
    gap = F.sum(invalid).over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    named = panel.withColumn("_gap", gap).where(F.col(value).isNotNull() & (F.col("originally_missing") == 0))
    named = named.withColumn("sequence_id", F.concat_ws("_", F.col(ID).cast("string"), F.col("segment_id").cast("string"), F.col("_gap").cast("string"))).drop("_gap")
    sized = named.withColumn("_n", F.count("*").over(Window.partitionBy("sequence_id")))
    return sized.where(F.col("_n") >= least).drop("_n").withColumn("time_idx", F.col(STEP))


def fill_sequence_weather(sequences: DataFrame, value: str) -> DataFrame:
    """Forward within a sequence, then backward over a household's later sequences, then the median of all."""
    forward = F.last(value, ignorenulls=True).over(Window.partitionBy("sequence_id").orderBy(STEP).rowsBetween(Window.unboundedPreceding, 0))
    filled = sequences.withColumn("_f", forward)
    back = next_value("_f", back_in_time())
    middle = sequences.agg(F.median(value).alias("_m"))
    return filled.withColumn("_b", back).crossJoin(F.broadcast(middle)).withColumn(value, F.coalesce("_b", "_m")).drop("_f", "_b", "_m")


def spaced(panel: DataFrame, n: int) -> DataFrame:
    """Adds ``contiguous``: the row ``n`` rows before is ``n`` steps before."""
    return panel.withColumn("contiguous", F.coalesce(F.col(STEP) - F.lag(STEP, n).over(by_time()) == n, F.lit(False)))
