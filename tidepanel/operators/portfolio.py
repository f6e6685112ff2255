"""Virtual portfolios: sums over members, calibrated bounds, and energy-conserving load shifting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.columns import linear_quantile, lower_rank, rank_values, upper_rank
from tidepanel.operators.grid import ID

WHO = ["portfolio_id", "cohort", "portfolio_type", "portfolio_size"]
WHEN = ["split", "origin", "target", "horizon"]
CELL = ["portfolio_type", "portfolio_size", "model", "horizon"]


def aggregate(predictions: DataFrame, members: DataFrame, coverage: float = 0.9) -> DataFrame:
    """Sums of ``y_true``, ``q10``, ``q50``, ``q90`` over a portfolio's households that have the row, where enough have."""
    joined = members.select(*WHO, ID).join(predictions, ID)
    sums = joined.groupBy(*WHO, "model", *WHEN).agg(F.count_distinct(ID).alias("households"), *(F.sum(c).alias(c) for c in ("y_true", "q10", "q50", "q90")))
    return sums.withColumn("coverage", F.col("households") / F.col("portfolio_size")).where(F.col("coverage") >= coverage)


def residual_bounds(aggregates: DataFrame, alpha: float = 0.2, least: int = 100) -> DataFrame:
    """Per (type, size, model, horizon): finite-sample lower and upper residual quantiles of the seen cohort's calibration rows.

    ``calibration_n`` counts distinct (origin, target), which decides validity; ranks count rows.
    """
    rows = aggregates.where("cohort = 'seen' AND split = 'calibration'").withColumn("_r", F.col("y_true") - F.col("q50"))
    table = rows.groupBy(*CELL).agg(F.count("*").alias("calibration_rows"), F.count_distinct("origin", "target").alias("calibration_n"))
    bounds = rank_values(rows, CELL, "_r", {"lower_residual": lower_rank(F.col("n"), alpha / 2), "upper_residual": upper_rank(F.col("n"), 1 - alpha / 2)})
    table = table.join(bounds.drop("n"), CELL, "left")
    return table.withColumn("calibration_valid", F.col("calibration_n") >= least)


def with_bounds(aggregates: DataFrame, table: DataFrame) -> DataFrame:
    """Replaces ``q10`` and ``q90`` by the median plus residual bounds (not below zero); cells without any keep the sums."""
    joined = aggregates.join(table.drop("calibration_rows"), CELL, "left")
    low = F.when(F.col("lower_residual").isNotNull(), F.greatest(F.col("q50") + F.col("lower_residual"), F.lit(0.0))).otherwise(F.col("q10"))
    high = F.when(F.col("upper_residual").isNotNull(), F.col("q50") + F.col("upper_residual")).otherwise(F.col("q90"))
    flags = {"q10": low, "q90": high, "calibration_n": F.coalesce("calibration_n", F.lit(0)), "calibration_valid": F.coalesce("calibration_valid", F.lit(False))}
    return joined.withColumns(flags).drop("lower_residual", "upper_residual")


def truths(aggregates: DataFrame) -> DataFrame:
    """One row per portfolio, origin and horizon: the realised load, whatever the models."""
    return aggregates.groupBy(*WHO, *WHEN).agg(F.min("y_true").alias("y_true"))


def peak_thresholds(aggregates: DataFrame, quantile: float = 0.95) -> DataFrame:
    """(type, size, ``threshold``) from the seen cohort's calibration truths."""
    rows = truths(aggregates).where("cohort = 'seen' AND split = 'calibration'")
    return linear_quantile(rows, ["portfolio_type", "portfolio_size"], "y_true", quantile, "threshold")


def shift(actual: np.ndarray, signal: np.ndarray, threshold: float, fraction: float, reach: int, room: float = 1.0) -> tuple[np.ndarray, float, int, int]:
    """Scheduled load, energy shifted, shifts planned and shifts rejected.

    The plan sees the signal only: steps above the threshold, highest first (of equals the later), move a
    fraction of their planned load to the lowest later step in reach, as far as its room under the threshold
    goes and unless the planned peak would rise. Steps that have taken or given load don't give. The plan is
    then carried out on the actual load, as far as there is any.
    """
    plan = np.maximum(signal.astype(float), 0.0)
    moves: list[tuple[int, int, float]] = []
    busy: set[int] = set()
    rejected = 0
    for a in sorted(np.flatnonzero(signal > threshold).tolist(), key=lambda i: (-signal[i], -i)):
        later = range(a + 1, min(len(signal), a + reach + 1))
        if a in busy or not later:
            continue
        lower = [i for i in later if signal[i] < signal[a]]
        b = min(lower, key=lambda i: signal[i], default=None)
        amount = 0.0 if b is None else min(max(0.0, fraction * plan[a]), max(0.0, threshold * room - plan[b]))
        # only step b rises, so the peak rises exactly if b ends above all others' maximum
        if amount <= 0 or plan[b] + amount > plan.max() + 1e-12:
            rejected += 1
            continue
        plan[a] -= amount
        plan[b] += amount
        moves.append((a, b, amount))
        busy |= {a, b}
    done, moved = actual.astype(float).copy(), 0.0
    for a, b, amount in moves:
        given = min(amount, max(0.0, done[a]))
        done[a] -= given
        done[b] += given
        moved += given
    return done, moved, len(moves), rejected


DETAIL = (
    "portfolio_id string, cohort string, portfolio_type string, portfolio_size int, model string, split string, origin long, strategy string, flexible_fraction double, shift_hours int, threshold double, "
    "peak_before double, peak_after double, peak_reduction double, peak_reduction_fraction double, load_factor_before double, load_factor_after double, shifted_energy double, interventions int, rejected_interventions int, "
    "energy_balance_error double, actual_peak_event boolean, predicted_peak_event boolean, missed_event boolean, false_intervention boolean"
)


def manage_peaks(calibrated: DataFrame, table: DataFrame, steps: int, fractions: list[float], hours: list[int], steps_per_hour: float = 4, room: float = 1.0) -> DataFrame:
    """One row per origin, strategy, fraction and reach (``DETAIL``): no forecast, median, upper bound, perfect foresight.

    Origins with fewer than ``steps`` horizons or without a threshold are left out. Perfect foresight runs
    once per origin on the truths. A trajectory is one row with a short sorted array, so trajectories
    are scheduled in Arrow batches without a Python group each.
    """
    test = calibrated.where("split IN ('seen_test', 'unseen_test') AND calibration_valid").join(F.broadcast(table), ["portfolio_type", "portfolio_size"])
    series = F.array_sort(F.collect_list(F.struct("horizon", "y_true", "q50", "q90")))
    one = [*WHO, "split", "origin"]
    modelled = test.groupBy(*one, "model").agg(F.first("threshold").alias("threshold"), series.alias("s"))
    # a trajectory's truth is the same for all models; the least model's rows stand for it
    truth = test.join(test.groupBy(*one).agg(F.min("model").alias("model")), [*one, "model"]).groupBy(*one).agg(F.first("threshold").alias("threshold"), series.alias("s"))
    rows = modelled.unionByName(truth.withColumn("model", F.lit("perfect_foresight"))).where((F.size("s") >= steps) & F.col("threshold").isNotNull())
    names = [x.split()[0] for x in DETAIL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                y = np.array([x["y_true"] for x in r["s"]])
                top, limit = float(y.max()), r["threshold"]
                base = {k: r[k] for k in [*one, "model"]} | {"threshold": limit, "peak_before": top, "load_factor_before": float(y.mean() / max(top, 1e-12)), "actual_peak_event": top > limit}
                if r["model"] == "perfect_foresight":
                    signals = [("perfect_foresight", y)]
                else:
                    signals = [("median", np.array([x["q50"] for x in r["s"]])), ("conformal_upper_bound", np.array([x["q90"] for x in r["s"]]))]
                    idle = {"strategy": "reference_no_forecast", "flexible_fraction": 0.0, "shift_hours": 0, "peak_after": top, "peak_reduction": 0.0, "peak_reduction_fraction": 0.0, "load_factor_after": base["load_factor_before"], "shifted_energy": 0.0}
                    out.append(base | idle | {"interventions": 0, "rejected_interventions": 0, "energy_balance_error": 0.0, "predicted_peak_event": False, "missed_event": top > limit, "false_intervention": False})
                for name, signal in signals:
                    sees = bool(signal.max() > limit)
                    for f in fractions:
                        for h in hours:
                            done, moved, count, rejected = shift(y, signal, limit, f, int(h * steps_per_hour), room)
                            after = float(done.max())
                            out.append(base | {
                                "strategy": name, "flexible_fraction": f, "shift_hours": h, "peak_after": after, "peak_reduction": top - after, "peak_reduction_fraction": (top - after) / max(top, 1e-12),
                                "load_factor_after": float(done.mean() / max(after, 1e-12)), "shifted_energy": moved, "interventions": count, "rejected_interventions": rejected,
                                "energy_balance_error": float(abs(done.sum() - y.sum())), "predicted_peak_event": sees, "missed_event": top > limit and not sees, "false_intervention": sees and not top > limit,
                            })
            if out:
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in out], schema=schema)

    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in DETAIL.split(", ")])
    return rows.mapInArrow(run, DETAIL)


def summarise(detail: DataFrame) -> DataFrame:
    """Per portfolio, model, split, strategy, fraction and reach: counts, means, extremes and the median reduction."""
    keys = [*WHO, "model", "split", "strategy", "flexible_fraction", "shift_hours"]
    out = {"n_origins": F.count("*"), "mean_peak_reduction": F.avg("peak_reduction"), "median_peak_reduction": F.median("peak_reduction"), "min_peak_reduction": F.min("peak_reduction"), "max_peak_reduction": F.max("peak_reduction")}
    out |= {"mean_shifted_energy": F.avg("shifted_energy"), "interventions": F.sum("interventions"), "rejected_interventions": F.sum("rejected_interventions"), "max_energy_balance_error": F.max("energy_balance_error")}
    out |= {n: F.count_if(F.col(c)) for n, c in (("actual_events", "actual_peak_event"), ("predicted_events", "predicted_peak_event"), ("missed_events", "missed_event"), ("false_interventions", "false_intervention"))}
    return detail.groupBy(*keys).agg(*(c.alias(n) for n, c in out.items()))


def invariants(detail: DataFrame, energy: float = 1e-8, peak: float = 1e-9) -> DataFrame:
    """One row of violation counts; all zero if shifting conserves energy and foresight never raises a peak or misses."""
    sees = F.col("strategy") == "perfect_foresight"
    return detail.agg(
        F.count_if(F.col("energy_balance_error") > energy).alias("energy_violations"), F.count_if(sees & (F.col("peak_after") > F.col("peak_before") + peak)).alias("foresight_peak_violations"),
        F.count_if(sees & (F.col("missed_event") | F.col("false_intervention"))).alias("foresight_event_violations"),
    )
