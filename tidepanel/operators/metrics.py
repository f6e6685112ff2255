"""Point, interval and peak metrics, each set one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import crps, finite, interval_score, linear_quantile, pinball, winkler
from tidepanel.operators.grid import ID, STEP

CELLS = ("model", "split", "hp_type", "horizon")
TINY = 1e-12


def forecast_metrics(predictions: DataFrame, groups=CELLS, alpha: float = 0.2) -> DataFrame:
    """One row per group. ``mase`` is there if the rows have ``mase_scale``; only finite positive scales count."""
    y, p, lo, mid, hi = (F.col(c) for c in ("y_true", "y_pred", "q10", "q50", "q90"))
    size = F.greatest(F.avg(F.abs(y)), F.lit(TINY))
    l10, l50, l90 = (F.avg(pinball(y, q, t)) for q, t in ((lo, 0.1), (mid, 0.5), (hi, 0.9)))
    sse, sst = F.sum((y - p) ** 2), F.var_pop(y) * F.count(y)
    out = {
        "n": F.count("*"), "mae": F.avg(F.abs(y - p)), "rmse": F.sqrt(F.avg((y - p) ** 2)), "nmae_mean": F.avg(F.abs(y - p)) / size,
        "r2": F.when(F.count("*") > 1, F.when(sst > TINY, 1 - sse / sst).when(sse <= TINY, 1.0).otherwise(0.0)),
        "pinball_q10": l10, "pinball_q50": l50, "pinball_q90": l90, "picp": F.avg(y.between(lo, hi).cast("double")),
        "mean_interval_width": F.avg(hi - lo), "normalized_interval_width": F.avg(hi - lo) / size,
        "winkler": F.avg(winkler(y, lo, hi, alpha)), "wis": F.avg(interval_score(y, mid, lo, hi, alpha)), "approx_crps": crps(l10, l50, l90),
    }
    if "mase_scale" in predictions.columns:
        s = finite(F.col("mase_scale"))
        out["mase"] = F.avg(F.when(s > 0, F.abs(y - p) / s))
    return predictions.groupBy(*groups).agg(*(c.alias(n) for n, c in out.items()))


def event_rates(actual: Column, predicted: Column) -> dict[str, Column]:
    """Precision, recall, F1 and false-alarm rate of a group's flags, denominators one at least."""
    one = F.lit(1)
    tp, fp, fn, tn = (F.count_if(a & b) for a, b in ((actual, predicted), (~actual, predicted), (actual, ~predicted), (~actual, ~predicted)))
    precision, recall = tp / F.greatest(tp + fp, one), tp / F.greatest(tp + fn, one)
    return {"precision": precision, "recall": recall, "f1": 2 * precision * recall / F.greatest(precision + recall, F.lit(TINY)), "false_alarm_rate": fp / F.greatest(fp + tn, one)}


def thresholds(reference: DataFrame, group: str, quantile: float) -> DataFrame:
    """(``group``, ``threshold``) over the reference rows, one for each household and target."""
    rows = reference.dropDuplicates([ID, "target"])
    if group == ID:  # one household's rows are few
        return rows.groupBy(group).agg(F.percentile("y_true", F.lit(quantile)).alias(f"_by_{group}"))
    return linear_quantile(rows, [group], "y_true", quantile, f"_by_{group}")


def with_threshold(predictions: DataFrame, reference: DataFrame, quantile: float = 0.95) -> DataFrame:
    """Adds ``threshold``: the household's, else its type's, else the trajectory's own quantile."""
    own = F.percentile("y_true", F.lit(quantile)).over(Window.partitionBy("model", "split", "hp_type", ID, "origin"))
    joined = predictions.join(thresholds(reference, ID, quantile), ID, "left").join(F.broadcast(thresholds(reference, "hp_type", quantile)), "hp_type", "left")
    return joined.withColumn("_own", own).withColumn("threshold", F.coalesce(f"_by_{ID}", "_by_hp_type", "_own")).drop(f"_by_{ID}", "_by_hp_type", "_own")


def peak_metrics(predictions: DataFrame, reference: DataFrame, quantile: float = 0.95, top: float = 0.05, step_hours: float = 0.25) -> DataFrame:
    """Per (model, split, type): means over origins of peak errors, ramps, captured top steps and event rates.

    Of equal values the earlier horizon ranks as the higher.
    """
    one = ["model", "split", "hp_type", ID, "origin"]
    w = Window.partitionBy(*one)
    rows = with_threshold(predictions, reference, quantile)
    k = F.greatest(F.ceil(F.count("*").over(w) * F.lit(top) - 1e-9), F.lit(1))
    rows = rows.withColumns({
        "_k": k, "_ry": F.row_number().over(w.orderBy(F.col("y_true").desc(), "horizon")), "_rp": F.row_number().over(w.orderBy(F.col("y_pred").desc(), "horizon")),
        "_i": F.row_number().over(w.orderBy("horizon")),
        "_ramp": F.abs((F.col("y_pred") - F.lag("y_pred").over(w.orderBy("horizon"))) - (F.col("y_true") - F.lag("y_true").over(w.orderBy("horizon")))),
    })
    place = lambda r: F.max(F.when(F.col(r) == 1, F.col("_i")))
    rates = event_rates(F.col("y_true") > F.col("threshold"), F.col("y_pred") > F.col("threshold"))
    detail = rows.groupBy(*one).agg(
        F.abs(F.max("y_pred") - F.max("y_true")).alias("peak_magnitude_error"), (F.abs(place("_rp") - place("_ry")) * step_hours).alias("peak_time_error_hours"), F.avg("_ramp").alias("ramp_mae"),
        (F.count_if((F.col("_ry") <= F.col("_k")) & (F.col("_rp") <= F.col("_k"))) / F.max("_k")).alias("top_peak_capture"), *(c.alias(n) for n, c in rates.items()),
    )
    names = [c for c in detail.columns if c not in one]
    return detail.groupBy("model", "split", "hp_type").agg(*(F.avg(c).alias(c) for c in names))


def seasonal_scales(panel: DataFrame, households: DataFrame, cutoff: Column | float, season: int = 96, least: int = 96) -> DataFrame:
    """(household, ``hp_type``, ``mase_scale``, ``mase_scale_n``, ``mase_scale_source``) from history up to ``cutoff``.

    The mean absolute difference to the value one season before within a segment, where the steps are
    contiguous. Households with fewer than ``least`` differences get their type's median over training
    households (``households.role`` is train), else that over all.
    """
    w = Window.partitionBy(ID, "segment_id").orderBy(STEP)
    history = panel.where(F.col(STEP) <= cutoff)
    d = F.when(F.col(STEP) - F.lag(STEP, season).over(w) == season, F.abs(F.col("y") - F.lag("y", season).over(w)))
    own = history.withColumn("_d", d).groupBy(ID).agg(F.avg("_d").alias("_s"), F.count("_d").alias("mase_scale_n"))
    rows = households.join(own, ID, "left").withColumn("mase_scale_n", F.coalesce("mase_scale_n", F.lit(0)))
    rows = rows.withColumn("_s", F.when((F.col("mase_scale_n") >= least) & (F.col("_s") > 0), F.col("_s")))
    train = rows.where("role = 'train' AND _s IS NOT NULL")
    by_type = F.broadcast(train.groupBy("hp_type").agg(F.median("_s").alias("_t")))
    overall = F.broadcast(train.agg(F.median("_s").alias("_g")))
    rows = rows.join(by_type, "hp_type", "left").crossJoin(overall)
    source = F.when(F.col("_s").isNotNull(), "own_pre_train_history").when(F.col("_t").isNotNull(), "training_type_fallback").otherwise("training_global_fallback")
    return rows.select(ID, "hp_type", F.coalesce("_s", "_t", "_g").alias("mase_scale"), "mase_scale_n", source.alias("mase_scale_source"))


def attach_scale(predictions: DataFrame, scales: DataFrame) -> DataFrame:
    return predictions.join(scales.select(ID, "mase_scale", "mase_scale_source", "mase_scale_n").dropDuplicates([ID]), ID, "left")
