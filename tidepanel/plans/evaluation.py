"""Queries over metrics, calibration, portfolios, inference and reports."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions.artifacts import artifact
from tidepanel.functions.columns import crps, interval_score, lower_rank, pinball, rank_quantile, upper_rank, winkler
from tidepanel.operators import conformal, inference, metrics, models, portfolio, reports
from tidepanel.plans import base as b
from tidepanel.plans.panels import _MEMBERS, members
from tidepanel.plans.registry import query

# ---- scalar metrics ----



def _pin(y: str, q: str, t: float) -> str:
    return f"greatest({t} * ({y} - {q}), ({t} - 1) * ({y} - {q}))"


def _wink(y: str = "y_true", lo: str = "q10", hi: str = "q90") -> str:
    return f"(({hi} - {lo}) + 10.0 * greatest({lo} - {y}, 0) + 10.0 * greatest({y} - {hi}, 0))"


_L10, _L50, _L90 = (f"avg({_pin('y_true', q, t)})" for q, t in (("q10", "0.1::DOUBLE"), ("q50", "0.5::DOUBLE"), ("q90", "0.9::DOUBLE")))
_WIS = f"((0.5::DOUBLE * abs(y_true - q50) + 0.1::DOUBLE * {_wink()}) / 1.5::DOUBLE)"
_METRICS = f"""count(*) AS n, avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse, avg(abs(y_true - y_pred)) / greatest(avg(abs(y_true)), 1e-12) AS nmae_mean,
  CASE WHEN count(*) > 1 THEN CASE WHEN var_pop(y_true) * count(y_true) > 1e-12 THEN 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(y_true)) WHEN sum((y_true - y_pred) * (y_true - y_pred)) <= 1e-12 THEN 1 ELSE 0 END END AS r2,
  {_L10} AS pinball_q10, {_L50} AS pinball_q50, {_L90} AS pinball_q90, avg(CAST(y_true BETWEEN q10 AND q90 AS DOUBLE)) AS picp, avg(q90 - q10) AS mean_interval_width, avg(q90 - q10) / greatest(avg(abs(y_true)), 1e-12) AS normalized_interval_width,
  avg({_wink()}) AS winkler, avg({_WIS}) AS wis, 0.4::DOUBLE * {_L10} + 0.8::DOUBLE * {_L50} + 0.4::DOUBLE * {_L90} AS approx_crps"""
_CELLS = "model:s split:s hp_type:s horizon:i n:i mae:d rmse:d nmae_mean:d r2:d pinball_q10:d pinball_q50:d pinball_q90:d picp:d mean_interval_width:d normalized_interval_width:d winkler:d wis:d approx_crps:d"
_MASE = "avg(CASE WHEN mase_scale > 0 THEN abs(y_true - y_pred) / mase_scale END) AS mase"
_CELL = "model, split, hp_type, horizon"


@query(f"{_CELLS} mase:d", b.sql(f"SELECT {_CELL}, {_METRICS}, {_MASE} FROM scored GROUP BY ALL", "scored"))
def minimum_slice(spark, d):
    """Calibrated seasonal baselines scored per model, split, type and horizon: the flagship."""
    return metrics.forecast_metrics(b.scored(spark, d))


@query(f"{_CELLS} mase:d", b.sql(f"SELECT {_CELL}, {_METRICS}, {_MASE} FROM scored WHERE split LIKE '%test' GROUP BY ALL", "scored"))
def forecast_metrics(spark, d):
    return metrics.forecast_metrics(b.scored(spark, d).where("split LIKE '%test'"))


@query(_CELLS, b.sql(f"SELECT {_CELL}, {_METRICS} FROM (SELECT * EXCLUDE (q10, q90), q10_raw AS q10, q90_raw AS q90 FROM cal) GROUP BY ALL", "cal"))
def forecast_metrics_raw(spark, d):
    return metrics.forecast_metrics(b.calibrated(spark, d).withColumns({"q10": F.col("q10_raw"), "q90": F.col("q90_raw")}))


_LI = "l_extendedprice / 1000 AS y_true, l_quantity AS q10, l_quantity * 1.2::DOUBLE AS q50, l_quantity * 1.5::DOUBLE AS q90"


def _line(spark, d):
    return b.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_extendedprice") / 1000).alias("y_true"), F.col("l_quantity").alias("q10"), (F.col("l_quantity") * 1.2).alias("q50"), (F.col("l_quantity") * 1.5).alias("q90"))


@query("flag:s q10:d q50:d q90:d crps:d", f"SELECT flag, {_L10} AS q10, {_L50} AS q50, {_L90} AS q90, 0.4::DOUBLE * {_L10} + 0.8::DOUBLE * {_L50} + 0.4::DOUBLE * {_L90} AS crps FROM (SELECT l_returnflag AS flag, {_LI} FROM lineitem) GROUP BY 1", name="pinball")
def pinball_losses(spark, d):
    y = F.col("y_true")
    a = [F.avg(pinball(y, F.col(q), t)) for q, t in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9))]
    return _line(spark, d).groupBy("flag").agg(a[0].alias("q10"), a[1].alias("q50"), a[2].alias("q90"), crps(*a).alias("crps"))


@query("flag:s winkler:d", f"SELECT flag, avg({_wink()}) AS winkler FROM (SELECT l_returnflag AS flag, {_LI} FROM lineitem) GROUP BY 1", name="winkler")
def winkler_score(spark, d):
    return _line(spark, d).groupBy("flag").agg(F.avg(winkler(F.col("y_true"), F.col("q10"), F.col("q90"))).alias("winkler"))


@query("flag:s wis:d", f"SELECT flag, avg({_WIS}) AS wis FROM (SELECT l_returnflag AS flag, {_LI} FROM lineitem) GROUP BY 1", name="wis")
def weighted_interval_score(spark, d):
    return _line(spark, d).groupBy("flag").agg(F.avg(interval_score(F.col("y_true"), F.col("q50"), F.col("q10"), F.col("q90"))).alias("wis"))


_RATES = "tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall, 2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / greatest(tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1), 1e-12) AS f1, fp / greatest(fp + tn, 1) AS false_alarm_rate"


@query("precision:d recall:d f1:d false_alarm_rate:d", f"SELECT {_RATES} FROM (SELECT CAST(count(*) FILTER (a AND p) AS DOUBLE) AS tp, CAST(count(*) FILTER (NOT a AND p) AS DOUBLE) AS fp, CAST(count(*) FILTER (a AND NOT p) AS DOUBLE) AS fn, CAST(count(*) FILTER (NOT a AND NOT p) AS DOUBLE) AS tn FROM (SELECT quality = 1 AS a, toxic = 0 AS p FROM labels))")
def event_confusion(spark, d):
    rates = metrics.event_rates(F.col("quality") == 1, F.col("toxic") == 0)
    return b.table(spark, d, "labels").agg(*(c.alias(n) for n, c in rates.items()))


# ---- quantiles ----


@query("user_id:i q:d", "SELECT user_id, quantile_cont(CAST(floor(value * 100 + 0.5) AS DOUBLE), 0.95) AS q FROM events GROUP BY 1")
def linear_quantile(spark, d):
    return b.events(spark, d).groupBy("user_id").agg(F.percentile(F.col("cents").cast("double"), F.lit(0.95)).alias("q"))


@query("user_id:i n:i upper:i", b.sql(f"SELECT user_id, n, cents AS upper FROM (SELECT user_id, cents, row_number() OVER (PARTITION BY user_id ORDER BY cents) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM ev) WHERE r = {b.upper_rank_sql('n', 0.8)}", "ev"))
def finite_sample_quantile(spark, d):
    return rank_quantile(b.events(spark, d), ["user_id"], "cents", upper_rank(F.col("n"), 0.8), "upper")


@query("user_id:i n:i lower:i", b.sql("SELECT user_id, n, cents AS lower FROM (SELECT user_id, cents, row_number() OVER (PARTITION BY user_id ORDER BY cents) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM ev) WHERE r = greatest(CAST(floor((n + 1) * 0.1e0 + 1e-9) AS BIGINT), 1)", "ev"))
def finite_sample_lower(spark, d):
    return rank_quantile(b.events(spark, d), ["user_id"], "cents", lower_rank(F.col("n"), 0.1), "lower")


# ---- calibration ----


@query("level:i model:s hp_type:s horizon:i temperature_regime:s correction:d n:i", b.sql("SELECT * FROM corr", "corr"))
def conformal_fit(spark, d):
    return b.corrections(spark, d)


@query("household_id:i origin:i horizon:i model:s q10:d q90:d q10_raw:d q90_raw:d conformal_correction:d conformal_calibration_n:i conformal_level:s", b.sql("SELECT * FROM cal", "cal"))
def conformal_lookup(spark, d):
    return b.calibrated(spark, d)


@query("level:i horizon:i correction:d n:i", b.sql(f"SELECT * FROM (SELECT 0 AS level, horizon, s AS correction, row_number() OVER (PARTITION BY horizon ORDER BY s) AS r, count(*) OVER (PARTITION BY horizon) AS n FROM scores UNION ALL SELECT 1, NULL, s, row_number() OVER (ORDER BY s), count(*) OVER () FROM scores) WHERE r = {b.upper_rank_sql('n', 0.8)}", "scores"))
def horizon_conformal(spark, d):
    return conformal.corrections(b.regimes(spark, d).where("split = 'calibration'"), 0.2, 1, levels=(("horizon",),))


@query("hp_type:s cold_below:d", b.sql("SELECT * FROM cold", "cold"))
def temperature_threshold(spark, d):
    return conformal.temperature_thresholds(b.predictions(spark, d).where("split = 'calibration'"), 0.05)


@query("split:s temperature_regime:s rows:i", b.sql("SELECT split, temperature_regime, count(*) AS rows FROM reg GROUP BY 1, 2", "reg"))
def temperature_regimes(spark, d):
    return b.regimes(spark, d).groupBy("split", "temperature_regime").agg(F.count("*").alias("rows"))


@query(_CELLS, b.sql(f"SELECT {_CELL}, {_METRICS} FROM cal JOIN cold USING (hp_type) WHERE split LIKE '%test' AND evaluation_temperature_c <= cold_below GROUP BY ALL", "cal", "cold"))
def cold_metrics(spark, d):
    cold = conformal.temperature_thresholds(b.predictions(spark, d).where("split = 'calibration'"), 0.05)
    rows = b.calibrated(spark, d).where("split LIKE '%test'").join(F.broadcast(cold), "hp_type").where("evaluation_temperature_c <= cold_below")
    return metrics.forecast_metrics(rows)


@query("household_id:i model:s mase_scale:d rows:i", b.sql("SELECT household_id, model, mase_scale, count(*) AS rows FROM scored GROUP BY 1, 2, 3", "scored"))
def mase_attach(spark, d):
    return b.scored(spark, d).groupBy("household_id", "model", "mase_scale").agg(F.count("*").alias("rows"))


_THRESHOLDS = dict(
    ref="SELECT DISTINCT household_id, hp_type, target, y_true FROM sup WHERE split = 'train'",
    th="SELECT household_id, quantile_cont(y_true, 0.95) AS t FROM ref GROUP BY 1",
    tt="SELECT hp_type, quantile_cont(y_true, 0.95) AS t FROM ref GROUP BY 1",
    peaks="SELECT pred.*, coalesce(th.t, tt.t) AS threshold FROM pred LEFT JOIN th USING (household_id) LEFT JOIN tt USING (hp_type) WHERE split LIKE '%test'",
)


def _reference(spark, d):
    return b.supervised(spark, d).where("split = 'train'")


@query("household_id:i origin:i horizon:i model:s threshold:d", b.sql("SELECT * FROM peaks", "sup", "pred", **_THRESHOLDS))
def threshold_nested_fallback(spark, d):
    return metrics.with_threshold(b.predictions(spark, d).where("split LIKE '%test'"), _reference(spark, d))


_PEAK = f"""SELECT model, split, hp_type, avg(pm) AS peak_magnitude_error, avg(pt) AS peak_time_error_hours, avg(rm) AS ramp_mae, avg(tc) AS top_peak_capture, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, avg(false_alarm_rate) AS false_alarm_rate FROM (
  SELECT *, {_RATES} FROM (SELECT model, split, hp_type, household_id, origin, abs(max(y_pred) - max(y_true)) AS pm, abs(max(CASE WHEN rp = 1 THEN i END) - max(CASE WHEN ry = 1 THEN i END)) * 6 AS pt, avg(ramp) AS rm, CAST(count(*) FILTER (ry <= 1 AND rp <= 1) AS DOUBLE) AS tc,
    CAST(count(*) FILTER (y_true > threshold AND y_pred > threshold) AS DOUBLE) AS tp, CAST(count(*) FILTER (NOT y_true > threshold AND y_pred > threshold) AS DOUBLE) AS fp, CAST(count(*) FILTER (y_true > threshold AND NOT y_pred > threshold) AS DOUBLE) AS fn, CAST(count(*) FILTER (NOT y_true > threshold AND NOT y_pred > threshold) AS DOUBLE) AS tn
    FROM (SELECT *, row_number() OVER (PARTITION BY model, split, household_id, origin ORDER BY y_true DESC, horizon) AS ry, row_number() OVER (PARTITION BY model, split, household_id, origin ORDER BY y_pred DESC, horizon) AS rp, row_number() OVER w AS i, abs((y_pred - lag(y_pred) OVER w) - (y_true - lag(y_true) OVER w)) AS ramp FROM peaks WINDOW w AS (PARTITION BY model, split, household_id, origin ORDER BY horizon))
    GROUP BY ALL)) GROUP BY ALL"""


@query("model:s split:s hp_type:s peak_magnitude_error:d peak_time_error_hours:d ramp_mae:d top_peak_capture:d precision:d recall:d f1:d false_alarm_rate:d", b.sql(_PEAK, "sup", "pred", **_THRESHOLDS))
def peak_metrics(spark, d):
    return metrics.peak_metrics(b.predictions(spark, d).where("split LIKE '%test'"), _reference(spark, d), step_hours=6)


@query("household_id:i origin:i model:s peak_horizon:i peak:d", b.sql("SELECT household_id, origin, model, horizon AS peak_horizon, y_pred AS peak FROM (SELECT *, row_number() OVER (PARTITION BY household_id, origin, model ORDER BY y_pred DESC, horizon) AS r FROM pred WHERE split = 'seen_test') WHERE r = 1", "pred"))
def peak_rank(spark, d):
    w = Window.partitionBy("household_id", "origin", "model").orderBy(F.col("y_pred").desc(), "horizon")
    p = b.predictions(spark, d).where("split = 'seen_test'").withColumn("r", F.row_number().over(w)).where("r = 1")
    return p.withColumns({"peak_horizon": F.col("horizon"), "peak": F.col("y_pred")})


@query("household_id:i target:i y_true:d", b.sql("SELECT DISTINCT household_id, target, y_true FROM pred", "pred"))
def dedup_truth(spark, d):
    return b.predictions(spark, d).dropDuplicates(["household_id", "target"])


@query("household_id:i origin:i horizon:i model:s y_pred:d", b.sql("SELECT p.household_id, p.origin, p.horizon, p.model, p.y_pred FROM pred p WHERE EXISTS (SELECT 1 FROM pred q WHERE q.household_id = p.household_id AND q.origin = p.origin AND q.evaluation_temperature_c > 40 AND q.horizon = 1 AND q.split = 'seen_test')", "pred"))
def common_index_join(spark, d):
    p = b.predictions(spark, d)
    index = p.where("evaluation_temperature_c > 40 AND horizon = 1 AND split = 'seen_test'").select("household_id", "origin").distinct()
    return p.join(index, ["household_id", "origin"], "left_semi")


@query("household_id:i origin:i horizon:i model:s temperature_c:d", b.sql("SELECT p.household_id, p.origin, p.horizon, p.model, s.future__temperature AS temperature_c FROM pred p LEFT JOIN sup s ON s.household_id = p.household_id AND s.origin = p.origin AND s.target = p.target AND s.horizon = p.horizon AND s.split = p.split", "pred", "sup"))
def one_to_one_join(spark, d):
    keys = ["household_id", "origin", "target", "horizon", "split"]
    s = b.supervised(spark, d).select(*keys, F.col("future__temperature").alias("temperature_c"))
    return b.predictions(spark, d).drop("temperature_c").join(s, keys, "left")


_CHAIN = ("cold", "reg", "scores", "corr", "cal")
_ORACLE = {f"{n}_o": re.sub(r"\btemperature_c\b", "evaluation_temperature_c", re.sub(rf"(?<!')\b({'|'.join(_CHAIN)})\b", r"\1_o", b.CTES[n][1])) for n in _CHAIN}
_WINKLER = "SELECT model, split, avg(q90 - q10 + 10 * greatest(q10 - y_true, 0) + 10 * greatest(y_true - q90, 0)) AS w FROM {} GROUP BY 1, 2"


@query("model:s split:s winkler_difference:d", b.sql(f"SELECT model, split, a.w - c.w AS winkler_difference FROM ({_WINKLER.format('cal')}) a JOIN ({_WINKLER.format('cal_o')}) c USING (model, split)", "cal", **_ORACLE))
def scenario_diff(spark, d):
    """What knowing the weather is worth: intervals calibrated by regimes of the lagged proxy, and of the realised temperature."""
    p = b.predictions(spark, d)
    known = p.withColumn("temperature_c", F.col("evaluation_temperature_c"))
    known = conformal.with_regime(known, conformal.temperature_thresholds(known.where("split = 'calibration'"), 0.05))
    known = conformal.calibrate(known, conformal.corrections(known.where("split = 'calibration'"), 0.2, b.LEAST))
    one, two = (df.groupBy("model", "split").agg(F.avg(winkler(F.col("y_true"), F.col("q10"), F.col("q90"))).alias(n)) for df, n in ((b.calibrated(spark, d), "a"), (known, "c")))
    return one.join(two, ["model", "split"]).withColumn("winkler_difference", F.col("a") - F.col("c"))


@query("model:s persistence:d daily:d weekly:d", b.sql("SELECT split AS model, avg(CASE WHEN model = 'persistence' THEN abs(y_true - y_pred) END) AS persistence, avg(CASE WHEN model = 'daily' THEN abs(y_true - y_pred) END) AS daily, avg(CASE WHEN model = 'weekly' THEN abs(y_true - y_pred) END) AS weekly FROM pred GROUP BY 1", "pred"))
def model_pivot(spark, d):
    return b.predictions(spark, d).groupBy(F.col("split").alias("model")).pivot("model", ["persistence", "daily", "weekly"]).agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))))


@query("model:s split:s hp_type:s h1:d h2:d h4:d", b.sql("SELECT model, split, hp_type, " + ", ".join(f"avg(CASE WHEN horizon = {h} THEN CAST(y_true BETWEEN q10 AND q90 AS DOUBLE) END) AS h{h}" for h in (1, 2, 4)) + " FROM cal GROUP BY 1, 2, 3", "cal"))
def picp_matrix(spark, d):
    return reports.picp_matrix(metrics.forecast_metrics(b.calibrated(spark, d)), [1, 2, 4])


# ---- portfolios ----

_SUMS = "SELECT portfolio_id, cohort, portfolio_type, portfolio_size, model, split, origin, target, horizon, count(DISTINCT household_id) AS households, sum(y_true) AS y_true, sum(q10) AS q10, sum(q50) AS q50, sum(q90) AS q90, count(DISTINCT household_id) / CAST(portfolio_size AS DOUBLE) AS coverage FROM (SELECT m.*, c.* EXCLUDE (household_id) FROM members m JOIN cal c USING (household_id)) GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9 HAVING count(DISTINCT household_id) >= 0.9 * portfolio_size"
_BOUNDS = f"""SELECT portfolio_type, portfolio_size, model, horizon, max(n) AS calibration_rows, count(DISTINCT (origin, target)) AS calibration_n, max(CASE WHEN i = greatest(CAST(floor((n + 1) * 0.1e0 + 1e-9) AS BIGINT), 1) THEN r END) AS lower_residual, max(CASE WHEN i = {b.upper_rank_sql('n', 0.9)} THEN r END) AS upper_residual, count(DISTINCT (origin, target)) >= 10 AS calibration_valid
  FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_type, portfolio_size, model, horizon ORDER BY r) AS i, count(*) OVER (PARTITION BY portfolio_type, portfolio_size, model, horizon) AS n FROM (SELECT *, y_true - q50 AS r FROM sums WHERE cohort = 'seen' AND split = 'calibration')) GROUP BY 1, 2, 3, 4"""
_WITH = "SELECT s.* EXCLUDE (q10, q90), coalesce(greatest(q50 + lower_residual, 0), q10) AS q10, coalesce(q50 + upper_residual, q90) AS q90, coalesce(calibration_n, 0) AS calibration_n, coalesce(calibration_valid, false) AS calibration_valid FROM sums s LEFT JOIN bounds USING (portfolio_type, portfolio_size, model, horizon)"
_LIMITS = "SELECT portfolio_type, portfolio_size, quantile_cont(y_true, 0.5) AS threshold FROM (SELECT portfolio_id, portfolio_type, portfolio_size, origin, horizon, min(y_true) AS y_true FROM sums WHERE cohort = 'seen' AND split = 'calibration' GROUP BY ALL) GROUP BY 1, 2"
_PF = dict(members=_MEMBERS, sums=_SUMS, bounds=_BOUNDS, bounded=_WITH, limits=_LIMITS)


def _pf(select: str) -> str:
    return b.sql(select, "roles", "cal", **_PF)


@artifact
def _sums(spark, d):
    return portfolio.aggregate(b.calibrated(spark, d).drop("hp_type"), members(spark, d), 0.9)


def _bounded(spark, d):
    s = _sums(spark, d)
    return portfolio.with_bounds(s, portfolio.residual_bounds(s, 0.2, 10))


@query("portfolio_id:s model:s split:s origin:i horizon:i households:i y_true:d q10:d q50:d q90:d coverage:d", _pf("SELECT * FROM sums"))
def portfolio_aggregate(spark, d):
    return _sums(spark, d)


@query("portfolio_id:s rows:i", _pf("SELECT portfolio_id, count(*) AS rows FROM members JOIN cal USING (household_id) GROUP BY 1"))
def portfolio_semi_agg(spark, d):
    return members(spark, d).join(b.calibrated(spark, d), "household_id").groupBy("portfolio_id").agg(F.count("*").alias("rows"))


@query("portfolio_type:s portfolio_size:i model:s horizon:i calibration_rows:i calibration_n:i lower_residual:d upper_residual:d calibration_valid:b", _pf("SELECT * FROM bounds"))
def portfolio_calibration(spark, d):
    return portfolio.residual_bounds(_sums(spark, d), 0.2, 10)


@query("portfolio_id:s model:s split:s origin:i horizon:i q10:d q90:d calibration_n:i calibration_valid:b", _pf("SELECT * FROM bounded"))
def portfolio_intervals(spark, d):
    return _bounded(spark, d)


@query("portfolio_type:s portfolio_size:i threshold:d", _pf("SELECT * FROM limits"))
def peak_thresholds(spark, d):
    return portfolio.peak_thresholds(_sums(spark, d), 0.5)


@query("portfolio_id:s origin:i horizon:i truths:i", _pf("SELECT portfolio_id, origin, horizon, count(DISTINCT floor(y_true * 1000 + 0.5)) AS truths FROM sums GROUP BY 1, 2, 3"))
def oracle_consistency(spark, d):
    return _sums(spark, d).groupBy("portfolio_id", "origin", "horizon").agg(F.count_distinct(F.floor(F.col("y_true") * 1000 + 0.5)).alias("truths"))


@artifact
def _detail(spark, d):
    rows = _bounded(spark, d)
    return portfolio.manage_peaks(rows, portfolio.peak_thresholds(rows, 0.5), 4, [0.1, 0.2], [6, 12], 1 / 6)


_TRAJECTORIES = """SELECT portfolio_id, cohort, portfolio_type, portfolio_size, split, origin, model, any_value(threshold) AS threshold,
    list(y_true ORDER BY horizon) AS y, list(q50 ORDER BY horizon) AS mid, list(q90 ORDER BY horizon) AS high
  FROM bounded JOIN limits USING (portfolio_type, portfolio_size)
  WHERE split IN ('seen_test', 'unseen_test') AND calibration_valid GROUP BY 1, 2, 3, 4, 5, 6, 7 HAVING count(*) >= 4 AND any_value(threshold) IS NOT NULL"""
_SIGNALS = """SELECT portfolio_id, split, origin, model, threshold, y, strategy, CASE strategy WHEN 'median' THEN mid ELSE high END AS signal FROM trajectories, (SELECT unnest(['median', 'conformal_upper_bound']) AS strategy)
  UNION ALL SELECT portfolio_id, split, origin, 'perfect_foresight', threshold, y, 'perfect_foresight', y FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id, split, origin ORDER BY model) AS r FROM trajectories) WHERE r = 1"""
#: The scheduling kernel, one step of the path at a time: the k-th highest step moves its load, in the plan and in what is done.
_SCHEDULED = """SELECT *, 0 AS k, list_transform(signal, lambda x: greatest(x, 0.0)) AS plan, [false, false, false, false] AS busy, y AS done, CAST(0.0 AS DOUBLE) AS moved, 0 AS interventions, 0 AS rejected,
    list_transform(list_sort([{'s': -signal[i], 'i': -i} for i in range(1, 5)]), lambda x: -x.i) AS ranked
  FROM (SELECT portfolio_id, model, strategy, split, origin, flexible_fraction, shift_hours, threshold, y, signal FROM signals, (SELECT unnest([0.1e0, 0.2e0]) AS flexible_fraction), (SELECT unnest([6, 12]) AS shift_hours))
  UNION ALL SELECT portfolio_id, model, strategy, split, origin, flexible_fraction, shift_hours, threshold, y, signal, k + 1,
    CASE WHEN moves THEN [CASE i WHEN a THEN plan[i] - amount WHEN c THEN plan[i] + amount ELSE plan[i] END for i in range(1, 5)] ELSE plan END,
    CASE WHEN moves THEN [busy[i] OR i = a OR i = c for i in range(1, 5)] ELSE busy END,
    CASE WHEN moves THEN [CASE i WHEN a THEN done[i] - given WHEN c THEN done[i] + given ELSE done[i] END for i in range(1, 5)] ELSE done END,
    CASE WHEN moves THEN moved + given ELSE moved END, interventions + CAST(moves AS INT), rejected + CAST(asked AND NOT moves AS INT), ranked
  FROM (SELECT *, asked AND amount > 0 AND plan[c] + amount <= list_max(plan) + 1e-12 AS moves, least(amount, greatest(0.0, done[a])) AS given FROM (
    SELECT *, CASE WHEN c IS NULL THEN 0.0 ELSE least(greatest(0.0, flexible_fraction * plan[a]), greatest(0.0, threshold - plan[c])) END AS amount FROM (
      SELECT *, signal[a] > threshold AND NOT busy[a] AND a < 4 AS asked, list_sort([{'s': signal[i], 'i': i} for i in range(a + 1, least(4, a + shift_hours // 6) + 1) if signal[i] < signal[a]])[1].i AS c FROM (
        SELECT *, CAST(ranked[k + 1] AS BIGINT) AS a FROM scheduled WHERE k < 4))))"""
_DETAIL_SQL = """SELECT portfolio_id, model, split, origin, strategy, flexible_fraction, shift_hours, threshold, list_max(y) AS peak_before, list_max(done) AS peak_after, list_max(y) - list_max(done) AS peak_reduction, moved AS shifted_energy,
    interventions, rejected AS rejected_interventions, abs(list_sum(done) - list_sum(y)) AS energy_balance_error, list_max(y) > threshold AS actual_peak_event, list_max(signal) > threshold AS predicted_peak_event,
    list_max(y) > threshold AND NOT list_max(signal) > threshold AS missed_event, list_max(signal) > threshold AND NOT list_max(y) > threshold AS false_intervention FROM scheduled WHERE k = 4
  UNION ALL SELECT portfolio_id, model, split, origin, 'reference_no_forecast', 0.0, 0, threshold, list_max(y), list_max(y), 0.0, 0.0, 0, 0, 0.0, list_max(y) > threshold, false, list_max(y) > threshold, false FROM trajectories"""


def _detail_sql(select: str) -> str:
    return b.sql(select, "roles", "cal", **_PF, trajectories=_TRAJECTORIES, signals=_SIGNALS, scheduled=_SCHEDULED, detail=_DETAIL_SQL).replace("WITH ", "WITH RECURSIVE ", 1)


@query("portfolio_id:s model:s split:s origin:i strategy:s flexible_fraction:d shift_hours:i threshold:d peak_before:d peak_after:d peak_reduction:d shifted_energy:d interventions:i rejected_interventions:i energy_balance_error:d actual_peak_event:b predicted_peak_event:b missed_event:b false_intervention:b", _detail_sql("SELECT * FROM detail"))
def peak_management(spark, d):
    """Sequential scheduling of each trajectory."""
    return _detail(spark, d)


_NOFORECAST = "SELECT portfolio_id, model, split, origin, max(y_true) AS peak_before, max(y_true) > any_value(threshold) AS actual_peak_event, max(q50) > any_value(threshold) AS median_sees, max(q90) > any_value(threshold) AS bound_sees FROM bounded JOIN limits USING (portfolio_type, portfolio_size) WHERE split IN ('seen_test', 'unseen_test') AND calibration_valid GROUP BY 1, 2, 3, 4 HAVING count(*) >= 4"


@query("portfolio_id:s model:s split:s origins:i actual_events:i median_events:i bound_events:i", _pf(f"SELECT portfolio_id, model, split, count(*) AS origins, count(*) FILTER (actual_peak_event) AS actual_events, count(*) FILTER (median_sees) AS median_events, count(*) FILTER (bound_sees) AS bound_events FROM ({_NOFORECAST}) GROUP BY 1, 2, 3"))
def peak_events(spark, d):
    detail = _detail(spark, d).where("strategy = 'reference_no_forecast' OR (flexible_fraction = 0.1 AND shift_hours = 6 AND model <> 'perfect_foresight')")
    of = lambda s, c: F.count_if((F.col("strategy") == s) & F.col(c))
    return detail.groupBy("portfolio_id", "model", "split").agg(
        F.count_if(F.col("strategy") == "reference_no_forecast").alias("origins"), of("reference_no_forecast", "actual_peak_event").alias("actual_events"), of("median", "predicted_peak_event").alias("median_events"), of("conformal_upper_bound", "predicted_peak_event").alias("bound_events"),
    )


@query("portfolio_id:s model:s split:s strategy:s flexible_fraction:d shift_hours:i n_origins:i mean_peak_reduction:d median_peak_reduction:d min_peak_reduction:d max_peak_reduction:d interventions:i missed_events:i false_interventions:i", _detail_sql("SELECT portfolio_id, model, split, strategy, flexible_fraction, shift_hours, count(*) AS n_origins, avg(peak_reduction) AS mean_peak_reduction, median(peak_reduction) AS median_peak_reduction, min(peak_reduction) AS min_peak_reduction, max(peak_reduction) AS max_peak_reduction, sum(interventions) AS interventions, count(*) FILTER (missed_event) AS missed_events, count(*) FILTER (false_intervention) AS false_interventions FROM detail GROUP BY 1, 2, 3, 4, 5, 6"))
def peak_summary(spark, d):
    return portfolio.summarise(_detail(spark, d))


@query("rows:i energy_violations:i foresight_peak_violations:i foresight_event_violations:i", _detail_sql("SELECT count(*) AS rows, count(*) FILTER (energy_balance_error > 1e-8) AS energy_violations, count(*) FILTER (strategy = 'perfect_foresight' AND peak_after > peak_before + 1e-9) AS foresight_peak_violations, count(*) FILTER (strategy = 'perfect_foresight' AND (missed_event OR false_intervention)) AS foresight_event_violations FROM detail"))
def energy_invariants(spark, d):
    return portfolio.invariants(_detail(spark, d)).crossJoin(_detail(spark, d).agg(F.count("*").alias("rows")))


@query("min_samples:i portfolio_type:s portfolio_size:i cells:i valid_cells:i valid_fraction:d reportable:b min_n:i median_n:d max_n:i", _pf("SELECT min_samples, portfolio_type, portfolio_size, count(*) AS cells, count(*) FILTER (calibration_n >= min_samples) AS valid_cells, avg(CAST(calibration_n >= min_samples AS DOUBLE)) AS valid_fraction, bool_and(calibration_n >= min_samples) AS reportable, min(calibration_n) AS min_n, median(calibration_n) AS median_n, max(calibration_n) AS max_n FROM bounds, (SELECT unnest([10, 15, 50]) AS min_samples) GROUP BY 1, 2, 3"))
def portfolio_sensitivity(spark, d):
    return reports.sensitivity(portfolio.residual_bounds(_sums(spark, d), 0.2, 10), [10, 15, 50])


@query("portfolio_type:s portfolio_size:i", _pf("SELECT portfolio_type, portfolio_size FROM bounds GROUP BY 1, 2 HAVING bool_and(calibration_valid)"))
def valid_pairs(spark, d):
    return reports.valid_pairs(portfolio.residual_bounds(_sums(spark, d), 0.2, 10))


@query("portfolio_type:s n_origins:i portfolios:i missed_events_per_100:d", _pf(f"SELECT portfolio_type, count(*) AS n_origins, count(DISTINCT portfolio_id) AS portfolios, 100.0 * count(*) FILTER (actual_peak_event) / count(*) AS missed_events_per_100 FROM ({_NOFORECAST}) JOIN (SELECT DISTINCT portfolio_id, portfolio_type FROM members) USING (portfolio_id) GROUP BY 1"))
def portfolio_report_aggregate(spark, d):
    return reports.portfolio_report(portfolio.summarise(_detail(spark, d).where("strategy = 'reference_no_forecast'")), ["portfolio_type"])


@query("portfolio_type:s strategy:s label:s mean_peak_reduction:d n_origins:i", _detail_sql("SELECT portfolio_type, strategy, CASE strategy " + " ".join(f"WHEN '{x}' THEN '{reports.LABELS.get(x, x.replace('_', ' ').title())}'" for x in ("median", "conformal_upper_bound", "perfect_foresight")) + " END AS label, avg(peak_reduction) AS mean_peak_reduction, count(*) AS n_origins FROM detail JOIN (SELECT DISTINCT portfolio_id, portfolio_type FROM members) USING (portfolio_id) WHERE flexible_fraction = 0.2 AND shift_hours = 6 GROUP BY 1, 2"))
def table_portfolio(spark, d):
    out = reports.portfolio_report(portfolio.summarise(_detail(spark, d).where("flexible_fraction = 0.2 AND shift_hours = 6")), ["portfolio_type", "strategy"])
    return out.withColumn("label", reports.label(F.col("strategy")))


@query("portfolio_id:s model:s origin:i shift_hours:i shifted_energy:d interventions:i rejected_interventions:i energy_balance_error:d", _detail_sql("SELECT * FROM detail WHERE strategy = 'median' AND flexible_fraction = 0.2"))
def shift_profile(spark, d):
    """The scheduling kernel's outcome per trajectory, for one fraction and the median signal."""
    return _detail(spark, d).where("strategy = 'median' AND flexible_fraction = 0.2")


@query("stage:s rows:i", _pf("SELECT 'members' AS stage, count(*) AS rows FROM members UNION ALL SELECT 'aggregates', count(*) FROM sums UNION ALL SELECT 'corrections', count(*) FROM bounds UNION ALL SELECT 'thresholds', count(*) FROM limits"))
def portfolio_pipeline(spark, d):
    """Membership, aggregation, calibration and thresholds as one chain: rows of each stage."""
    s = _sums(spark, d)
    stages = {"members": members(spark, d), "aggregates": s, "corrections": portfolio.residual_bounds(s, 0.2, 10), "thresholds": portfolio.peak_thresholds(s, 0.5)}
    out = None
    for name, df in stages.items():
        part = df.agg(F.count("*").alias("rows")).withColumn("stage", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


_GATES = {
    "intervals_ordered": "q10 <= q50 AND q50 <= q90", "intervals_never_narrower": "q10 <= q10_raw AND q90 >= q90_raw", "bounds_not_negative": "q10 >= 0", "corrections_not_negative": "conformal_correction >= 0",
    "targets_follow_horizons": "target - origin = horizon", "levels_named": "conformal_level IS NOT NULL",
}


@query("gate:s failures:i passed:b", b.sql("SELECT gate, failures, failures = 0 AS passed FROM (" + " UNION ALL ".join(f"SELECT '{g}' AS gate, count(*) FILTER (NOT ({c})) AS failures FROM cal" for g, c in _GATES.items()) + ")", "cal"))
def validation_report(spark, d):
    counts = b.calibrated(spark, d).agg(*(F.count_if(~F.expr(c)).alias(g) for g, c in _GATES.items()))
    long = F.inline(F.array(*(F.struct(F.lit(g).alias("gate"), F.col(g).alias("failures")) for g in _GATES)))
    return counts.select(long).withColumn("passed", F.col("failures") == 0)


# ---- inference ----

_DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT"
_ERR = "abs(y_true - y_pred)"
_DAYS = f"SELECT model, split, household_id, target // 4 AS day, sum({_ERR}) AS mae, sum(CAST(y_true BETWEEN q10 AND q90 AS DOUBLE)) AS picp, count(*) AS n FROM cal WHERE split LIKE '%test' GROUP BY 1, 2, 3, 4"
_HOUSES = "SELECT model, split, household_id, sum(mae) AS mae, sum(picp) AS picp, sum(n) AS n, row_number() OVER (PARTITION BY model, split ORDER BY household_id) - 1 AS h, count(*) OVER (PARTITION BY model, split) AS size FROM days GROUP BY 1, 2, 3"
_LABEL = "':' || model || ':' || split || ':' || rep || ':' || slot"
_SLOTS = f"SELECT model, split, rep, slot, {_DRAW.format(chr(39) + '11' + chr(39) + ' || ' + _LABEL)} % size AS h FROM (SELECT model, split, h AS slot, size, unnest(generate_series(0, 49)) AS rep FROM houses)"
_REPS = "SELECT s.model, s.split, rep, sum(mae) / sum(n) AS mae, sum(picp) / sum(n) AS picp FROM slots s JOIN houses h USING (model, split, h) GROUP BY 1, 2, 3"
_BOOT = dict(days=_DAYS, houses=_HOUSES, slots=_SLOTS, reps=_REPS)
_NEST = dict(
    _BOOT,
    dayrows="SELECT d.*, h.h, row_number() OVER (PARTITION BY d.model, d.split, d.household_id ORDER BY day) - 1 AS dn, count(*) OVER (PARTITION BY d.model, d.split, d.household_id) AS dayn FROM days d JOIN houses h USING (model, split, household_id)",
    dayslots=f"SELECT model, split, rep, slot, h, {_DRAW.format(chr(39) + '12' + chr(39) + ' || ' + _LABEL + ' || ' + chr(39) + ':' + chr(39) + ' || dayslot')} % dayn AS dn FROM (SELECT s.*, k.dayn, unnest(generate_series(0, k.dayn - 1)) AS dayslot FROM slots s JOIN (SELECT model, split, h, max(dayn) AS dayn FROM dayrows GROUP BY 1, 2, 3) k USING (model, split, h))",
    nested="SELECT s.model, s.split, rep, sum(mae) / sum(n) AS mae, sum(picp) / sum(n) AS picp FROM dayslots s JOIN dayrows d USING (model, split, h, dn) GROUP BY 1, 2, 3",
)
_G = ["model", "split"]


def _days(spark, d):
    c = b.calibrated(spark, d).where("split LIKE '%test'").withColumn("day", F.floor(F.col("target") / 4))
    return inference.day_table(c, _G, "day", {"mae": F.abs(F.col("y_true") - F.col("y_pred")), "picp": F.col("y_true").between(F.col("q10"), F.col("q90")).cast("double")})


@query("model:s split:s household_id:i day:i mae:d picp:d n:i", b.sql("SELECT * FROM days", "cal", days=_DAYS))
def household_day_blocks(spark, d):
    return _days(spark, d)


@query("model:s split:s rep:i mae:d picp:d", b.sql("SELECT * FROM reps", "cal", **_BOOT))
def cluster_bootstrap_ratio(spark, d):
    return inference.ratio_draws(_days(spark, d), _G, "day", ["mae", "picp"], 50, 11)


@query("model:s split:s rep:i mae:d picp:d", b.sql("SELECT * FROM nested", "cal", **_NEST))
def nested_bootstrap_ratio(spark, d):
    return inference.ratio_draws(_days(spark, d), _G, "day", ["mae", "picp"], 50, 11, nested=True)


@query("model:s split:s mae:d picp:d n_households:i n_rows:i mae_ci_low:d mae_ci_high:d picp_ci_low:d picp_ci_high:d cluster_inference_reliable:b", b.sql("SELECT model, split, p.mae, p.picp, p.n_households, p.n_rows, i.a AS mae_ci_low, i.z AS mae_ci_high, i.pa AS picp_ci_low, i.pz AS picp_ci_high, p.n_households >= 5 AS cluster_inference_reliable FROM (SELECT model, split, sum(mae) / sum(n) AS mae, sum(picp) / sum(n) AS picp, count(*) AS n_households, sum(n) AS n_rows FROM houses GROUP BY 1, 2) p JOIN (SELECT model, split, quantile_cont(mae, 0.025) AS a, quantile_cont(mae, 0.975) AS z, quantile_cont(picp, 0.025) AS pa, quantile_cont(picp, 0.975) AS pz FROM reps GROUP BY 1, 2) i USING (model, split)", "cal", **_BOOT))
def hierarchical_metric_intervals(spark, d):
    c = b.calibrated(spark, d).where("split LIKE '%test'").withColumn("day", F.floor(F.col("target") / 4))
    return inference.metric_intervals(c, _G, "day", 50, 11, reliable=5)


_DELTA = "SELECT split, household_id, origin, target, horizon, candidate, comparator, abs(a.y_true - a.y_pred) - abs(c.y_true - c.y_pred) AS delta FROM (SELECT * FROM (SELECT unnest(['weekly', 'daily']) AS candidate, unnest(['daily', 'persistence']) AS comparator)) p JOIN cal a ON a.model = p.candidate JOIN (SELECT household_id, origin, target, horizon, split, model AS cm, y_true, y_pred FROM cal) c USING (household_id, origin, target, horizon, split) WHERE c.cm = p.comparator AND split LIKE '%test'"
_PLABEL = "':' || split || ':' || candidate || ':' || comparator || ':' || rep || ':' || slot"
_PAIRED = dict(
    delta=_DELTA,
    houses="SELECT split, candidate, comparator, household_id, sum(delta) AS d, count(*) AS n, row_number() OVER (PARTITION BY split, candidate, comparator ORDER BY household_id) - 1 AS h, count(*) OVER (PARTITION BY split, candidate, comparator) AS size FROM delta GROUP BY 1, 2, 3, 4",
    slots=f"SELECT split, candidate, comparator, rep, {_DRAW.format(chr(39) + '13' + chr(39) + ' || ' + _PLABEL)} % size AS h FROM (SELECT split, candidate, comparator, h AS slot, size, unnest(generate_series(0, 49)) AS rep FROM houses)",
    reps="SELECT split, candidate, comparator, rep, sum(d) / sum(n) AS x FROM slots JOIN houses USING (split, candidate, comparator, h) GROUP BY 1, 2, 3, 4",
    tests="SELECT split, candidate, comparator, p.mae_delta, p.n_households, i.lo AS mae_delta_ci_low, i.hi AS mae_delta_ci_high, least(1.0, 2 * least((i.low + 1) / (i.n + 1), (i.high + 1) / (i.n + 1))) AS bootstrap_p_value_two_sided, i.better AS probability_better, p.n_households >= 5 AS cluster_inference_reliable FROM (SELECT split, candidate, comparator, sum(d) / sum(n) AS mae_delta, count(*) AS n_households FROM houses GROUP BY 1, 2, 3) p JOIN (SELECT split, candidate, comparator, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi, CAST(count(*) FILTER (x <= 0) AS DOUBLE) AS low, CAST(count(*) FILTER (x >= 0) AS DOUBLE) AS high, CAST(count(*) AS DOUBLE) AS n, avg(CAST(x < 0 AS DOUBLE)) AS better FROM reps GROUP BY 1, 2, 3) i USING (split, candidate, comparator)",
    holm="SELECT *, least(1.0, max((m - r + 1) * bootstrap_p_value_two_sided) OVER (PARTITION BY candidate, comparator ORDER BY r ROWS UNBOUNDED PRECEDING)) AS holm_p_value FROM (SELECT *, row_number() OVER (PARTITION BY candidate, comparator ORDER BY bootstrap_p_value_two_sided) AS r, count(*) OVER (PARTITION BY candidate, comparator) AS m FROM tests)",
)
_PAIRS = [("weekly", "daily"), ("daily", "persistence")]


@artifact
def _deltas(spark, d):
    c = b.calibrated(spark, d).where("split LIKE '%test'")
    return inference.paired(c, _PAIRS, ["split"], ["household_id", "origin", "target", "horizon"]).withColumn("day", F.floor(F.col("target") / 4))


def _tests(spark, d):
    return inference.paired_test(_deltas(spark, d), ["split"], "day", 50, 13, reliable=5)


_TEST = "split:s candidate:s comparator:s mae_delta:d n_households:i mae_delta_ci_low:d mae_delta_ci_high:d bootstrap_p_value_two_sided:d probability_better:d cluster_inference_reliable:b"


@query(_TEST, b.sql("SELECT * FROM tests", "cal", **_PAIRED))
def hierarchical_paired_test(spark, d):
    return _tests(spark, d)


_HOLM_OUT = "SELECT split, candidate, comparator, mae_delta, holm_p_value, holm_p_value < 0.05 AS significant_holm, holm_p_value < 0.05 AND cluster_inference_reliable AS confirmatory_holm, CASE WHEN mae_delta < 0 THEN 'candidate_better' WHEN mae_delta > 0 THEN 'candidate_worse' ELSE 'tie' END AS effect_direction FROM holm"


@query("split:s candidate:s comparator:s holm_p_value:d significant_holm:b confirmatory_holm:b effect_direction:s", b.sql(_HOLM_OUT, "cal", **_PAIRED))
def holm_adjust(spark, d):
    return inference.holm(_tests(spark, d))


@query("tests:i significant:i better:i worse:i confirmatory:i", b.sql(f"SELECT count(*) AS tests, count(*) FILTER (significant_holm) AS significant, count(*) FILTER (significant_holm AND mae_delta < 0) AS better, count(*) FILTER (significant_holm AND mae_delta > 0) AS worse, count(*) FILTER (confirmatory_holm) AS confirmatory FROM ({_HOLM_OUT})", "cal", **_PAIRED))
def test_summary(spark, d):
    return reports.test_summary(inference.holm(_tests(spark, d)))


@query("split:s candidate:s comparator:s candidate_label:s holm_p_value:d", b.sql(f"SELECT split, candidate, comparator, CASE candidate WHEN 'weekly' THEN 'Weekly seasonal' ELSE 'Daily seasonal' END AS candidate_label, holm_p_value FROM ({_HOLM_OUT}) WHERE confirmatory_holm", "cal", **_PAIRED))
def table_confirmatory(spark, d):
    return inference.holm(_tests(spark, d)).where("confirmatory_holm").withColumn("candidate_label", reports.label(F.col("candidate")))


_BLOCKS = dict(
    blocks="SELECT model, split, household_id, target // 4 AS day, avg(abs(y_true - y_pred)) AS mae FROM cal WHERE split LIKE '%test' GROUP BY 1, 2, 3, 4",
    ranked="SELECT *, row_number() OVER (PARTITION BY model, split ORDER BY household_id, day) - 1 AS k, count(*) OVER (PARTITION BY model, split) AS size FROM blocks",
    bslots=f"SELECT model, split, rep, {_DRAW.format(chr(39) + '17' + chr(39) + ' || ' + _LABEL)} % size AS k FROM (SELECT model, split, k AS slot, size, unnest(generate_series(0, 29)) AS rep FROM ranked)",
)


def _blocks(spark, d):
    c = b.calibrated(spark, d).where("split LIKE '%test'")
    return c.groupBy("model", "split", "household_id", F.floor(F.col("target") / 4).alias("day")).agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae"))


@query("model:s split:s household_id:i day:i mae:d", b.sql("SELECT * FROM blocks", "cal", **_BLOCKS))
def block_means(spark, d):
    return _blocks(spark, d)


@query("model:s split:s mae_ci_low:d mae_ci_high:d", b.sql("SELECT model, split, quantile_cont(mae, 0.025) AS mae_ci_low, quantile_cont(mae, 0.975) AS mae_ci_high FROM (SELECT model, split, rep, avg(mae) AS mae FROM bslots JOIN ranked USING (model, split, k) GROUP BY 1, 2, 3) GROUP BY 1, 2", "cal", **_BLOCKS))
def block_bootstrap_intervals(spark, d):
    draws = inference.block_draws(_blocks(spark, d), _G, ["household_id", "day"], "mae", 30, 17)
    return inference.intervals(draws, _G, "mae")


_PBLOCK = dict(
    delta=_DELTA,
    ranked="SELECT *, row_number() OVER (PARTITION BY split, candidate, comparator ORDER BY household_id, day) - 1 AS k, count(*) OVER (PARTITION BY split, candidate, comparator) AS size FROM (SELECT split, candidate, comparator, household_id, target // 4 AS day, avg(delta) AS x FROM delta GROUP BY 1, 2, 3, 4, 5)",
    pslots=f"SELECT split, candidate, comparator, rep, {_DRAW.format(chr(39) + '19' + chr(39) + ' || ' + _PLABEL)} % size AS k FROM (SELECT split, candidate, comparator, k AS slot, size, unnest(generate_series(0, 29)) AS rep FROM ranked)",
)


@query("split:s candidate:s comparator:s low:i high:i p:d", b.sql("SELECT split, candidate, comparator, count(*) FILTER (x <= 0) AS low, count(*) FILTER (x >= 0) AS high, least(1.0, 2 * least(count(*) FILTER (x <= 0), count(*) FILTER (x >= 0)) / CAST(count(*) AS DOUBLE)) AS p FROM (SELECT split, candidate, comparator, rep, avg(x) AS x FROM pslots JOIN ranked USING (split, candidate, comparator, k) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3", "cal", **_PBLOCK))
def paired_block_bootstrap(spark, d):
    groups = ["split", "candidate", "comparator"]
    blocks = _deltas(spark, d).groupBy(*groups, "household_id", "day").agg(F.avg("delta").alias("x"))
    draws = inference.block_draws(blocks, groups, ["household_id", "day"], "x", 30, 19)
    low, high = F.count_if(F.col("x") <= 0), F.count_if(F.col("x") >= 0)
    return draws.groupBy(*groups).agg(low.alias("low"), high.alias("high"), F.least(F.lit(1.0), 2 * F.least(low, high) / F.count("*")).alias("p"))


_PCI = dict(_PF, events=f"SELECT * FROM ({_NOFORECAST})",
    ids="SELECT split, portfolio_id, CAST(count(*) FILTER (actual_peak_event) AS DOUBLE) AS e, count(*) AS n, row_number() OVER (PARTITION BY split ORDER BY portfolio_id) - 1 AS k, count(*) OVER (PARTITION BY split) AS size FROM peak_rows GROUP BY 1, 2")
_PCI = {("peak_rows" if k == "events" else k): v for k, v in _PCI.items()}
_PCI["cslots"] = f"SELECT split, rep, {_DRAW.format(chr(39) + '23:' + chr(39) + ' || split || ' + chr(39) + ':' + chr(39) + ' || rep || ' + chr(39) + ':' + chr(39) + ' || slot')} % size AS k FROM (SELECT split, k AS slot, size, unnest(generate_series(0, 39)) AS rep FROM ids)"


@query("split:s rate_ci_low:d rate_ci_high:d", b.sql("SELECT split, quantile_cont(rate, 0.025) AS rate_ci_low, quantile_cont(rate, 0.975) AS rate_ci_high FROM (SELECT split, rep, sum(e) / sum(n) AS rate FROM cslots JOIN ids USING (split, k) GROUP BY 1, 2) GROUP BY 1", "roles", "cal", **_PCI))
def portfolio_cluster_ci(spark, d):
    detail = _detail(spark, d).where("strategy = 'reference_no_forecast'")
    per = detail.groupBy("split", F.col("portfolio_id").alias("household_id"), F.lit(0).alias("day")).agg(F.sum(F.col("actual_peak_event").cast("double")).alias("rate"), F.count("*").alias("n"))
    return inference.intervals(inference.ratio_draws(per, ["split"], "day", ["rate"], 40, 23), ["split"], "rate")


# ---- reports ----

_M = dict(met=f"SELECT {_CELL}, {_METRICS} FROM cal GROUP BY ALL")


@query("split:s cells:i rows:i models:s macro_picp:d macro_wis:d micro_picp:d micro_wis:d micro_winkler:d", b.sql("SELECT split, count(*) AS cells, sum(n) AS rows, string_agg(DISTINCT model, ',' ORDER BY model) AS models, avg(picp) AS macro_picp, avg(wis) AS macro_wis, sum(picp * n) / sum(n) AS micro_picp, sum(wis * n) / sum(n) AS micro_wis, sum(winkler * n) / sum(n) AS micro_winkler FROM met GROUP BY 1", "cal", **_M))
def calibration_index_audit(spark, d):
    return reports.calibration_audit(metrics.forecast_metrics(b.calibrated(spark, d)))


_WS = dict(_M, ws="SELECT model, split, hp_type, sum(mae * n) / sum(n) AS mae, sum(approx_crps * n) / sum(n) AS approx_crps, sum(n) AS n FROM met WHERE split LIKE '%test' GROUP BY 1, 2, 3")


def _summary(spark, d):
    return reports.weighted(metrics.forecast_metrics(b.calibrated(spark, d).where("split LIKE '%test'")), ["model", "split", "hp_type"], ["mae", "approx_crps"])


@query("model:s split:s hp_type:s mae:d approx_crps:d n:i", b.sql("SELECT * FROM ws", "cal", **_WS))
def weighted_summary(spark, d):
    return _summary(spark, d)


@query("split:s hp_type:s best_mae_model:s best_mae:d best_approx_crps_model:s best_approx_crps:d", b.sql("SELECT split, hp_type, arg_min(model, mae) AS best_mae_model, min(mae) AS best_mae, arg_min(model, approx_crps) AS best_approx_crps_model, min(approx_crps) AS best_approx_crps FROM ws GROUP BY 1, 2", "cal", **_WS))
def winner_table(spark, d):
    return reports.winners(_summary(spark, d), ["split", "hp_type"], ["mae", "approx_crps"])


@query("split:s hp_type:s households:i", b.sql("SELECT split, hp_type, max(k) AS households FROM (SELECT split, hp_type, model, count(DISTINCT household_id) AS k FROM cal GROUP BY 1, 2, 3) GROUP BY 1, 2", "cal"))
def household_counts(spark, d):
    per = b.calibrated(spark, d).groupBy("split", "hp_type", "model").agg(F.count_distinct("household_id").alias("k"))
    return per.groupBy("split", "hp_type").agg(F.max("k").alias("households"))


@query("cohort:s households:i ashp:i gshp:i", b.sql("SELECT cohort, count(*) AS households, count(*) FILTER (hp_type = 'ASHP') AS ashp, count(*) FILTER (hp_type = 'GSHP') AS gshp FROM (SELECT 'all' AS cohort, * FROM roles UNION ALL SELECT CASE WHEN role = 'train' THEN 'train' ELSE 'unseen' END, * FROM roles) GROUP BY 1", "roles"))
def cohort_table(spark, d):
    return reports.cohort_table(b.roles(spark, d))


@query("primary_id:i delta:d nested_delta:d", "SELECT p_partkey AS primary_id, p_retailprice AS delta, s_acctbal AS nested_delta FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def paired_merge(spark, d):
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("primary_id"), F.col("p_retailprice").alias("delta"))
    return p.join(b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("primary_id"), F.col("s_acctbal").alias("nested_delta")), "primary_id", "left")


@query("orderkey:i nation:s region:s price:d", "SELECT o_orderkey AS orderkey, coalesce(n_name, 'unknown') AS nation, coalesce(r_name, 'unknown') AS region, o_totalprice AS price FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def dense_lookup(spark, d):
    t = lambda n: b.table(spark, d, n)
    dims = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", "r_name")
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(dims, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return o.select(F.col("o_orderkey").alias("orderkey"), F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.coalesce("r_name", F.lit("unknown")).alias("region"), F.col("o_totalprice").alias("price"))


@query("model:s label:s", "SELECT * FROM (VALUES ('persistence', 'Persistence'), ('daily', 'Daily seasonal'), ('boosted_trees', 'Boosted Trees')) AS t (model, label)")
def label_map(spark, d):
    return spark.createDataFrame([("persistence",), ("daily",), ("boosted_trees",)], "model string").withColumn("label", reports.label(F.col("model")))


@query("name:s label:s", "SELECT * FROM (VALUES ('cal_hour_sin', 'Hour Sin'), ('static__Survey_Building_LivingArea', 'Survey Building Livingarea'), ('load_lag_1', 'Lag 1'), ('temperature', 'Temperature')) AS t (name, label)")
def feature_labels(spark, d):
    return spark.createDataFrame([("cal_hour_sin",), ("static__Survey_Building_LivingArea",), ("load_lag_1",), ("temperature",)], "name string").withColumn("label", reports.feature_label(F.col("name")))


@query("portfolio_key:s lines:i", "SELECT l_returnflag || '_' || l_linestatus || '_' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') AS portfolio_key, count(*) AS lines FROM lineitem GROUP BY 1")
def id_composition(spark, d):
    key = F.concat_ws("_", "l_returnflag", "l_linestatus", F.lpad(F.col("l_linenumber").cast("string"), 3, "0"))
    return b.table(spark, d, "lineitem").groupBy(key.alias("portfolio_key")).agg(F.count("*").alias("lines"))


@query("hp_type:s feature:s importance:d", "SELECT hp_type, feature, avg(abs(c)) AS importance FROM (SELECT CASE WHEN l_suppkey % 3 = 0 THEN 'GSHP' ELSE 'ASHP' END AS hp_type, unnest(['tax', 'discount', 'quantity']) AS feature, unnest([l_tax, l_discount - 0.05::DOUBLE, l_quantity / 100]) AS c FROM lineitem) GROUP BY 1, 2")
def shap_rank(spark, d):
    return _contributions(spark, d).groupBy("hp_type", "feature").agg(F.avg(F.abs("contribution")).alias("importance"))


def _contributions(spark, d):
    cells = F.array(*(F.struct(F.lit(n).alias("feature"), c.alias("contribution")) for n, c in (("tax", F.col("l_tax")), ("discount", F.col("l_discount") - 0.05), ("quantity", F.col("l_quantity") / 100))))
    return b.table(spark, d, "lineitem").select(b.hp("l_suppkey").alias("hp_type"), F.inline(cells))


@query("feature:s overall:d ASHP:d GSHP:d", "SELECT feature, avg(i) AS overall, max(CASE WHEN hp_type = 'ASHP' THEN i END) AS ASHP, max(CASE WHEN hp_type = 'GSHP' THEN i END) AS GSHP FROM (SELECT hp_type, feature, avg(abs(c)) AS i FROM (SELECT CASE WHEN l_suppkey % 3 = 0 THEN 'GSHP' ELSE 'ASHP' END AS hp_type, unnest(['tax', 'discount', 'quantity']) AS feature, unnest([l_tax, l_discount - 0.05::DOUBLE, l_quantity / 100]) AS c FROM lineitem) GROUP BY 1, 2) GROUP BY 1 ORDER BY overall DESC, feature LIMIT 2")
def topk_features(spark, d):
    return reports.importance(_contributions(spark, d), 2)


@query("model:s levels:i n:i mae:d", b.sql("SELECT coalesce(model, '(all)') AS model, CAST(grouping(model) + grouping(split) AS BIGINT) AS levels, count(*) AS n, avg(abs(y_true - y_pred)) AS mae FROM pred GROUP BY GROUPING SETS ((model, split), (model), ())", "pred"))
def grouping_levels(spark, d):
    b.predictions(spark, d).createOrReplaceTempView("_predictions")
    return spark.sql("SELECT coalesce(model, '(all)') AS model, cast(grouping(model) + grouping(split) AS bigint) AS levels, count(*) AS n, avg(abs(y_true - y_pred)) AS mae FROM _predictions GROUP BY GROUPING SETS ((model, split), (model), ())")


@query("signature:s", "SELECT sha256('{\"alpha\":0.2,\"horizons\":[1,4,24,96],\"seed\":2026}') AS signature")
def config_signature(spark, d):
    from tidepanel.plans.config import signature

    return spark.createDataFrame([(signature({"seed": 2026, "alpha": 0.2, "horizons": [1, 4, 24, 96]}),)], "signature string")


# ---- learned models: no SQL; held to properties in tests ----


def _encoded(spark, d):
    rows = b.supervised(spark, d).fillna(0.0, ["baseline_daily", "baseline_weekly", "causal"])
    return rows, ["baseline_persistence", "baseline_daily", "baseline_weekly", "horizon_sqrt", "causal"]


@query("household_id:i origin:i horizon:i split:s model:s y_true:d y_pred:d q10:d q50:d q90:d")
def elastic_net(spark, d):
    rows, names = _encoded(spark, d)
    return models.ElasticNet(names).fit(rows.where("split = 'train'")).predict(rows.where("split LIKE '%test'"))


@query("household_id:i origin:i horizon:i split:s model:s y_true:d y_pred:d q10:d q50:d q90:d")
def boosted_quantiles(spark, d):
    rows, names = _encoded(spark, d)
    return models.BoostedQuantiles(names).fit(rows.where("split = 'train'"), rows.where("split = 'unseen_validation'")).predict(rows.where("split LIKE '%test'"))


@query("trained_on:s hp_type:s mae:d")
def transfer_experiment(spark, d):
    """A model trained on one type, or both, scored on each type."""
    rows, names = _encoded(spark, d)
    out = None
    for name, where in (("ASHP", "hp_type = 'ASHP'"), ("GSHP", "hp_type = 'GSHP'"), ("combined", "true")):
        p = models.ElasticNet(names).fit(rows.where(f"split = 'train' AND {where}")).predict(rows.where("split LIKE '%test'"))
        part = p.groupBy("hp_type").agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae")).withColumn("trained_on", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("fold:i mae:d n:i")
def rolling_validation(spark, d):
    """One fit per fold up to its cutoff, scored on the origins of the fold's evaluation time."""
    from tidepanel.operators import splits

    rows, names = _encoded(spark, d)
    out = None
    for f in splits.rolling_cutoffs(b.p6(spark, d).select(F.col("step").alias("start"), F.col("step").alias("end")), 3).collect():
        p = models.ElasticNet(names).fit(rows.where(F.col("origin") <= f.train_end)).predict(rows.where((F.col("origin") > f.train_end) & (F.col("origin") <= f.evaluation_end)))
        part = p.agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae"), F.count("*").alias("n")).withColumn("fold", F.lit(f.fold))
        out = part if out is None else out.unionByName(part)
    return out


@query("feature:s hp_type:s contribution:d")
def permutation_importance(spark, d):
    rows, names = _encoded(spark, d)
    model = models.ElasticNet(names).fit(rows.where("split = 'train'"))
    return models.permutation_importance(model.predict, rows.where("split LIKE '%test'"), names)
