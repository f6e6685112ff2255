"""Frames that the queries share, over the ``events`` table, and the same as SQL common table expressions.

A household is a group of some twelve users, so their number follows the data (12 at least), its load the sum of event values in steps of six hours (``p6``, without
gaps) or one hour (``p1``, with gaps); amounts are summed as whole cents, so sums don't depend on their order.
"Weather" is the mean value of view events, visits are the steps of signups of at least 200.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions.artifacts import artifact
from tidepanel.functions.columns import micros
from tidepanel.operators import conformal, grid, metrics, models, origins, splits

HOUR, SIX = 3_600_000_000, 21_600_000_000
HISTORY, FORECAST, SEASON, WEEK, HORIZONS = 28, 4, 4, 28, [1, 2, 3, 4]
LEAST = 100


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def hp(c="household_id"):
    return F.when(F.col(c) % 3 == 0, "GSHP").otherwise("ASHP")


def houses(spark, d) -> DataFrame:
    """One row (``n``): how many households there are."""
    return table(spark, d, "events").agg(F.greatest(F.lit(12), F.floor((F.max("user_id") + 1) / 12)).cast("long").alias("n"))


def events(spark, d) -> DataFrame:
    e = table(spark, d, "events").crossJoin(F.broadcast(houses(spark, d)))
    return e.select("event_id", "ts", "user_id", "event_type", "props", (F.col("user_id") % F.col("n")).alias("household_id"), F.floor(micros("ts") / HOUR).alias("hour"), F.floor(F.col("value") * 100 + 0.5).alias("cents"))


def readings(spark, d, hours: int = 6) -> DataFrame:
    return events(spark, d).groupBy("household_id", F.floor(F.col("hour") / hours).alias("step")).agg(F.sum("cents").alias("cents"))


def roles(spark, d) -> DataFrame:
    ids = houses(spark, d).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("household_id"))
    twelfth = F.col("household_id") % 12
    return ids.select("household_id", hp().alias("hp_type"), F.when(twelfth == 9, "unseen_validation").when(twelfth.isin(10, 11), "unseen_test").otherwise("train").alias("role"))


@artifact
def p6(spark, d) -> DataFrame:
    g = grid.regular_grid(readings(spark, d), common=True)
    return g.select("household_id", hp().alias("hp_type"), "step", (F.coalesce("cents", F.lit(0)) / 100.0).alias("y"), F.lit(0).alias("segment_id"), F.lit(0).alias("originally_missing"))


@artifact
def p1(spark, d) -> DataFrame:
    g = grid.regular_grid(readings(spark, d, 1))
    return g.select("household_id", hp().alias("hp_type"), "step", (F.col("cents") / 100.0).alias("y"))


@artifact
def filled(spark, d) -> DataFrame:
    return grid.visit_segments(grid.fill_short_gaps(p1(spark, d), 1), visits(spark, d, 1))


def weather(spark, d, hours: int = 6) -> DataFrame:
    e = events(spark, d).where("event_type = 'view'")
    return e.groupBy(F.floor(F.col("hour") / hours).alias("step")).agg((F.sum("cents") / F.count("*") / 100.0).alias("temperature"))


@artifact
def household_weather(spark, d) -> DataFrame:
    e = events(spark, d).where("event_type = 'view'")
    return e.groupBy("household_id", F.col("hour").alias("step")).agg((F.sum("cents") / F.count("*") / 100.0).alias("temperature"))


def visits(spark, d, hours: int = 6) -> DataFrame:
    return events(spark, d).where("event_type = 'signup' AND cents >= 20000").select("household_id", F.floor(F.col("hour") / hours).alias("visit_step")).distinct()


@artifact
def cutoffs(spark, d) -> DataFrame:
    return splits.cutoffs(p6(spark, d), start="step", end="step")


@artifact
def supervised(spark, d) -> DataFrame:
    """All supervised rows with their split; train and calibration paths end inside their time."""
    panel = grid.lagged(p6(spark, d).join(weather(spark, d), "step", "left"), "temperature", SEASON, "operational")
    panel = grid.causal_fill(panel, "temperature", "causal", 2)
    found = origins.valid_origins(origins.contained(panel, FORECAST), HISTORY, FORECAST)
    rows = origins.supervised(panel, found, HORIZONS, SEASON, WEEK, keep=("path_end", "causal"), future=("temperature", "operational"))
    rows = rows.join(roles(spark, d).drop("hp_type"), "household_id").crossJoin(F.broadcast(cutoffs(spark, d)))
    rows = rows.withColumn("split", splits.split_label(F.col("origin"), F.col("train_end"), F.col("calibration_end"), F.col("role")))
    late = F.when(F.col("split") == "train", F.col("path_end") > F.col("train_end")).when(F.col("split") == "calibration", F.col("path_end") > F.col("calibration_end")).otherwise(False)
    return rows.where(~late).drop("global_start", "global_end", "role")


def predictions(spark, d) -> DataFrame:
    rows = supervised(spark, d).withColumn("temperature_c", F.coalesce("future__operational", "causal"))
    return models.baselines(rows, keep=("temperature_c", F.col("future__temperature").alias("evaluation_temperature_c")))


@artifact
def regimes(spark, d) -> DataFrame:
    p = predictions(spark, d)
    return conformal.with_regime(p, conformal.temperature_thresholds(p.where("split = 'calibration'"), 0.05))


@artifact
def corrections(spark, d) -> DataFrame:
    return conformal.corrections(regimes(spark, d).where("split = 'calibration'"), 0.2, LEAST)


@artifact
def calibrated(spark, d) -> DataFrame:
    return conformal.calibrate(regimes(spark, d), corrections(spark, d))


@artifact
def scales(spark, d) -> DataFrame:
    panel = p6(spark, d).crossJoin(F.broadcast(cutoffs(spark, d).select("train_end")))
    return metrics.seasonal_scales(panel, roles(spark, d), F.col("train_end"), SEASON, 8)


def scored(spark, d) -> DataFrame:
    return metrics.attach_scale(calibrated(spark, d), scales(spark, d))


# ---- the same in SQL ----

_HP = "CASE WHEN household_id % 3 = 0 THEN 'GSHP' ELSE 'ASHP' END"
_KEYS = ("model", "hp_type", "horizon", "temperature_regime")


def _level(i: int, keys: tuple[str, ...]) -> str:
    cols = ", ".join(k if k in keys else f"CAST(NULL AS {'BIGINT' if k == 'horizon' else 'VARCHAR'}) AS {k}" for k in _KEYS)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    return f"SELECT {i} AS level, {cols}, s, row_number() OVER ({part} ORDER BY s) AS nth, count(*) OVER ({part}) AS n FROM scores"


def upper_rank_sql(n: str, p: float) -> str:
    return f"CASE WHEN ceil(({n} + 1) * {p!r} - 1e-9) < {n} THEN CAST(ceil(({n} + 1) * {p!r} - 1e-9) AS BIGINT) + 1 ELSE {n} END"


_LEVELS = (_KEYS, _KEYS[:3], ("model", "horizon"), ("model",), ())

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), f"SELECT event_id, ts, user_id, event_type, props, user_id % (SELECT greatest(12, (max(user_id) + 1) // 12) FROM events) AS household_id, epoch_us(ts) // {HOUR} AS hour, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents FROM events"),
    "r6": (("ev",), "SELECT household_id, hour // 6 AS step, sum(cents) AS cents FROM ev GROUP BY 1, 2"),
    "r1": (("ev",), "SELECT household_id, hour AS step, sum(cents) AS cents FROM ev GROUP BY 1, 2"),
    "p6": (("r6",), f"SELECT household_id, {_HP} AS hp_type, step, coalesce(CAST(cents AS DOUBLE), 0) / 100.0 AS y, 0 AS segment_id, 0 AS originally_missing FROM (SELECT household_id, unnest(generate_series((SELECT min(step) FROM r6), (SELECT max(step) FROM r6))) AS step FROM (SELECT DISTINCT household_id FROM r6)) LEFT JOIN r6 USING (household_id, step)"),
    "p1": (("r1",), f"SELECT household_id, {_HP} AS hp_type, step, CAST(cents AS DOUBLE) / 100.0 AS y FROM (SELECT household_id, unnest(generate_series(a, b)) AS step FROM (SELECT household_id, min(step) AS a, max(step) AS b FROM r1 GROUP BY 1)) LEFT JOIN r1 USING (household_id, step)"),
    "runs": (("p1",), "SELECT *, count(*) OVER (PARTITION BY household_id, run_id) AS run_size FROM (SELECT * EXCLUDE (change), CAST(sum(change) OVER (PARTITION BY household_id ORDER BY step) AS BIGINT) AS run_id FROM (SELECT *, y IS NULL AS missing, coalesce(CAST((y IS NULL) <> lag(y IS NULL) OVER (PARTITION BY household_id ORDER BY step) AS INT), 1) AS change FROM p1))"),
    "short": (("runs",), """SELECT household_id, hp_type, step, CAST(missing AS INT) AS originally_missing,
        CASE WHEN missing AND run_size <= 1 THEN v0 + (v1 - v0) * (step - t0) / (t1 - t0) ELSE y END AS y
        FROM (SELECT *, last_value(y IGNORE NULLS) OVER w AS v0, last_value(CASE WHEN y IS NOT NULL THEN step END IGNORE NULLS) OVER w AS t0,
                first_value(y IGNORE NULLS) OVER u AS v1, first_value(CASE WHEN y IS NOT NULL THEN step END IGNORE NULLS) OVER u AS t1 FROM runs
              WINDOW w AS (PARTITION BY household_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), u AS (PARTITION BY household_id ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""),
    "v1": (("ev",), "SELECT DISTINCT household_id, hour AS visit_step FROM ev WHERE event_type = 'signup' AND cents >= 20000"),
    "filled": (("short", "v1"), "SELECT s.*, (SELECT count(*) FROM v1 WHERE v1.household_id = s.household_id AND v1.visit_step <= s.step) AS segment_id FROM short s"),
    "seqs": (("filled",), """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY sequence_id) AS n FROM (SELECT *, household_id || '_' || segment_id || '_' || gap AS sequence_id FROM
        (SELECT *, CAST(sum(CAST(y IS NULL OR originally_missing = 1 AS INT)) OVER (PARTITION BY household_id ORDER BY step) AS BIGINT) AS gap FROM filled) WHERE y IS NOT NULL AND originally_missing = 0)) WHERE n >= 8"""),
    "hw": (("ev",), "SELECT household_id, hour AS step, CAST(sum(cents) AS DOUBLE) / count(*) / 100.0 AS temperature FROM ev WHERE event_type = 'view' GROUP BY 1, 2"),
    "w6": (("ev",), "SELECT hour // 6 AS step, CAST(sum(cents) AS DOUBLE) / count(*) / 100.0 AS temperature FROM ev WHERE event_type = 'view' GROUP BY 1"),
    "cutoffs": (("p6",), "SELECT global_start, global_end, train_end, train_end + 0.15e0 * (global_end - global_start) AS calibration_end FROM (SELECT min(step) AS global_start, max(step) AS global_end, min(step) + 0.7e0 * (max(step) - min(step)) AS train_end FROM p6)"),
    "roles": ((), f"SELECT household_id, {_HP} AS hp_type, CASE household_id % 12 WHEN 9 THEN 'unseen_validation' WHEN 10 THEN 'unseen_test' WHEN 11 THEN 'unseen_test' ELSE 'train' END AS role FROM (SELECT unnest(generate_series(0, (SELECT greatest(12, (max(user_id) + 1) // 12) - 1 FROM events))) AS household_id)"),
    "pos": (("p6", "w6"), f"""SELECT *, last_value(CASE WHEN step % 2 = 0 THEN temperature END IGNORE NULLS) OVER (PARTITION BY household_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS causal
        FROM (SELECT p6.*, w6.temperature, lag(w6.temperature, {SEASON}) OVER w AS operational, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY household_id) AS len, lead(p6.step, {FORECAST}) OVER w AS path_end
              FROM p6 LEFT JOIN w6 USING (step) WINDOW w AS (PARTITION BY household_id ORDER BY p6.step))"""),
    "sup": (("pos", "roles", "cutoffs"), f"""SELECT * EXCLUDE (role, train_end, calibration_end) FROM (
        SELECT o.household_id, o.hp_type, o.segment_id, o.pos, o.step AS origin, t.step AS target, h.horizon, sqrt(CAST(h.horizon AS DOUBLE)) AS horizon_sqrt, o.path_end, t.y AS y_true, o.y AS baseline_persistence, dd.y AS baseline_daily, ww.y AS baseline_weekly,
          o.causal, t.temperature AS future__temperature, t.operational AS future__operational, r.role, c.train_end, c.calibration_end,
          CASE WHEN r.role <> 'train' THEN r.role WHEN o.step <= c.train_end THEN 'train' WHEN o.step <= c.calibration_end THEN 'calibration' ELSE 'seen_test' END AS split
        FROM pos o CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS horizon) h JOIN pos t ON t.household_id = o.household_id AND t.pos = o.pos + h.horizon
        LEFT JOIN pos dd ON dd.household_id = o.household_id AND dd.pos = o.pos + h.horizon - {SEASON} LEFT JOIN pos ww ON ww.household_id = o.household_id AND ww.pos = o.pos + h.horizon - {WEEK}
        JOIN roles r ON r.household_id = o.household_id CROSS JOIN cutoffs c WHERE o.pos >= {HISTORY} AND o.pos < o.len - {FORECAST})
        WHERE NOT ((split = 'train' AND path_end > train_end) OR (split = 'calibration' AND path_end > calibration_end))"""),
    "pred": (("sup",), "SELECT household_id, hp_type, origin, target, horizon, split, y_true, model, y_pred, y_pred AS q10, y_pred AS q50, y_pred AS q90, coalesce(future__operational, causal) AS temperature_c, future__temperature AS evaluation_temperature_c FROM (SELECT *, unnest(['persistence', 'daily', 'weekly']) AS model, unnest([baseline_persistence, baseline_daily, baseline_weekly]) AS y_pred FROM sup) WHERE y_pred IS NOT NULL"),
    "cold": (("pred",), "SELECT hp_type, quantile_cont(temperature_c, 0.05) AS cold_below FROM pred WHERE split = 'calibration' AND temperature_c IS NOT NULL GROUP BY 1"),
    "reg": (("pred", "cold"), "SELECT pred.*, CASE WHEN temperature_c IS NULL OR cold_below IS NULL THEN 'unknown' WHEN temperature_c <= cold_below THEN 'cold' ELSE 'normal' END AS temperature_regime FROM pred LEFT JOIN cold USING (hp_type)"),
    "scores": (("reg",), "SELECT model, hp_type, CAST(horizon AS BIGINT) AS horizon, temperature_regime, greatest(q10 - y_true, y_true - q90, 0) AS s FROM reg WHERE split = 'calibration'"),
    "corr": (("scores",), f"SELECT level, model, hp_type, horizon, temperature_regime, s AS correction, n FROM ({' UNION ALL '.join(_level(i, k) for i, k in enumerate(_LEVELS))}) WHERE nth = {upper_rank_sql('n', 0.8)} AND (n >= {LEAST} OR level = 4)"),
    "cal": (("reg", "corr"), "SELECT r.* EXCLUDE (q10, q90), r.q10 AS q10_raw, r.q90 AS q90_raw, greatest(r.q10 - coalesce(a.correction, b.correction, c.correction, d.correction, e.correction), 0) AS q10, r.q90 + coalesce(a.correction, b.correction, c.correction, d.correction, e.correction) AS q90, coalesce(a.correction, b.correction, c.correction, d.correction, e.correction) AS conformal_correction, coalesce(a.n, b.n, c.n, d.n) AS conformal_calibration_n, CASE WHEN a.n IS NOT NULL THEN 'model+hp_type+horizon+temperature_regime' WHEN b.n IS NOT NULL THEN 'model+hp_type+horizon' WHEN c.n IS NOT NULL THEN 'model+horizon' WHEN d.n IS NOT NULL THEN 'model' ELSE 'pooled' END AS conformal_level FROM reg r LEFT JOIN corr a ON a.level = 0 AND a.model = r.model AND a.hp_type = r.hp_type AND a.horizon = r.horizon AND a.temperature_regime = r.temperature_regime LEFT JOIN corr b ON b.level = 1 AND b.model = r.model AND b.hp_type = r.hp_type AND b.horizon = r.horizon LEFT JOIN corr c ON c.level = 2 AND c.model = r.model AND c.horizon = r.horizon LEFT JOIN corr d ON d.level = 3 AND d.model = r.model LEFT JOIN corr e ON e.level = 4"),
    "own": (("p6", "cutoffs"), f"SELECT household_id, avg(d) AS s, count(d) AS n FROM (SELECT household_id, abs(y - lag(y, {SEASON}) OVER (PARTITION BY household_id ORDER BY step)) AS d FROM p6, cutoffs WHERE step <= train_end) GROUP BY 1"),
    "scales": (("own", "roles"), "SELECT household_id, hp_type, coalesce(s, (SELECT median(x.s) FROM (SELECT * REPLACE (CASE WHEN n >= 8 AND s > 0 THEN s END AS s) FROM own) x JOIN roles y USING (household_id) WHERE y.role = 'train' AND y.hp_type = z.hp_type)) AS mase_scale, n AS mase_scale_n, 'own_pre_train_history' AS mase_scale_source FROM (SELECT r.household_id, r.hp_type, r.role, CASE WHEN n >= 8 AND s > 0 THEN s END AS s, coalesce(n, 0) AS n FROM roles r LEFT JOIN own USING (household_id)) z"),
    "scored": (("cal", "scales"), "SELECT cal.*, mase_scale FROM cal JOIN scales USING (household_id)"),
}


def sql(select: str, *names: str, **more: str) -> str:
    """``select`` with the named expressions, and those they need, before it; ``more`` adds expressions of its own."""
    order: list[str] = []

    def need(name: str) -> None:
        if name not in order and name not in more:
            for x in CTES[name][0]:
                need(x)
            order.append(name)

    for n in names:
        need(n)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + select

