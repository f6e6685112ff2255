"""Queries over readings, grids, features, origins and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions.artifacts import artifact
from tidepanel.functions.columns import draw, finite, isclose, numeric, sorted_quantiles, thin
from tidepanel.operators import encode, features, grid, metrics, origins, quality, splits
from tidepanel.plans import base as b
from tidepanel.plans.registry import query

W = "PARTITION BY household_id ORDER BY step"


# ---- sources and dimensions ----


@query("household_id:i name:s events:i", "SELECT coalesce(c_custkey, u) AS household_id, c_name AS name, n AS events FROM customer FULL JOIN (SELECT user_id AS u, count(*) AS n FROM events GROUP BY 1) ON c_custkey = u")
def meta_outer_join(spark, d):
    left = b.table(spark, d, "customer").select(F.col("c_custkey").alias("household_id"), F.col("c_name").alias("name"))
    right = b.table(spark, d, "events").groupBy(F.col("user_id").alias("household_id")).agg(F.count("*").alias("events"))
    return left.join(right, "household_id", "full")


@query("event_id:i visit:s", "SELECT event_id, CAST(try_cast(CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE substr(CAST(ts AS VARCHAR), 1, 10) END AS DATE) AS VARCHAR) AS visit FROM events WHERE event_type = 'signup'")
def protocols_tolerant(spark, d):
    e = b.table(spark, d, "events").where("event_type = 'signup'")
    raw = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.substring(F.col("ts").cast("string"), 1, 10))
    return e.select("event_id", raw.try_cast("date").alias("visit"))


@query("household_id:i step:i event_id:i cents:i", b.sql("SELECT household_id, hour AS step, event_id, cents FROM (SELECT *, row_number() OVER (PARTITION BY household_id, hour ORDER BY event_id DESC) AS r FROM ev) WHERE r = 1", "ev"))
def meter_dedup_last(spark, d):
    e = b.events(spark, d).select("household_id", F.col("hour").alias("step"), F.col("event_id").alias("o"), "event_id", "cents")
    return grid.dedup_last(e, ["household_id", "step"], "o")


@query("household_id:i rows:i temperature:d", b.sql("SELECT household_id, count(*) AS rows, avg(temperature) AS temperature FROM (SELECT r.household_id, w.temperature FROM roles r JOIN hw w ON w.household_id = try_cast(try_cast(r.household_id || '.0' AS DOUBLE) AS BIGINT)) GROUP BY 1", "roles", "hw"))
def weather_lookup(spark, d):
    houses = b.roles(spark, d).select("household_id", F.concat(F.col("household_id").cast("string"), F.lit(".0")).alias("weather_id"))
    weather = b.household_weather(spark, d).withColumnRenamed("household_id", "w")
    return houses.join(weather, F.col("weather_id").try_cast("double").try_cast("bigint") == F.col("w")).groupBy("household_id").agg(F.count("*").alias("rows"), F.avg("temperature").alias("temperature"))


@query("rows:i", "SELECT count(*) AS rows FROM lineitem")
def row_count(spark, d):
    return b.table(spark, d, "lineitem").agg(F.count("*").alias("rows"))


@query("event_type:s rows:i value:d", "SELECT event_type, count(*) AS rows, avg(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS value FROM events GROUP BY 1")
def projection_read(spark, d):
    return b.table(spark, d, "events").select("event_type", F.floor(F.col("value") * 100 + 0.5).alias("c")).groupBy("event_type").agg(F.count("*").alias("rows"), F.avg("c").alias("value"))


@query("custkey:i hp_type:s", "SELECT c_custkey AS custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'ASHP' WHEN 'MACHINERY' THEN 'GSHP' END AS hp_type FROM customer")
def hp_type_normalise(spark, d):
    c = F.col("c_mktsegment")
    return b.table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.when(c == "BUILDING", "ASHP").when(c == "MACHINERY", "GSHP").alias("hp_type"))


@query("household_id:i step:i static__acctbal:d static__segment:s", b.sql("SELECT p6.household_id, step, c_acctbal AS static__acctbal, c_mktsegment AS static__segment FROM p6 LEFT JOIN customer ON c_custkey = household_id", "p6"))
def static_attach(spark, d):
    c = b.table(spark, d, "customer").select(F.col("c_custkey").alias("household_id"), F.col("c_acctbal").alias("static__acctbal"), F.col("c_mktsegment").alias("static__segment"))
    return b.p6(spark, d).join(c, "household_id", "left")


@query("event_id:i k:d bad:d", "SELECT event_id, CASE WHEN isfinite(x) THEN x END AS k, CASE WHEN isfinite(y) THEN y END AS bad FROM (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS x, try_cast(CASE WHEN event_id % 3 = 0 THEN 'x1' WHEN event_id % 3 = 1 THEN 'NaN' ELSE '2.5' END AS DOUBLE) AS y FROM events)")
def numeric_coerce(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, "x1").when(F.col("event_id") % 3 == 1, "NaN").otherwise("2.5")
    return b.table(spark, d, "events").select("event_id", numeric(F.get_json_object("props", "$.k")).alias("k"), numeric(raw).alias("bad"))


# ---- filters ----


@query("event_id:i event_type:s", "SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click') AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def isin_filter(spark, d):
    chosen = b.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return b.table(spark, d, "events").where(F.col("event_type").isin("view", "click")).join(chosen, "user_id", "left_semi")


@query("model:s horizon:i rows:i", b.sql("SELECT model, horizon, count(*) AS rows FROM pred WHERE horizon IN (1, 4) GROUP BY 1, 2", "pred"))
def report_horizon_filter(spark, d):
    return b.predictions(spark, d).where(F.col("horizon").isin(1, 4)).groupBy("model", "horizon").agg(F.count("*").alias("rows"))


@query("household_id:i observed:i", b.sql("SELECT household_id, count(*) AS observed FROM p1 WHERE y IS NOT NULL AND isfinite(y) GROUP BY 1", "p1"))
def finite_filter(spark, d):
    return b.p1(spark, d).where(finite(F.col("y")).isNotNull()).groupBy("household_id").agg(F.count("*").alias("observed"))


@query("household_id:i rows:i first:i last:i", b.sql("SELECT household_id, count(*) AS rows, min(step) AS first, max(step) AS last FROM p6, cutoffs WHERE step > train_end AND step <= calibration_end GROUP BY 1", "p6", "cutoffs"))
def cutoff_range(spark, d):
    p = b.p6(spark, d).crossJoin(F.broadcast(b.cutoffs(spark, d))).where("step > train_end AND step <= calibration_end")
    return p.groupBy("household_id").agg(F.count("*").alias("rows"), F.min("step").alias("first"), F.max("step").alias("last"))


@query("household_id:i step:i y:d", b.sql("SELECT household_id, step, y FROM filled WHERE y IS NOT NULL AND segment_id IS NOT NULL", "filled"))
def required_dropna(spark, d):
    return b.filled(spark, d).na.drop(subset=["y", "segment_id"])


@query("orderkey:i linenumber:i", "SELECT l_orderkey AS orderkey, l_linenumber AS linenumber FROM lineitem WHERE abs(l_discount - 0.06::DOUBLE) <= 1e-8 + 1e-5 * abs(0.06::DOUBLE)")
def isclose_filter(spark, d):
    return b.table(spark, d, "lineitem").where(isclose(F.col("l_discount"), 0.06)).select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"))


@query("returnflag:s linestatus:s rows:i", "SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, count(*) AS rows FROM lineitem WHERE (l_returnflag, l_linestatus) IN (SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY 1, 2 HAVING max(l_quantity) >= 50) GROUP BY 1, 2")
def pair_membership(spark, d):
    li = b.table(spark, d, "lineitem")
    valid = li.groupBy("l_returnflag", "l_linestatus").agg(F.max("l_quantity").alias("q")).where("q >= 50").drop("q")
    return li.join(valid, ["l_returnflag", "l_linestatus"], "left_semi").groupBy(F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus")).agg(F.count("*").alias("rows"))


_CLIP = "list_sort([greatest(l_tax - 0.03::DOUBLE, 0), greatest(l_discount - 0.02::DOUBLE, 0), greatest(l_quantity / 1000, 0)])"


@query("orderkey:i linenumber:i q10:d q50:d q90:d", f"SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, q[1] AS q10, q[2] AS q50, q[3] AS q90 FROM (SELECT l_orderkey, l_linenumber, {_CLIP} AS q FROM lineitem)")
def clip_sort_quantiles(spark, d):
    lo, mid, hi = sorted_quantiles(F.col("l_tax") - 0.03, F.col("l_discount") - 0.02, F.col("l_quantity") / 1000)
    return b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"), lo.alias("q10"), mid.alias("q50"), hi.alias("q90"))


@query("model:s split:s picp:d picp_raw:d", b.sql("SELECT model, split, avg(CAST(y_true BETWEEN q10 AND q90 AS DOUBLE)) AS picp, avg(CAST(y_true BETWEEN q10_raw AND q90_raw AS DOUBLE)) AS picp_raw FROM cal GROUP BY 1, 2", "cal"))
def raw_interval_swap(spark, d):
    c = b.calibrated(spark, d)
    raw = c.withColumns({"q10": F.col("q10_raw"), "q90": F.col("q90_raw")})
    picp = lambda df, n: df.groupBy("model", "split").agg(F.avg(F.col("y_true").between(F.col("q10"), F.col("q90")).cast("double")).alias(n))
    return picp(c, "picp").join(picp(raw, "picp_raw"), ["model", "split"])


@query("household_id:i origin:i horizon:i temperature_c:d evaluation_temperature_c:d", b.sql("SELECT household_id, origin, horizon, coalesce(future__operational, causal) AS temperature_c, future__temperature AS evaluation_temperature_c FROM sup", "sup"))
def temperature_attach(spark, d):
    return b.supervised(spark, d).withColumns({"temperature_c": features.with_fallback("future__operational", "causal"), "evaluation_temperature_c": F.col("future__temperature")})


@query("horizon:i oracle:d operational:d", b.sql("SELECT horizon, avg(future__temperature) AS oracle, avg(future__operational) AS operational FROM sup GROUP BY 1", "sup"))
def scenario_weather(spark, d):
    pick = lambda s: features.scenario_value(s, "future__temperature", "future__operational")
    return b.supervised(spark, d).groupBy("horizon").agg(F.avg(pick("oracle")).alias("oracle"), F.avg(pick("operational")).alias("operational"))


# ---- grid ----


@query("household_id:i step:i y:d", b.sql("SELECT household_id, step, y FROM p1", "p1"))
def regular_grid(spark, d):
    return b.p1(spark, d)


@query("household_id:i step:i missing:b run_id:i run_size:i", b.sql("SELECT household_id, step, missing, run_id, run_size FROM runs", "runs"))
def gap_runs(spark, d):
    return grid.gap_runs(b.p1(spark, d))


@query("household_id:i step:i y:d originally_missing:i", b.sql("SELECT household_id, step, y, originally_missing FROM short", "short"))
def short_gap_interpolate(spark, d):
    return grid.fill_short_gaps(b.p1(spark, d), 1)


_UNION = b.sql(
    """SELECT p1.household_id, p1.step, f.temperature FROM p1 LEFT JOIN (
      SELECT household_id, step, CASE WHEN k > 0 AND row_number() OVER (PARTITION BY household_id, k ORDER BY step) - 1 <= 3 THEN CASE WHEN temperature IS NOT NULL THEN temperature ELSE v0 + (v1 - v0) * (step - t0) / (t1 - t0) END END AS temperature
      FROM (SELECT *, count(temperature) OVER w AS k, last_value(temperature IGNORE NULLS) OVER w AS v0, last_value(CASE WHEN temperature IS NOT NULL THEN step END IGNORE NULLS) OVER w AS t0,
              first_value(temperature IGNORE NULLS) OVER u AS v1, first_value(CASE WHEN temperature IS NOT NULL THEN step END IGNORE NULLS) OVER u AS t1
            FROM (SELECT household_id, step FROM p1 UNION SELECT household_id, step FROM hw) LEFT JOIN hw USING (household_id, step)
            WINDOW w AS (PARTITION BY household_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), u AS (PARTITION BY household_id ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    ) f ON f.household_id = p1.household_id AND f.step = p1.step""",
    "p1", "hw",
)


@query("household_id:i step:i temperature:d", _UNION)
def weather_interpolate(spark, d):
    return grid.interpolate_onto(b.p1(spark, d), b.household_weather(spark, d), "temperature", 3)


@query("household_id:i step:i operational:d causal:d", b.sql("SELECT household_id, step, operational, causal FROM pos", "pos"))
def weather_operational(spark, d):
    panel = b.p6(spark, d).join(b.weather(spark, d), "step", "left")
    return grid.causal_fill(grid.lagged(panel, "temperature", b.SEASON, "operational"), "temperature", "causal", 2)


@query("household_id:i step:i causal:d", b.sql(f"SELECT household_id, step, last_value(CASE WHEN step % 4 = 0 THEN temperature END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS causal FROM p1 LEFT JOIN hw USING (household_id, step)", "p1", "hw"))
def weather_causal_ffill(spark, d):
    panel = b.p1(spark, d).join(b.household_weather(spark, d), ["household_id", "step"], "left")
    return grid.causal_fill(panel, "temperature", "causal", 4)


@query("household_id:i step:i operational:d", b.sql(f"SELECT household_id, step, coalesce(operational, causal) AS operational FROM (SELECT household_id, step, lag(temperature, 24) OVER ({W}) AS operational, last_value(temperature IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS causal FROM p1 LEFT JOIN hw USING (household_id, step))", "p1", "hw"))
def weather_fallback(spark, d):
    panel = b.p1(spark, d).join(b.household_weather(spark, d), ["household_id", "step"], "left")
    panel = grid.causal_fill(grid.lagged(panel, "temperature", 24, "lagged"), "temperature", "causal", 1)
    return panel.withColumn("operational", features.with_fallback("lagged", "causal"))


@query("household_id:i step:i segment_id:i", b.sql("SELECT household_id, step, segment_id FROM filled", "filled"))
def visit_segments(spark, d):
    return b.filled(spark, d)


@query("household_id:i sequence_id:s step:i time_idx:i y:d", b.sql("SELECT household_id, sequence_id, step, step AS time_idx, y FROM seqs", "seqs"))
def tft_sequences(spark, d):
    return grid.continuous_sequences(b.filled(spark, d), 8)


_FILL = b.sql("SELECT s.household_id, s.step, coalesce(first_value(f IGNORE NULLS) OVER (PARTITION BY s.household_id ORDER BY s.step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), (SELECT median(temperature) FROM seqs JOIN hw USING (household_id, step))) AS temperature FROM (SELECT seqs.*, last_value(hw.temperature IGNORE NULLS) OVER (PARTITION BY sequence_id ORDER BY seqs.step ROWS UNBOUNDED PRECEDING) AS f FROM seqs LEFT JOIN hw USING (household_id, step)) s", "seqs", "hw")


@query("household_id:i step:i temperature:d", _FILL)
def tft_fill(spark, d):
    s = grid.continuous_sequences(b.filled(spark, d), 8).join(b.household_weather(spark, d), ["household_id", "step"], "left")
    return grid.fill_sequence_weather(s, "temperature")


@query("household_id:i step:i contiguous:b", b.sql(f"SELECT household_id, step, coalesce(step - lag(step, 4) OVER ({W}) = 4, false) AS contiguous FROM p1 WHERE y IS NOT NULL", "p1"))
def spacing_check(spark, d):
    return grid.spaced(b.p1(spark, d).where("y IS NOT NULL"), 4)


# ---- features ----


def _lags(spark, d):
    return features.load_features(b.filled(spark, d), lags=(1, 4, 24), windows=(4, 8), day=24, on=100.0)


def _full(x: str, k: int) -> str:
    return f"CASE WHEN count(y) OVER f{k} = {k} THEN {x} OVER f{k} END"


_FRAMES = "WINDOW w AS (" + W + "), " + ", ".join(f"f{k} AS ({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in (4, 8, 24))


def _feature(columns: str) -> str:
    return b.sql(f"SELECT household_id, step, {columns} FROM filled {_FRAMES}", "filled")


@query("household_id:i step:i load_lag_1:d load_lag_4:d load_lag_24:d", _feature("y AS load_lag_1, lag(y, 3) OVER w AS load_lag_4, lag(y, 23) OVER w AS load_lag_24"))
def load_lags(spark, d):
    return _lags(spark, d)


@query("household_id:i step:i load_roll_mean_4:d load_roll_std_4:d load_roll_mean_8:d load_roll_std_8:d", _feature(", ".join(f"{_full('avg(y)', k)} AS load_roll_mean_{k}, {_full('stddev_pop(y)', k)} AS load_roll_std_{k}" for k in (4, 8))))
def rolling_mean_std(spark, d):
    return _lags(spark, d)


@query("household_id:i step:i load_ramp_1:d load_ramp_4:d", _feature("y - lag(y, 1) OVER w AS load_ramp_1, y - lag(y, 4) OVER w AS load_ramp_4"))
def ramps(spark, d):
    return _lags(spark, d)


@query("household_id:i step:i load_day_min:d load_day_max:d load_day_base:d", _feature(f"{_full('min(y)', 24)} AS load_day_min, {_full('max(y)', 24)} AS load_day_max, {_full('quantile_cont(y, 0.1)', 24)} AS load_day_base"))
def day_min_max_base(spark, d):
    return _lags(spark, d)


@query("household_id:i step:i load_on_fraction:d load_transition_count:i", b.sql(f"SELECT household_id, step, CASE WHEN count(*) OVER f24 = 24 THEN avg(CAST(o AS DOUBLE)) OVER f24 END AS load_on_fraction, CASE WHEN count(*) OVER f24 = 24 THEN sum(CAST(t AS INT)) OVER f24 END AS load_transition_count FROM (SELECT *, coalesce(o <> lag(o) OVER w, true) AS t FROM (SELECT household_id, step, coalesce(y > 100, false) AS o FROM filled) WINDOW w AS ({W})) WINDOW f24 AS ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)", "filled"))
def on_fraction(spark, d):
    return _lags(spark, d)


@query("household_id:i step:i load_transition_count:i", b.sql(f"SELECT household_id, step, CASE WHEN count(*) OVER f24 = 24 THEN sum(CAST(t AS INT)) OVER f24 END AS load_transition_count FROM (SELECT *, coalesce(o <> lag(o) OVER w, true) AS t FROM (SELECT household_id, step, coalesce(y > 100, false) AS o FROM filled) WINDOW w AS ({W})) WINDOW f24 AS ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)", "filled"))
def transition_count(spark, d):
    return _lags(spark, d)


_LOCAL = "timezone('Europe/Zurich', timezone('UTC', ts))"


@query("event_id:i cal_hour_sin:d cal_hour_cos:d cal_dow_sin:d cal_dow_cos:d cal_doy_sin:d cal_doy_cos:d cal_weekend:i cal_month:i cal_year:i cal_public_holiday:i", f"""SELECT event_id, sin(2 * pi() * m / 1440) AS cal_hour_sin, cos(2 * pi() * m / 1440) AS cal_hour_cos, sin(2 * pi() * w / 7) AS cal_dow_sin, cos(2 * pi() * w / 7) AS cal_dow_cos,
      sin(2 * pi() * y / 365.25) AS cal_doy_sin, cos(2 * pi() * y / 365.25) AS cal_doy_cos, CAST(w >= 5 AS INT) AS cal_weekend, month(l) AS cal_month, year(l) AS cal_year, CAST(CAST(l AS DATE) IN (DATE '2024-01-01', DATE '2024-01-02') AS INT) AS cal_public_holiday
      FROM (SELECT event_id, l, hour(l) * 60 + minute(l) AS m, isodow(l) - 1 AS w, dayofyear(l) AS y FROM (SELECT event_id, {_LOCAL} AS l FROM events))""")
def calendar_features(spark, d):
    days = spark.sql("SELECT explode(array(DATE '2024-01-01', DATE '2024-01-02')) AS holiday")
    return features.calendar(b.table(spark, d, "events").select("event_id", "ts"), "ts", holidays=days)


@query("household_id:i local_day:s utc_day:s rows:i", b.sql(f"SELECT household_id, CAST(CAST({_LOCAL} AS DATE) AS VARCHAR) AS local_day, CAST(CAST(ts AS DATE) AS VARCHAR) AS utc_day, count(*) AS rows FROM ev GROUP BY 1, 2, 3", "ev"))
def local_and_utc_days(spark, d):
    local = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("Europe/Zurich"), F.col("ts")))
    return b.events(spark, d).groupBy("household_id", local.cast("string").alias("local_day"), F.to_date("ts").cast("string").alias("utc_day")).agg(F.count("*").alias("rows"))


@query("event_id:i idx:i back:s", f"SELECT event_id, epoch_us(ts) // 900000000 AS idx, CAST(make_timestamp((epoch_us(ts) // 900000000) * 900000000) AS VARCHAR) AS back FROM events")
def epoch_index(spark, d):
    from tidepanel.functions.columns import micros

    e = b.table(spark, d, "events").withColumn("idx", F.floor(micros("ts") / 900_000_000))
    return e.withColumn("back", F.date_format(F.timestamp_micros(F.col("idx") * 900_000_000), "yyyy-MM-dd HH:mm:ss"))


# ---- origins and supervised rows ----


@artifact
def _valid(spark, d):
    return origins.valid_origins(b.filled(spark, d), 6, 2, stride=1)


_VALID = f"""SELECT household_id, hp_type, step, pos, len FROM (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY household_id) AS len, lag(segment_id, 5) OVER w AS s0, lead(segment_id, 2) OVER w AS s1,
      count(y) OVER ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS past, sum(CASE WHEN y IS NOT NULL AND originally_missing = 0 THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS nxt
      FROM filled WINDOW w AS ({W})) WHERE pos >= 6 AND pos < len - 2 AND s0 = segment_id AND s1 = segment_id AND past = 6 AND nxt = 2 AND originally_missing = 0"""
_VALID_SQL = dict(valid=_VALID)


@query("household_id:i pos:i step:i", b.sql("SELECT household_id, pos, step FROM valid", "filled", **_VALID_SQL))
def valid_origins(spark, d):
    return _valid(spark, d)


@query("household_id:i pos:i", b.sql("SELECT household_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY household_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY household_id) AS n FROM valid) WHERE n <= 7 OR i IN (SELECT CASE WHEN j = 6 THEN n - 1 ELSE CAST(floor(j * ((n - 1) / 6.0::DOUBLE)) AS BIGINT) END FROM (SELECT unnest(generate_series(0, 6)) AS j))", "filled", **_VALID_SQL))
def thin_linspace(spark, d):
    return thin(_valid(spark, d), ["household_id"], ["pos"], 7)


def _strata_sql(groups: str, pool: str, most: int, hours: int, key: str) -> dict:
    base, extra = divmod(most, hours)
    spots = "CASE WHEN j = m - 1 AND m > 1 THEN n - 1 ELSE CAST(floor(j * ((n - 1) / CAST(greatest(m - 1, 1) AS DOUBLE))) AS BIGINT) END"
    keep = f"(n <= m OR i IN (SELECT {spots} FROM (SELECT unnest(generate_series(0, greatest(m - 1, 0))) AS j)))"
    return {
        "pool": pool,
        "chosen": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {groups}, hr ORDER BY {key}) - 1 AS i, count(*) OVER (PARTITION BY {groups}, hr) AS n, {base} + CAST(nth < {extra} AS INT) AS m FROM pool) WHERE m > 0 AND {keep}",
        "leftover": f"SELECT *, row_number() OVER (PARTITION BY {groups} ORDER BY {key}) - 1 AS i, count(*) OVER (PARTITION BY {groups}) AS n, {most} - (SELECT count(*) FROM chosen c WHERE {' AND '.join(f'c.{g.strip()} = p.{g.strip()}' for g in groups.split(','))}) AS m FROM pool p WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE {' AND '.join(f'c.{g.strip()} = p.{g.strip()}' for g in [*groups.split(','), key])})",
        "picked": f"SELECT {groups}, {key} FROM chosen UNION ALL SELECT {groups}, {key} FROM leftover WHERE m > 0 AND {keep}",
    }


@query("household_id:i step:i", b.sql("SELECT household_id, step FROM picked", "filled", **_VALID_SQL, **_strata_sql("household_id", "SELECT household_id, step, step % 24 AS hr, (step % 24) // 6 AS nth FROM valid WHERE step % 24 IN (0, 6, 12, 18)", 10, 4, "step")))
def clock_stratified_origins(spark, d):
    rows = _valid(spark, d).withColumn("hr", (F.col("step") % 24).cast("int"))
    return origins.clock_stratified(rows, ["household_id"], "hr", [0, 6, 12, 18], 10)


@query("household_id:i split:s origin:i", b.sql("SELECT household_id, split, origin FROM picked", "sup", **_strata_sql("household_id, split", "SELECT household_id, split, origin, origin % 4 AS hr, origin % 4 AS nth FROM sup WHERE horizon = 1 AND split IN ('calibration', 'seen_test', 'unseen_test')", 6, 4, "origin")))
def common_eval_index(spark, d):
    rows = b.supervised(spark, d).where("horizon = 1 AND split IN ('calibration', 'seen_test', 'unseen_test')").withColumn("hr", (F.col("origin") % 4).cast("int"))
    return origins.clock_stratified(rows.select("household_id", "split", "origin", "hr"), ["household_id", "split"], "hr", [0, 1, 2, 3], 6, order="origin")


@query("household_id:i step:i path_end:i inside:b", b.sql(f"SELECT household_id, step, lead(step, 4) OVER ({W}) AS path_end, lead(step, 4) OVER ({W}) <= train_end AS inside FROM p6, cutoffs", "p6", "cutoffs"))
def trajectory_containment(spark, d):
    return origins.contained(b.p6(spark, d), 4).crossJoin(F.broadcast(b.cutoffs(spark, d))).withColumn("inside", F.col("path_end") <= F.col("train_end"))


_SUP = "household_id:i hp_type:s origin:i target:i horizon:i horizon_sqrt:d split:s y_true:d baseline_persistence:d baseline_daily:d baseline_weekly:d future__temperature:d"


@query(_SUP, b.sql("SELECT * FROM sup", "sup"))
def make_supervised_rows(spark, d):
    return b.supervised(spark, d)


@query("household_id:i origins:i rows:i", b.sql("SELECT household_id, count(DISTINCT origin) AS origins, count(*) AS rows FROM sup GROUP BY 1", "sup"))
def origin_horizon_cross(spark, d):
    return b.supervised(spark, d).groupBy("household_id").agg(F.count_distinct("origin").alias("origins"), F.count("*").alias("rows"))


@query("household_id:i origin:i horizon:i split:s model:s y_pred:d", b.sql("SELECT * FROM pred", "pred"))
def seasonal_naive(spark, d):
    return b.predictions(spark, d)


@query("household_id:i step:i sequence_id:s", b.sql("SELECT household_id, step, sequence_id FROM (SELECT s.*, row_number() OVER (PARTITION BY s.household_id ORDER BY step DESC) AS r FROM seqs s JOIN (SELECT household_id, arg_max(sequence_id, e) AS sequence_id FROM (SELECT household_id, sequence_id, max(step) AS e FROM seqs GROUP BY 1, 2 HAVING count(*) >= 8) GROUP BY 1) USING (household_id, sequence_id)) WHERE r <= 12", "seqs"))
def latest_sequence(spark, d):
    return origins.latest_sequence(grid.continuous_sequences(b.filled(spark, d), 8), 1 << 40, 8, 12)


@query("household_id:i step:i role:s context:b", b.sql("SELECT household_id, step, CASE WHEN i > n - h THEN 'early_stop' ELSE 'fit' END AS role, i <= n - h AND i > n - h - 8 AS context FROM (SELECT *, greatest(4, CAST(ceil(n * 0.1e0 - 1e-9) AS BIGINT)) AS h FROM (SELECT household_id, step, row_number() OVER (PARTITION BY household_id ORDER BY step) AS i, count(*) OVER (PARTITION BY household_id) AS n FROM p6))", "p6"))
def fit_early_stop_blocks(spark, d):
    return origins.fit_and_stop_blocks(b.p6(spark, d), 8, 4, 0.1)


@query("household_id:i origin:i step:i", b.sql("SELECT household_id, origin, step FROM (SELECT w.household_id, w.origin, w.step, count(*) OVER (PARTITION BY sequence_id, origin) AS k FROM (SELECT o.household_id, o.sequence_id, o.step AS origin, s.step FROM seqs o JOIN seqs s ON s.sequence_id = o.sequence_id AND s.step > o.step - 4 AND s.step <= o.step + 2 WHERE o.step % 24 = 0) w) WHERE k = 6", "seqs"))
def eval_sequences(spark, d):
    s = grid.continuous_sequences(b.filled(spark, d), 8)
    return origins.evaluation_windows(s, s.where("step % 24 = 0").select("household_id", F.col("step").alias("origin")), 4, 2)


@query("fold:i household_id:i monitor_start:i", b.sql("SELECT 0 AS fold, household_id, origin AS monitor_start FROM (SELECT household_id, origin, row_number() OVER (PARTITION BY household_id ORDER BY origin DESC) AS r, CAST(ceil(count(*) OVER (PARTITION BY household_id) * 0.1e0 - 1e-9) AS BIGINT) AS k FROM (SELECT DISTINCT household_id, origin FROM sup WHERE split = 'train')) WHERE r = k", "sup"))
def monitor_boundary(spark, d):
    w = Window.partitionBy("household_id")
    o = b.supervised(spark, d).where("split = 'train'").select("household_id", "origin").distinct()
    o = o.withColumns({"r": F.row_number().over(w.orderBy(F.col("origin").desc())), "k": F.ceil(F.count("*").over(w) * F.lit(0.1) - 1e-9)})
    return o.where("r = k").select(F.lit(0).alias("fold"), "household_id", F.col("origin").alias("monitor_start"))


@query("household_id:i step:i", b.sql("SELECT household_id, step FROM valid WHERE step % 24 NOT IN (0, 6, 12, 18)", "filled", **_VALID_SQL))
def remaining_antijoin(spark, d):
    v = _valid(spark, d).select("household_id", "step")
    return v.join(v.where((F.col("step") % 24).isin(0, 6, 12, 18)), ["household_id", "step"], "left_anti")


# ---- splits, samples, encoding ----

_DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT"


@query("household_id:i role:s", f"""WITH c AS (SELECT c_custkey AS household_id, CASE WHEN c_custkey % 3 = 0 THEN 'GSHP' ELSE 'ASHP' END AS hp_type FROM customer),
      q1 AS (SELECT *, base + CAST(row_number() OVER (ORDER BY rest DESC, hp_type) <= total - sum(base) OVER () AS INT) AS quota FROM (SELECT hp_type, ceil(sum(count(*)) OVER () * 0.2e0 - 1e-9) AS total, floor(ceil(sum(count(*)) OVER () * 0.2e0 - 1e-9) * count(*) / sum(count(*)) OVER ()) AS base, ceil(sum(count(*)) OVER () * 0.2e0 - 1e-9) * count(*) / sum(count(*)) OVER () - floor(ceil(sum(count(*)) OVER () * 0.2e0 - 1e-9) * count(*) / sum(count(*)) OVER ()) AS rest FROM c GROUP BY 1)),
      t AS (SELECT c.*, row_number() OVER (PARTITION BY c.hp_type ORDER BY {_DRAW.format("'2026:' || household_id")}, household_id) <= quota AS held FROM c JOIN q1 USING (hp_type)),
      r AS (SELECT household_id, hp_type FROM t WHERE NOT held),
      q2 AS (SELECT *, base + CAST(row_number() OVER (ORDER BY rest DESC, hp_type) <= total - sum(base) OVER () AS INT) AS quota FROM (SELECT hp_type, ceil(sum(count(*)) OVER () * 0.125e0 - 1e-9) AS total, floor(ceil(sum(count(*)) OVER () * 0.125e0 - 1e-9) * count(*) / sum(count(*)) OVER ()) AS base, ceil(sum(count(*)) OVER () * 0.125e0 - 1e-9) * count(*) / sum(count(*)) OVER () - floor(ceil(sum(count(*)) OVER () * 0.125e0 - 1e-9) * count(*) / sum(count(*)) OVER ()) AS rest FROM r GROUP BY 1))
      SELECT household_id, 'unseen_test' AS role FROM t WHERE held UNION ALL
      SELECT household_id, CASE WHEN row_number() OVER (PARTITION BY r.hp_type ORDER BY {_DRAW.format("'2027:' || household_id")}, household_id) <= quota THEN 'unseen_validation' ELSE 'train' END FROM r JOIN q2 USING (hp_type)""")
def stratified_household_split(spark, d):
    c = b.table(spark, d, "customer").select(F.col("c_custkey").alias("household_id"), b.hp("c_custkey").alias("hp_type"))
    return splits.stratified_split(c)


@query("global_start:i global_end:i train_end:d calibration_end:d", b.sql("SELECT * FROM cutoffs", "cutoffs"))
def temporal_cutoffs(spark, d):
    return b.cutoffs(spark, d)


@query("household_id:i split:s origins:i", b.sql("SELECT household_id, split, count(DISTINCT origin) AS origins FROM sup GROUP BY 1, 2", "sup"))
def assign_split(spark, d):
    return b.supervised(spark, d).groupBy("household_id", "split").agg(F.count_distinct("origin").alias("origins"))


@query("fold:i train_end:d evaluation_end:d", b.sql("SELECT fold, s + (0.55e0 + fold * (0.25e0 / 3)) * (e - s) AS train_end, least(s + (0.55e0 + fold * (0.25e0 / 3)) * (e - s) + 0.1e0 * (e - s), e) AS evaluation_end FROM (SELECT min(step) AS s, max(step) AS e FROM p6), (SELECT unnest(generate_series(0, 3)) AS fold)", "p6"))
def rolling_cutoffs(spark, d):
    return splits.rolling_cutoffs(b.p6(spark, d).select(F.col("step").alias("start"), F.col("step").alias("end")), 4)


@query("household_id:i train:i calibration:i seen_test:i unseen_test:i unseen_validation:i", b.sql("SELECT household_id, " + ", ".join(f"count(*) FILTER (split = '{s}') AS {s}" for s in ("train", "calibration", "seen_test", "unseen_test", "unseen_validation")) + " FROM sup GROUP BY 1", "sup"))
def supervised_shards(spark, d):
    names = ["train", "calibration", "seen_test", "unseen_test", "unseen_validation"]
    return b.supervised(spark, d).groupBy("household_id").pivot("split", names).count().na.fill(0, names)


@query("household_id:i origin:i horizon:i", b.sql(f"SELECT household_id, origin, horizon FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY k, household_id, origin, horizon) AS r FROM (SELECT *, {_DRAW.format(chr(39) + '7:' + chr(39) + ' || household_id || ' + chr(39) + ':' + chr(39) + ' || origin || ' + chr(39) + ':' + chr(39) + ' || horizon')} AS k FROM sup WHERE split = 'train')) WHERE r <= 100 ORDER BY k, household_id, origin, horizon LIMIT 300", "sup"))
def stratified_row_sample(spark, d):
    return splits.capped_sample(b.supervised(spark, d).where("split = 'train'"), "horizon", 100, 300, 7, ["household_id", "origin", "horizon"])


@query("custkey:i nation:d segment:d acctbal:d", "SELECT c.c_custkey AS custkey, coalesce(CAST(c_nationkey AS DOUBLE), 0) AS nation, coalesce(k.code, -1) AS segment, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, (SELECT median(CASE WHEN c_acctbal > 0 THEN c_acctbal END) FROM customer WHERE c_custkey % 2 = 0 AND c_mktsegment <> 'MACHINERY')) AS acctbal FROM customer c LEFT JOIN (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_custkey % 2 = 0 AND c_mktsegment <> 'MACHINERY')) k ON k.c_mktsegment = c.c_mktsegment")
def tabular_encoder_transform(spark, d):
    c = b.table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("acctbal"))
    fitted = encode.TabularEncoder.fit(c.where("custkey % 2 = 0 AND segment <> 'MACHINERY'"), ["nation", "segment", "acctbal"])
    return fitted.transform(c, ["custkey"])


@query("name:s code:d", "SELECT * FROM (SELECT c_mktsegment AS name, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)) UNION ALL SELECT 'acctbal', median(c_acctbal) FROM customer")
def tabular_encoder_fit(spark, d):
    c = b.table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("acctbal"))
    fitted = encode.TabularEncoder.fit(c, ["segment", "acctbal"])
    return fitted.categories["segment"].toDF("name", "code").unionByName(spark.createDataFrame([("acctbal", fitted.medians["acctbal"])], "name string, code double"))


def _keyed_draw(seed: int) -> str:
    return _DRAW.format(f"'{seed}:' || household_id || ':' || origin || ':' || horizon")


_KEYS = ["household_id", "origin", "horizon"]


@query("household_id:i origin:i horizon:i", b.sql(f"SELECT household_id, origin, horizon FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY k, household_id, origin, horizon) AS r FROM (SELECT *, row_number() OVER (PARTITION BY household_id ORDER BY k, household_id, origin, horizon) AS h FROM (SELECT *, {_keyed_draw(9)} AS k FROM sup WHERE split = 'calibration')) WHERE h <= 40) WHERE r <= 80 ORDER BY k, household_id, origin, horizon LIMIT 250", "sup"))
def model_samples(spark, d):
    return splits.model_sample(b.supervised(spark, d), "calibration", 40, 80, 250, 9, _KEYS)


@query("household_id:i origin:i horizon:i hp_type:s", b.sql(f"SELECT household_id, origin, horizon, hp_type FROM (SELECT *, row_number() OVER (PARTITION BY hp_type ORDER BY k, household_id, origin, horizon) AS r FROM (SELECT *, row_number() OVER (PARTITION BY household_id ORDER BY k, household_id, origin, horizon) AS h FROM (SELECT *, {_keyed_draw(5)} AS k FROM sup WHERE split LIKE '%seen_test')) WHERE h <= 30) WHERE r <= 100", "sup"))
def shap_sample(spark, d):
    return splits.explanation_sample(b.supervised(spark, d), 30, 100, 5, _KEYS)


_NAMES = ("Timestamp", "Temperature_mean_hourly", "Temperature_avg_hourly", "Temperature_hourly", "Temperature", "Air_temperature_hourly", "Temperature_dew_hourly", "temperature_MIN_hourly", "Temperature_max_hourly", "Soil_Temperature_Hourly")
_SET = ", ".join(f"CASE WHEN (p >> {i}) & 1 = 1 THEN '{n}' END" for i, n in enumerate(_NAMES))


@query("p:i chosen:s", f"""SELECT p, coalesce(
      CASE WHEN (p >> 1) & 1 = 1 THEN 'Temperature_mean_hourly' WHEN (p >> 2) & 1 = 1 THEN 'Temperature_avg_hourly' WHEN (p >> 3) & 1 = 1 THEN 'Temperature_hourly' END,
      list_filter(c, lambda x: contains(lower(x), 'temperature') AND contains(lower(x), 'hourly') AND NOT regexp_matches(lower(x), 'dew|min|max'))[1]) AS chosen
      FROM (SELECT p, list_filter(CASE WHEN p % 2 = 0 THEN [{_SET}] ELSE list_reverse([{_SET}]) END, lambda x: x IS NOT NULL) AS c FROM (SELECT DISTINCT p_partkey % 1024 AS p FROM part))""")
def infer_temperature(spark, d):
    """The column chosen among the names that a part's key selects, in both orders."""
    sets = [r.p for r in b.table(spark, d, "part").select((F.col("p_partkey") % 1024).alias("p")).distinct().collect()]
    names = lambda p: [n for i, n in enumerate(_NAMES) if p >> i & 1][:: -1 if p % 2 else 1]
    return spark.createDataFrame([(p, features.temperature_column(names(p))) for p in sets], "p long, chosen string")


@query("custkey:i acctbal:d", "SELECT c_custkey AS custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, (SELECT median(CASE WHEN c_acctbal > 0 THEN c_acctbal END) FROM customer WHERE c_custkey % 2 = 0)) AS acctbal FROM customer WHERE c_custkey % 2 = 1")
def tft_harmonize(spark, d):
    c = b.table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("acctbal"), F.lit(None).cast("double").alias("never"))
    return encode.harmonise(c.where("custkey % 2 = 0"), c.where("custkey % 2 = 1"), features=["acctbal", "never"])[1]


_MEMBERS = f"""SELECT cohort || '_' || portfolio_type || '_' || portfolio_size || '_' || lpad(CAST(repetition AS VARCHAR), 3, '0') AS portfolio_id, cohort, portfolio_type, portfolio_size, repetition, household_id FROM (SELECT *, count(*) OVER (PARTITION BY cohort, portfolio_type, portfolio_size, repetition) AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY cohort, portfolio_type, portfolio_size, repetition, hp_type ORDER BY {_DRAW.format("'2026:' || cohort || ':' || portfolio_type || ':' || portfolio_size || ':' || repetition || ':' || household_id")}, household_id) AS r FROM
        (SELECT household_id, hp_type, CASE role WHEN 'train' THEN 'seen' ELSE 'unseen' END AS cohort, count(*) OVER (PARTITION BY CASE role WHEN 'train' THEN 'seen' ELSE 'unseen' END, hp_type) AS have FROM roles WHERE role IN ('train', 'unseen_test'))
        JOIN (SELECT portfolio_type, size AS portfolio_size, rep AS repetition, hp_type, CASE WHEN portfolio_type <> 'mixed' THEN size WHEN hp_type = 'ASHP' THEN CAST(ceil(size / 2.0) AS INT) ELSE size // 2 END AS quota
              FROM (SELECT unnest(['ASHP', 'GSHP', 'mixed']) AS portfolio_type), (SELECT unnest([2, 3]) AS size), (SELECT unnest(generate_series(0, 1)) AS rep), (SELECT unnest(['ASHP', 'GSHP']) AS hp_type) WHERE portfolio_type = 'mixed' OR portfolio_type = hp_type) USING (hp_type)
      WHERE have >= quota) WHERE r <= quota) WHERE n = portfolio_size"""


def members(spark, d):
    pool = b.roles(spark, d).where("role IN ('train', 'unseen_test')").withColumn("cohort", F.when(F.col("role") == "train", "seen").otherwise("unseen")).drop("role")
    return splits.sample_portfolios(pool, [2, 3], 2)


@query("portfolio_id:s cohort:s portfolio_type:s portfolio_size:i household_id:i", b.sql("SELECT * FROM members", "roles", members=_MEMBERS))
def portfolio_sampling(spark, d):
    return members(spark, d)


# ---- quality ----


_REASONS = "CASE WHEN rows = 0 THEN 'missing_meter_file' ELSE concat_ws('|', CASE WHEN hp_type IS NULL THEN 'unknown_hp_type' END, CASE WHEN observed = 0 THEN 'no_separate_hp_meter' END, CASE WHEN days < 25 THEN 'insufficient_days' END, CASE WHEN missing > 0.3 THEN 'target_missingness' END, CASE WHEN seasons < 1 THEN 'insufficient_heating_seasons' END, CASE WHEN matched < 0.4 THEN 'weather_match' END) END"
_KNOWN = "CASE WHEN r.household_id % 5 <> 4 THEN r.hp_type END"
_SEEN = "SELECT household_id, step, CASE WHEN household_id % 7 <> 5 THEN cents END AS cents FROM r1"
_SEASONS = f"SELECT household_id, count(*) FILTER (days >= 20) AS seasons FROM (SELECT household_id, year(l) + CAST(month(l) >= 10 AS INT) AS season, count(DISTINCT CAST(l AS DATE)) AS days FROM (SELECT household_id, {_LOCAL.replace('ts', 'make_timestamp(step * 3600000000)')} AS l FROM seen WHERE cents IS NOT NULL AND household_id % 4 <> 1) WHERE month(l) IN (10, 11, 12, 1, 2, 3, 4) GROUP BY 1, 2) GROUP BY 1"
_AUDIT = dict(seen=_SEEN, season=_SEASONS, audit=f"""SELECT household_id, hp_type, rows, observed, expected, days AS usable_days, missing AS missing_fraction, matched AS weather_match_fraction, seasons AS valid_seasons, {_REASONS} AS exclusion_reason FROM (
      SELECT r.household_id, {_KNOWN} AS hp_type, coalesce(n, 0) AS rows, coalesce(o, 0) AS observed, coalesce(z - a + 1, 0) AS expected, coalesce(o, 0) / 24.0::DOUBLE AS days, CASE WHEN coalesce(z - a + 1, 0) > 0 THEN 1 - CAST(coalesce(o, 0) AS DOUBLE) / (z - a + 1) ELSE 1 END AS missing, coalesce(m, 0) AS matched, coalesce(seasons, 0) AS seasons
      FROM roles r LEFT JOIN (SELECT q.household_id, count(*) AS n, count(cents) AS o, min(q.step) AS a, max(q.step) AS z, avg(CASE WHEN cents IS NULL THEN NULL WHEN hw.step IS NULL THEN 0.0 ELSE 1.0 END) AS m FROM seen q LEFT JOIN hw ON hw.household_id = q.household_id AND hw.step = q.step GROUP BY 1) USING (household_id) LEFT JOIN season USING (household_id))""")


def audited(spark, d):
    """An audit in which all reasons occur: some households have no known type, no separate meter, or no readings in the heating months."""
    r = b.readings(spark, d, 1).withColumn("y", F.when(F.col("household_id") % 7 != 5, F.col("cents") / 100.0))
    clock = r.where("household_id % 4 <> 1").withColumn("ts", F.timestamp_micros(F.col("step") * b.HOUR).cast("timestamp_ntz"))
    seasons = quality.heating_seasons(clock, "ts", [10, 11, 12, 1, 2, 3, 4], 20)
    houses = b.roles(spark, d).select("household_id", F.when(F.col("household_id") % 5 != 4, F.col("hp_type")).alias("hp_type"))
    return quality.audit(r, houses, b.household_weather(spark, d), 24, {"days": 25, "missing": 0.3, "weather": 0.4, "seasons": 1}, seasons)


@query("household_id:i hp_type:s rows:i observed:i expected:i usable_days:d missing_fraction:d weather_match_fraction:d valid_seasons:i exclusion_reason:s eligible:b", b.sql("SELECT *, exclusion_reason = '' AS eligible FROM audit", "roles", "r1", "hw", **_AUDIT))
def audit_household(spark, d):
    return audited(spark, d)


@query("hp_type:s eligible:b households:i median_usable_days:d median_missing_fraction:d", b.sql("SELECT hp_type, exclusion_reason = '' AS eligible, count(DISTINCT household_id) AS households, median(usable_days) AS median_usable_days, median(missing_fraction) AS median_missing_fraction FROM audit GROUP BY 1, 2", "roles", "r1", "hw", **_AUDIT))
def audit_summary(spark, d):
    return quality.audit_summary(audited(spark, d))


@query("reason:s households:i", b.sql("SELECT reason, count(*) AS households FROM (SELECT unnest(string_split(exclusion_reason, '|')) AS reason FROM audit WHERE exclusion_reason <> '') GROUP BY 1", "roles", "r1", "hw", **_AUDIT))
def exclusion_counts(spark, d):
    return quality.exclusion_counts(audited(spark, d))


@query("household_id:i valid_seasons:i", b.sql(f"SELECT household_id, count(*) FILTER (days >= 20) AS valid_seasons FROM (SELECT household_id, year(l) + CAST(month(l) >= 10 AS INT) AS season, count(DISTINCT CAST(l AS DATE)) AS days FROM (SELECT household_id, {_LOCAL} AS l FROM ev) WHERE month(l) IN (10, 11, 12, 1, 2, 3, 4) GROUP BY 1, 2) GROUP BY 1", "ev"))
def heating_seasons(spark, d):
    e = b.events(spark, d).withColumn("y", F.col("cents") / 100.0)
    return quality.heating_seasons(e, "ts", [10, 11, 12, 1, 2, 3, 4], 20)


_CHECKS = "targets_follow_horizons:b paths_complete:b rows_unique:b times_inside_split:b households_inside_split:b"


@query(f"household_id:i split:s {_CHECKS}", b.sql("SELECT household_id, split, count(*) FILTER (target - origin <> horizon) = 0 AS targets_follow_horizons, count(*) = count(DISTINCT origin) * 4 AS paths_complete, count(*) = count(DISTINCT (origin, horizon)) AS rows_unique, CASE split WHEN 'train' THEN max(target) <= max(train_end) WHEN 'calibration' THEN min(origin) > max(train_end) AND max(target) <= max(calibration_end) WHEN 'seen_test' THEN min(origin) > max(calibration_end) ELSE true END AS times_inside_split, bool_and(CASE WHEN split LIKE 'unseen%' THEN role = split ELSE role = 'train' END) AS households_inside_split FROM sup JOIN (SELECT household_id, role FROM roles) USING (household_id), cutoffs GROUP BY 1, 2", "sup", "roles", "cutoffs"))
def leakage_audit(spark, d):
    ends = b.cutoffs(spark, d).first()
    return quality.protocol_checks(b.supervised(spark, d), b.roles(spark, d).drop("hp_type"), F.lit(ends.train_end), F.lit(ends.calibration_end), 4)


@query("left_only:i shared:i", "SELECT count(*) FILTER (NOT i) AS left_only, count(*) FILTER (i) AS shared FROM (SELECT k, k IN (SELECT user_id FROM events) AS i FROM (SELECT DISTINCT c_custkey AS k FROM customer))")
def set_partition(spark, d):
    ids = b.table(spark, d, "customer").select(F.col("c_custkey").alias("k")).distinct()
    users = b.table(spark, d, "events").select(F.col("user_id").alias("k")).distinct()
    return ids.join(users, "k", "left_anti").agg(F.count("*").alias("left_only")).crossJoin(ids.intersect(users).agg(F.count("*").alias("shared")))


@query("k:i", "SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier")
def union_distinct(spark, d):
    return b.table(spark, d, "customer").select(F.col("c_custkey").alias("k")).union(b.table(spark, d, "supplier").select("s_suppkey")).distinct()


@query("kind:s key:i name:s size:i", "SELECT 'part' AS kind, p_partkey AS key, p_name AS name, p_size AS size FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier")
def ragged_union(spark, d):
    p = b.table(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return p.unionByName(b.table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")), allowMissingColumns=True)


@query("user_id:i event_id:i cents:i", "SELECT user_id, event_id, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 3")
def tail_per_group(spark, d):
    return features.last_rows(b.events(spark, d), ["user_id"], "event_id", 3)


@query("household_id:i mase_scale:d mase_scale_n:i mase_scale_source:s", b.sql("SELECT * FROM scales", "scales"))
def mase_scale(spark, d):
    return b.scales(spark, d)


@query("household_id:i origin:i step:i temperature:d", b.sql("SELECT p.household_id, p.step AS origin, w.step, w.temperature FROM p6 p ASOF JOIN (SELECT household_id, step // 6 AS step, temperature FROM (SELECT *, row_number() OVER (PARTITION BY household_id, step // 6 ORDER BY step DESC) AS r FROM hw) WHERE r = 1) w ON w.household_id = p.household_id AND w.step <= p.step", "p6", "hw"))
def asof_backward(spark, d):
    """As-of join without a range join: both time axes united, the last right row carried forward within the series."""
    right = grid.dedup_last(b.household_weather(spark, d).withColumn("s6", F.floor(F.col("step") / 6)), ["household_id", "s6"], "step").select("household_id", F.col("s6").alias("step"), F.struct(F.col("s6").alias("step"), "temperature").alias("r"))
    left = b.p6(spark, d).select("household_id", "step", F.lit(True).alias("asked"))
    joined = left.join(right, ["household_id", "step"], "full")
    carried = joined.withColumn("r", F.last("r", ignorenulls=True).over(grid.by_time().rowsBetween(Window.unboundedPreceding, 0)))
    return carried.where("asked AND r IS NOT NULL").select("household_id", F.col("step").alias("origin"), "r.step", "r.temperature")
