"""Causal features of a regular panel: everything at a row is known at that row's time."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidepanel.operators.grid import by_time

NON_FEATURES = ("household_id", "hp_type", "segment_id", "split", "origin", "target", "y_true")


def load_features(panel: DataFrame, lags=(1, 4, 96, 672), windows=(4, 96), day: int = 96, on: float = 0.05, value: str = "y") -> DataFrame:
    """Adds lags, rolling means and deviations, ramps, and the last day's range, base load and switching.

    ``load_lag_k`` is the value k - 1 rows back, so lag 1 is the value at the row itself. Rolling values need
    a full window without gaps; a missing load counts as off, and the first row as a transition.
    """
    w, y = by_time(), F.col(value)
    back = lambda k: w.rowsBetween(1 - k, 0)
    full = lambda c, k: F.when(F.count(value).over(back(k)) == k, c)
    out = {f"load_lag_{k}": F.lag(value, max(k - 1, 0)).over(w) if k > 1 else y for k in lags}
    for k in windows:
        out[f"load_roll_mean_{k}"] = full(F.avg(value).over(back(k)), k)
        out[f"load_roll_std_{k}"] = full(F.stddev_pop(value).over(back(k)), k)
    out |= {"load_ramp_1": y - F.lag(value, 1).over(w), "load_ramp_4": y - F.lag(value, 4).over(w)}
    out |= {"load_day_min": full(F.min(value).over(back(day)), day), "load_day_max": full(F.max(value).over(back(day)), day), "load_day_base": full(F.percentile(value, F.lit(0.1)).over(back(day)), day)}
    state = panel.withColumn("_on", F.coalesce(y > on, F.lit(False)))
    state = state.withColumn("_turn", F.coalesce(F.col("_on") != F.lag("_on").over(w), F.lit(True)))
    whole = F.count("*").over(back(day)) == day
    out["load_on_fraction"] = F.when(whole, F.avg(F.col("_on").cast("double")).over(back(day)))
    out["load_transition_count"] = F.when(whole, F.sum(F.col("_turn").cast("long")).over(back(day)))
    return state.withColumns(out).drop("_on", "_turn")


def calendar(df: DataFrame, ts: str, zone: str = "Europe/Zurich", holidays: DataFrame | None = None) -> DataFrame:
    """Adds ``cal_*`` of the local time of the UTC timestamp (without zone) ``ts``; ``holidays`` has ``holiday``, a date."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts))
    minute, weekday, doy = F.hour(local) * 60 + F.minute(local), F.weekday(local), F.dayofyear(local)
    turn = lambda c, n: 2 * pi * c / n
    out = {f"cal_{k}_{f}": g(turn(c, n)) for k, c, n in (("hour", minute, 1440), ("dow", weekday, 7), ("doy", doy, 365.25)) for f, g in (("sin", F.sin), ("cos", F.cos))}
    out |= {"cal_weekend": (weekday >= 5).cast("int"), "cal_month": F.month(local), "cal_year": F.year(local)}
    df = df.withColumns(out)
    if holidays is None:
        return df.withColumn("cal_public_holiday", F.lit(0))
    days = F.broadcast(holidays.select(F.col("holiday").alias("_h")).distinct())
    return df.join(days, F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts))) == F.col("_h"), "left").withColumn("cal_public_holiday", F.col("_h").isNotNull().cast("int")).drop("_h")


def canton_holidays(spark, first: int = 1990, last: int = 2100) -> DataFrame:
    """(``holiday``): the public holidays of the canton of Zurich; those that move follow Easter (Gauss's rule of the epact)."""
    y = spark.range(first, last + 1).select(F.col("id").cast("int").alias("y"))
    y = y.selectExpr("y", "y % 19 AS g", "y DIV 100 AS c").selectExpr("y", "g", "c", "(c - c DIV 4 - (8 * c + 13) DIV 25 + 19 * g + 15) % 30 AS h")
    y = y.selectExpr("y", "c", "h - (h DIV 28) * (1 - (29 DIV (h + 1)) * ((21 - g) DIV 11)) AS i").selectExpr("y", "i - (y + y DIV 4 + i + 2 - c + c DIV 4) % 7 AS l")
    easter = "date_add(make_date(y, 3, 28), CAST(l AS INT))"
    moving = [f"date_add({easter}, {n})" for n in (-2, 1, 39, 50)]  # Good Friday, Easter Monday, Ascension, Whit Monday
    fixed = [f"make_date(y, {m}, {d})" for m, d in ((1, 1), (1, 2), (5, 1), (8, 1), (12, 25), (12, 26))]
    return y.selectExpr(f"explode(array({', '.join(moving + fixed)})) AS holiday")


def temperature_column(names: list[str]) -> str | None:
    """The column that holds air temperature: known names first, else the first that says hourly temperature and no dew point or extreme."""
    for name in ("Temperature_mean_hourly", "Temperature_avg_hourly", "Temperature_hourly"):  # fixed values
        if name in names:
            return name
    for name in names:
        low = name.lower()
        if "temperature" in low and "hourly" in low and not any(x in low for x in ("dew", "min", "max")):
            return name
    return None


def feature_columns(df: DataFrame, deny=NON_FEATURES) -> list[str]:
    return [c for c in df.columns if c not in deny]


def with_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


def without_overlap(meter: DataFrame, weather: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """``meter`` without the columns that the weather has too, and the weather's columns: the numeric ones that are no key, date or station."""
    names = [f.name for f in weather.schema.fields if isinstance(f.dataType, NumericType) and f.name not in (*keys, "Date", "Weather_ID")]
    return meter.drop(*(c for c in names if c in meter.columns)), names


def scenario_value(scenario: str, realised: str, proxy: str) -> Column:
    """The realised value for the 'oracle' scenario, the lagged proxy for 'operational'."""
    return F.col(realised if scenario == "oracle" else proxy)


def with_fallback(value: str, fallback: str) -> Column:
    return F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(None)), F.col(fallback))


def last_rows(df: DataFrame, group: list[str], order: str, n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.col(order).desc())
    return df.withColumn("_r", F.row_number().over(w)).where(f"_r <= {n}").drop("_r")
