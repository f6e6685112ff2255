"""Data-quality audit and fail-closed protocol checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.columns import finite
from tidepanel.operators.grid import ID, STEP


def audit(readings: DataFrame, households: DataFrame, weather: DataFrame, steps_per_day: int, limits: dict, season: DataFrame | None = None) -> DataFrame:
    """One row per household: counts, span, missing and weather-matched shares, and all reasons for exclusion.

    ``readings`` has the target ``y`` (maybe null), ``weather`` the steps that have weather, ``season`` the
    household's ``valid_seasons``. A household without readings has no other reason; one whose target is never there has
    no separate meter. The matched share is that of the observed readings.
    """
    y = finite(F.col("y"))
    matched = readings.join(weather.select(ID, STEP).distinct().withColumn("_m", F.lit(1)), [ID, STEP], "left")
    seen = matched.groupBy(ID).agg(F.count("*").alias("rows"), F.count(y).alias("observed"), F.min(STEP).alias("first_step"), F.max(STEP).alias("last_step"), F.avg(F.when(y.isNotNull(), F.coalesce("_m", F.lit(0)).cast("double"))).alias("weather_match_fraction"))
    rows = households.join(seen, ID, "left")
    if season is not None:
        rows = rows.join(season, ID, "left")
    expected = F.coalesce(F.col("last_step") - F.col("first_step") + 1, F.lit(0))
    rows = rows.withColumns({
        "rows": F.coalesce("rows", F.lit(0)), "observed": F.coalesce("observed", F.lit(0)), "expected": expected, "usable_days": F.coalesce("observed", F.lit(0)) / steps_per_day,
        "missing_fraction": F.when(expected > 0, 1 - F.col("observed") / expected).otherwise(1.0), "weather_match_fraction": F.coalesce("weather_match_fraction", F.lit(0.0)),
    })
    checks = {"unknown_hp_type": F.col("hp_type").isNull(), "no_separate_hp_meter": F.col("observed") == 0, "insufficient_days": F.col("usable_days") < limits["days"], "target_missingness": F.col("missing_fraction") > limits["missing"]}
    if season is not None:
        rows = rows.withColumn("valid_seasons", F.coalesce("valid_seasons", F.lit(0)))
        checks["insufficient_heating_seasons"] = F.col("valid_seasons") < limits["seasons"]
    checks["weather_match"] = F.col("weather_match_fraction") < limits["weather"]
    reasons = F.array_join(F.array_compact(F.array(*(F.when(c, n) for n, c in checks.items()))), "|")
    reasons = F.when(F.col("rows") == 0, "missing_meter_file").otherwise(reasons)
    return rows.withColumn("exclusion_reason", reasons).withColumn("eligible", F.col("exclusion_reason") == "")


def heating_seasons(readings: DataFrame, ts: str, months: list[int], least: int = 120, zone: str = "Europe/Zurich") -> DataFrame:
    """(household, ``valid_seasons``): seasons (the year from October) with ``least`` distinct local days of valid readings in ``months``."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts))
    rows = readings.where(finite(F.col("y")).isNotNull()).select(ID, local.alias("_l")).where(F.month("_l").isin(months))
    days = rows.groupBy(ID, (F.year("_l") + (F.month("_l") >= 10).cast("int")).alias("season")).agg(F.count_distinct(F.to_date("_l")).alias("days"))
    return days.groupBy(ID).agg(F.count_if(F.col("days") >= least).alias("valid_seasons"))


def audit_summary(audited: DataFrame) -> DataFrame:
    return audited.groupBy("hp_type", "eligible").agg(F.count_distinct(ID).alias("households"), F.median("usable_days").alias("median_usable_days"), F.median("missing_fraction").alias("median_missing_fraction"))


def exclusion_counts(audited: DataFrame) -> DataFrame:
    """How many households each reason excludes, most first."""
    reasons = audited.where("exclusion_reason <> ''").select(F.explode(F.split("exclusion_reason", r"[\|]")).alias("reason"))
    return reasons.groupBy("reason").agg(F.count("*").alias("households")).orderBy(F.col("households").desc(), "reason")


def protocol_checks(rows: DataFrame, roles: DataFrame, train_end: Column | float, calibration_end: Column | float, horizons: int) -> DataFrame:
    """(``household_id``, ``split``, checks): each a boolean that must be true; see :func:`violations`.

    ``rows`` are supervised rows with ``split``, ``roles`` names each household's role.
    """
    role = F.col("role")
    joined = rows.join(roles, ID, "left")
    late = F.max("target")
    return joined.groupBy(ID, "split").agg(
        (F.count_if(F.col("target") - F.col("origin") != F.col("horizon")) == 0).alias("targets_follow_horizons"),
        (F.count("*") == F.count_distinct("origin") * horizons).alias("paths_complete"),
        (F.count("*") == F.count_distinct("origin", "horizon")).alias("rows_unique"),
        F.when(F.col("split") == "train", late <= train_end).when(F.col("split") == "calibration", (F.min("origin") > train_end) & (late <= calibration_end)).when(F.col("split") == "seen_test", F.min("origin") > calibration_end).otherwise(F.lit(True)).alias("times_inside_split"),
        F.every(F.when(F.col("split").isin("unseen_test", "unseen_validation"), role == F.col("split")).otherwise(role == "train")).alias("households_inside_split"),
    )


class ProtocolError(ValueError):
    """A protocol check failed."""


def outside(rows: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose ``keys`` are not among ``allowed``; null keys never are."""
    return rows.join(allowed.select(*keys).distinct(), keys, "left_anti").select(rows.columns)


def violations(checks: DataFrame) -> DataFrame:
    flags = [f.name for f in checks.schema if f.dataType.simpleString() == "boolean"]
    return checks.where(" OR ".join(f"NOT coalesce({f}, false)" for f in flags))


def require(checks: DataFrame) -> DataFrame:
    """``checks``; raises on the first violation."""
    bad = violations(checks).first()
    if bad:
        raise ProtocolError(str(bad.asDict()))
    return checks
