"""From raw folders to reports, and streamed readings."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidepanel.plans.config import ConfigError
from tidepanel.plans.run import Run
from tidepanel.sources import files
from tidepanel.streaming.readings import bucketed


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")

    def write(path, lines):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text("\n".join(lines) + "\n")

    ids = range(1, 9)
    write("meta_data/households.csv", ["Household_ID;Weather_ID;Group", *(f"{i};w1;g" for i in ids)])
    write("meta_data/meta_data.csv", ["Household_ID;Survey_HeatPump_Installation_Type;Survey_Building_LivingArea", *(f"{i};{'air-source' if i % 2 else 'ground-source'};150.0" for i in ids)])
    write("smart_meter_data/overview/smart_meter_data_15min_overview.csv", ["Household_ID", *map(str, ids)])
    write("reports/protocols.csv", ["Report_ID;Household_ID;Visit_Date", "r1;1;", "r2;2;2020-01-01"])
    start = datetime(2021, 1, 1)
    for i in ids:
        rows = [f"{start + timedelta(minutes=15 * k)};{i};{'' if k == 17 else round(1 + 0.5 * math.sin(2 * math.pi * k / 96) + 0.1 * ((k * 7 + i) % 5), 3)};2.0" for k in range(900)]
        write(f"smart_meter_data/15min/{i}.csv", ["Timestamp;Household_ID;kWh_received_HeatPump;kWh_received_Total", *rows, rows[5], "bad;1;1;1"])
    write("weather_data/hourly/w1.csv", ["Timestamp;Weather_ID;Temperature_mean_hourly", *(f"{start + timedelta(hours=k)};w1;{5 + math.sin(k / 4):.3f}" for k in range(225))])
    return str(root)


SMALL = {
    "inclusion": {"min_days": 1, "max_target_missing_fraction": 0.5, "min_season_days": 5, "min_weather_match_fraction": 0.5}, "models": {"boosted_trees": {"iterations": 2, "depth": 2}}, "statistics": {"bootstrap_repetitions": 20},
    "features": {"lag_steps": [1, 4], "rolling_steps": [4], "history_steps": 96, "forecast_steps": 8}, "split": {"unseen_household_fraction": 0.25, "validation_household_fraction": 0.125, "rolling_folds": 2},
    "sampling": {"max_eval_origins_per_household": 12, "max_train_rows": 600}, "evaluation": {"report_horizons": [1, 4], "conformal_min_samples": 3, "mase_min_differences": 8},
    "portfolio": {"sizes": [2], "repetitions": 2, "shift_hours": [1], "flexible_fractions": [0.1], "peak_threshold_quantiles": [0.9, 0.95], "min_calibration_samples": 3},
}


def test_adapter_reads_the_raw_folder(spark, raw):
    a = files.Adapter(spark, raw)
    assert a.metadata().count() == 8 and a.meters().count() == 8 * 900 and a.weather_by_household().count() == 8 * 225
    assert a.protocols().where("Visit_Date IS NULL").count() == 1
    assert {r.t for r in a.metadata().select(files.hp_type().alias("t")).collect()} == {"ASHP", "GSHP"}
    assert files.fingerprints(spark, raw).count() == 13
    with pytest.raises(files.SourceError):
        files.Adapter(spark, raw + "/meta_data")


def test_full_run_and_its_folder(spark, raw, tmp_path):
    run = Run(spark, raw, str(tmp_path / "out"), SMALL)
    assert run.audit().where("eligible").count() == 8
    run.full()
    assert run.supervised().groupBy("household_id", "origin").count().where("count <> 8").count() == 0
    assert {r.model for r in run.evaluated().select("model").distinct().collect()} == {"persistence", "daily", "weekly", "elastic_net", "boosted_trees"}
    assert run.validation().where("violations = 0 AND rows > 0").count() == 9
    assert {r.train_types for r in run.transfer().collect()} == {"ASHP", "GSHP", "combined"} and {r.fold for r in run.rolling().collect()} <= {1, 2}
    assert run.importance().count() > 0 and run.table("metrics_raw", None).count() == run.evaluated().count()
    assert {r.peak_threshold_quantile for r in run.table("peak_summary", None).collect()} == {0.9, 0.95}
    assert run.suite().count() > 0 and run.finalize().count() > 0
    assert run.table("peak_summary", None).count() > 0
    with pytest.raises(ConfigError):
        Run(spark, raw, str(tmp_path / "out"), SMALL | {"project": {"seed": 1}})


def test_streamed_buckets_equal_the_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.floor(F.col("value") * 100).alias("value"))
    e.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = bucketed(stream, "6 hours", "1 hour", "user_id", event="event_id").writeStream.format("memory").queryName("buckets").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("buckets").collect()}
    want = {tuple(r) for r in bucketed(e, "6 hours", "1 hour", "user_id").collect()}
    assert got <= want and len(got) > 0.5 * len(want)
    last = max(t for r in want for t in r if isinstance(t, datetime))
    closed = {r for r in want if all(t < last - timedelta(hours=12) for t in r if isinstance(t, datetime))}
    assert closed and closed <= got  # all but what the watermark still holds open



def test_defaults_exclude_a_short_history(spark, raw, tmp_path):
    audit = Run(spark, raw, str(tmp_path / "out")).audit().collect()
    assert len(audit) == 8 and all(not r.eligible and r.exclusion_reason == "insufficient_days|insufficient_heating_seasons" for r in audit)
    assert {r.household_id for r in audit if r.protocol_available} == {2} and not any(r.multiple_visits for r in audit)


def test_holidays_of_the_canton(spark):
    from tidepanel.operators import features

    days = {str(r.holiday) for r in features.canton_holidays(spark).collect()}
    easter_mondays = {"2000-04-24", "2008-03-24", "2019-04-22", "2020-04-13", "2021-04-05", "2022-04-18", "2023-04-10", "2024-04-01", "2025-04-21", "2038-04-26", "2049-04-19", "2076-04-20"}
    assert easter_mondays <= days and {"2021-01-02", "2021-04-02", "2021-05-13", "2021-05-24", "2021-08-01", "2021-12-26"} <= days
    assert "2021-01-06" not in days and len(days) == len({d for d in days}) and 1090 < len(days) <= 1110
    rows = features.calendar(spark.sql("SELECT TIMESTAMP_NTZ'2021-04-04 22:30:00' AS ts UNION ALL SELECT TIMESTAMP_NTZ'2021-04-05 22:30:00'"), "ts", holidays=features.canton_holidays(spark))
    assert {(str(r.ts)[:10], r.cal_public_holiday) for r in rows.collect()} == {("2021-04-04", 1), ("2021-04-05", 0)}


def test_models_are_kept_and_read_back(spark, tmp_path):
    from tidepanel.operators import models

    rows = spark.range(200).selectExpr("id AS household_id", "'ASHP' AS hp_type", "id AS origin", "id + 1 AS target", "CAST(1 + id % 2 AS INT) AS horizon", "'train' AS split", "id % 7 + 0.5 AS y_true", "CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 3 AS DOUBLE) AS b").selectExpr("*").withColumn("y_true", F.col("y_true").cast("double"))
    for kind, fitted in ((models.ElasticNet, models.ElasticNet(["a", "b"]).fit(rows)), (models.BoostedQuantiles, models.BoostedQuantiles(["a", "b"], 2, 2).fit(rows, rows))):
        fitted.save(str(tmp_path / kind.__name__))
        again = kind.load(str(tmp_path / kind.__name__))
        assert again.features == ["a", "b"] and sorted(again.predict(rows).collect()) == sorted(fitted.predict(rows).collect())
