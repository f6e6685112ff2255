"""Hand-worked values and causality of the library's operators."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import columns as c
from tidepanel.operators import conformal, encode, features, grid, inference, metrics, origins, portfolio, quality, splits
from tidepanel.plans import panels
from tidepanel.plans.config import ConfigError, checked, merged, signature


def panel(spark, n=900, change=None):
    rows = [(1, "ASHP", i, 1 + 0.5 * math.sin(2 * math.pi * i / 96) if change is None or i <= change else 99.0, 0, 0) for i in range(n)]
    return spark.createDataFrame(rows, "household_id long, hp_type string, step long, y double, segment_id int, originally_missing int")


def test_crps_of_unit_losses(spark):
    assert abs(spark.range(1).select(c.crps(*[F.lit(1.0)] * 3)).first()[0] - 1.6) < 1e-12


@pytest.mark.parametrize("n,rank", [(10, 10), (100, 82), (4, 4), (1, 1)])
def test_finite_sample_rank(spark, n, rank):
    assert spark.range(1).select(c.upper_rank(F.lit(n), 0.8)).first()[0] == rank


def test_mase_uses_row_scales(spark):
    rows = spark.createDataFrame([(2.0, 1.0, 1.0), (2.0, 1.0, 2.0), (2.0, 1.0, 0.0)], "y_true double, y_pred double, mase_scale double").withColumns({q: F.lit(1.0) for q in ("q10", "q50", "q90")})
    assert metrics.forecast_metrics(rows.withColumn("model", F.lit("m")), ["model"]).first().mase == 0.75


def test_seasonal_scale_stays_within_segments(spark):
    rows = [(1, i, float(i), 0 if i < 100 else 1) for i in range(200)]
    p = spark.createDataFrame(rows, "household_id long, step long, y double, segment_id int")
    homes = spark.createDataFrame([(1, "ASHP", "train"), (2, "ASHP", "unseen_test")], "household_id long, hp_type string, role string")
    got = {r.household_id: r for r in metrics.seasonal_scales(p, homes, 1000, 96, 8).collect()}
    assert (got[1].mase_scale, got[1].mase_scale_n) == (96.0, 8)
    assert (got[2].mase_scale, got[2].mase_scale_source) == (96.0, "training_type_fallback")


def test_holm_steps_down(spark):
    rows = spark.createDataFrame([(0.01, -1.0), (0.03, 1.0), (0.20, 0.0), (None, 0.0)], "bootstrap_p_value_two_sided double, mae_delta double").withColumns({"candidate": F.lit("a"), "comparator": F.lit("b")})
    got = [r.holm_p_value for r in inference.holm(rows).orderBy(F.col("bootstrap_p_value_two_sided").asc_nulls_last()).collect()]
    assert np.allclose(got[:3], [0.03, 0.06, 0.20]) and got[3] is None


def test_encoder_imputes_from_training(spark):
    train = spark.createDataFrame([(990.0, "A"), (1010.0, "B")], "pressure double, type string")
    enc = encode.TabularEncoder.fit(train, ["pressure", "type"])
    test = spark.createDataFrame([("A",), ("new",), (None,)], "type string").withColumn("k", F.monotonically_increasing_id())
    assert sorted((r.pressure, r.type) for r in enc.transform(test, ["k"]).collect()) == [(1000.0, -1.0), (1000.0, -1.0), (1000.0, 0.0)]


def test_role_goes_before_time(spark):
    rows = spark.createDataFrame([(1, 5, "train"), (2, 5, "unseen_test"), (3, 15, "train"), (4, 25, "train"), (5, 5, "unseen_validation")], "h long, o long, role string")
    label = splits.split_label(F.col("o"), F.lit(10), F.lit(20), F.col("role"))
    assert [r[0] for r in rows.orderBy("h").select(label).collect()] == ["train", "unseen_test", "calibration", "seen_test", "unseen_validation"]


def test_stratified_split_sizes(spark):
    homes = spark.createDataFrame([(i, "GSHP" if i < 18 else "ASHP") for i in range(63)], "household_id long, hp_type string")
    got = {(r.role, r.hp_type): r["count"] for r in splits.stratified_split(homes).groupBy("role", "hp_type").count().collect()}
    assert (got["unseen_test", "ASHP"], got["unseen_test", "GSHP"], got["unseen_validation", "ASHP"], got["unseen_validation", "GSHP"]) == (9, 4, 5, 2)


def test_load_shifting_by_hand():
    done, moved, count, rejected = portfolio.shift(np.array([5.0, 1, 1, 1]), np.array([6.0, 1, 2, 3]), 4, 0.2, 3)
    assert np.allclose(done, [3.8, 2.2, 1, 1]) and abs(moved - 1.2) < 1e-12 and (count, rejected) == (1, 0)
    done, moved, *_ = portfolio.shift(np.array([1.0, 5]), np.array([6.0, 1]), 4, 0.2, 1)
    assert np.allclose(done, [0, 6]) and abs(moved - 1.0) < 1e-12
    assert portfolio.shift(np.array([5.0]), np.array([5.0]), 4, 0.2, 3)[2:] == (0, 0)


def test_shifting_conserves_energy():
    r = np.random.default_rng(0)
    for _ in range(300):
        y, s = r.random(20) * 5, r.random(20) * 5
        done, *_ = portfolio.shift(y, s, 3.0, 0.3, 6)
        assert abs(done.sum() - y.sum()) < 1e-9 and done.min() >= -1e-12
        ideal, *_ = portfolio.shift(y, y, 3.0, 0.3, 6)
        assert ideal.max() <= y.max() + 1e-9


def test_conformal_widens_by_the_score(spark):
    rows = spark.createDataFrame([("m", "ASHP", h, "normal", 1.3, 1.0, 1.0) for h in (1, 2) for _ in range(4)], "model string, hp_type string, horizon int, temperature_regime string, y_true double, q10 double, q90 double")
    out = conformal.calibrate(rows, conformal.corrections(rows, 0.2, 2)).collect()
    assert all(abs(r.conformal_correction - 0.3) < 1e-9 and abs(r.q90 - 1.3) < 1e-9 and r.conformal_level == "model+hp_type+horizon+temperature_regime" for r in out)


def test_portfolio_totals(spark):
    members = spark.createDataFrame([("both", "seen", "ASHP", 2, 1), ("both", "seen", "ASHP", 2, 2), ("one", "seen", "ASHP", 1, 1)], "portfolio_id string, cohort string, portfolio_type string, portfolio_size int, household_id long")
    rows = spark.createDataFrame([(h, "m", "calibration", 0, 1, 1, y, y, y, y) for h, y in ((1, 1.0), (2, 2.0))], "household_id long, model string, split string, origin long, target long, horizon int, y_true double, q10 double, q50 double, q90 double")
    assert {r.portfolio_id: r.y_true for r in portfolio.aggregate(rows, members).collect()} == {"both": 3.0, "one": 1.0}


def test_features_are_causal_and_lag_one_is_now(spark):
    a, b = (features.load_features(panel(spark, 300, change=x), lags=(1, 4, 96), windows=(4, 96)).where("step <= 200").orderBy("step").collect() for x in (None, 200))
    assert a == b and all(r.load_lag_1 == r.y for r in a)


def test_valid_origins_leave_imputed_targets_out(spark):
    p = panel(spark).withColumn("originally_missing", F.when(F.col("step") == 760, 1).otherwise(0))
    got = [r.pos for r in origins.valid_origins(p, 672, 96).collect()]
    assert got and not any(pos <= 760 <= pos + 96 for pos in got) and min(got) >= 672 and max(got) < 900 - 96


def test_supervised_rows_have_complete_paths(spark):
    p = panel(spark)
    o = origins.valid_origins(p, 672, 96, stride=50)
    rows = origins.supervised(p, o, [1, 96]).collect()
    assert len(rows) == 2 * o.count() and all(r.target == r.origin + r.horizon for r in rows)
    by = {r.step: r.y for r in p.collect()}
    assert all(abs(r.baseline_daily - by[r.target - 96]) < 1e-12 and abs(r.baseline_weekly - by[r.target - 672]) < 1e-12 for r in rows)


def test_clock_strata_are_even(spark):
    rows = spark.range(5000).select(F.lit(1).alias("household_id"), F.col("id").alias("step"), (F.col("id") / 4 % 24).cast("int").alias("hr"), (F.col("id") % 4 == 0).alias("exact"))
    got = origins.clock_stratified(rows, ["household_id"], "hr", [0, 6, 12, 18], 8, exact="exact").collect()
    assert sorted(r.hr for r in got) == [0, 0, 6, 6, 12, 12, 18, 18] and all(r.step % 4 == 0 for r in got)


def test_thinning_matches_linspace(spark):
    for n, m in ((2, 1), (7, 3), (50, 8), (9, 9), (10, 12)):
        got = sorted(r.id for r in c.thin(spark.range(n).withColumn("g", F.lit(1)), ["g"], ["id"], m).collect())
        assert got == (sorted(set(np.linspace(0, n - 1, m, dtype=int).tolist())) if n > m else list(range(n)))


def test_protocol_violations_fail_closed(spark):
    roles = spark.createDataFrame([(1, "train")], "household_id long, role string")
    rows = spark.createDataFrame([(1, "train", 5, 5 + h, h) for h in (1, 2)], "household_id long, split string, origin long, target long, horizon int")
    good = quality.protocol_checks(rows, roles, F.lit(7.0), F.lit(9.0), 2)
    assert quality.violations(quality.require(good)).count() == 0
    with pytest.raises(quality.ProtocolError):
        quality.require(quality.protocol_checks(rows, roles, F.lit(6.0), F.lit(9.0), 2))


def test_gap_filling_by_hand(spark):
    rows = spark.createDataFrame([(1, 0, 1.0), (1, 2, 3.0), (1, 5, 9.0)], "household_id long, step long, y double")
    got = [(r.step, r.y, r.originally_missing) for r in grid.fill_short_gaps(grid.regular_grid(rows), 1).orderBy("step").collect()]
    assert got == [(0, 1.0, 0), (1, 2.0, 1), (2, 3.0, 0), (3, None, 1), (4, None, 1), (5, 9.0, 0)]


def test_configuration():
    assert signature({"a": 1, "b": 2}) == signature({"b": 2, "a": 1})
    assert merged({"evaluation": {"alpha": 0.1}})["evaluation"]["conformal_min_samples"] == 100
    checked(merged({}))
    with pytest.raises(ConfigError):
        checked(merged({"evaluation": {"alpha": 2}}))
    assert features.temperature_column(["x", "Temp_min_hourly", "Temperature_dew_hourly", "Air_Temperature_hourly"]) == "Air_Temperature_hourly"


def test_quantiles_of_values_of_both_signs(spark):
    """Negative values, however large, are ranked like any others."""
    rng = np.random.default_rng(11)
    values = [*rng.uniform(-200, 50, 900).tolist(), *(rng.normal(0, 1, 60) * 10.0 ** rng.integers(-8, 9, 60)).tolist(), -1e12, -3.0, -3.0, 0.0, 1e12]
    df = spark.createDataFrame([("a" if i % 3 else None, v) for i, v in enumerate(values)], "g string, v double")
    part = {"a": sorted(v for i, v in enumerate(values) if i % 3), None: sorted(values[::3])}
    ranks = range(1, len(part[None]) + 1, 3)
    ranked = {r.g: r for r in c.rank_values(df, ["g"], "v", {f"r{k}": F.lit(k) for k in ranks}).collect()}
    for g, want in part.items():
        assert [ranked[g][f"r{k}"] for k in ranks] == [want[k - 1] for k in ranks]
    levels = {"low": 0.03, "mid": 0.5, "high": 0.97}
    got = {r.g: r for r in c.linear_quantiles(df, ["g"], "v", levels).collect()}
    for g, want in part.items():
        assert [got[g][k] for k in levels] == pytest.approx(list(np.quantile(want, list(levels.values()))), rel=1e-12)


def frames_to_the_end(df):
    """Window frames of the plan that Spark would add up anew for each row."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding$(), currentrow$()" in plan
    return plan.count("currentrow$(), unboundedfollowing$()")


def test_next_values_take_one_pass(spark):
    """A frame from the row to the end is quadratic in the length of a series; the values stay the same."""
    rows = spark.createDataFrame([(1, i, float(i) if i in (2, 4, 7) else None) for i in range(10)] + [(2, 0, None)], "household_id long, step long, y double")
    filled = grid.fill_short_gaps(rows, 2)
    assert frames_to_the_end(filled) == 0
    assert [r.y for r in filled.where("household_id = 1").orderBy("step").collect()] == [None, None, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, None, None]
    assert frames_to_the_end(grid.interpolate_onto(rows, rows.withColumnRenamed("y", "t"), "t", 3)) == 0
    s = rows.select("*", F.lit("a").alias("sequence_id"))
    assert frames_to_the_end(grid.fill_sequence_weather(s, "y")) == 0
    got = rows.withColumn("n", c.next_value("y", grid.back_in_time())).orderBy("household_id", "step").collect()
    assert [r.n for r in got] == [2.0, 2.0, 2.0, 4.0, 4.0, 7.0, 7.0, 7.0, None, None, None]


def test_remaining_origins_are_found_once(spark):
    """Both sides of the anti-join read one written table; before, each had the windows over the whole panel."""
    df = panels.remaining_antijoin(spark, "/root/testdata/sf0.01")
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
    every = {(r.household_id, r.step) for r in panels.valid_origins(spark, "/root/testdata/sf0.01").collect()}
    assert every and {(r.household_id, r.step) for r in df.collect()} == {(h, s) for h, s in every if s % 24 not in (0, 6, 12, 18)}


def test_running_visits(spark):
    """Visits before the first row, between rows, repeated or of others count as before, and no row holds a list of all visits."""
    rows = spark.createDataFrame([(h, i, float(i)) for h in (1, 2, None) for i in (3, 5, 6, 9)], "household_id long, step long, y double")
    visits = spark.createDataFrame([(1, 1), (1, 5), (1, 5), (1, 7), (1, 20), (3, 4), (None, 4), (1, None)], "household_id int, visit_step int")
    df = grid.visit_segments(rows, visits)
    assert not {"collect_list", "filter("} & set(re.findall(r"collect_list|filter\(", df._jdf.queryExecution().optimizedPlan().toString()))
    assert df.columns == ["household_id", "step", "y", "segment_id"] and df.schema["segment_id"].dataType.simpleString() == "bigint"
    got = {(r.household_id, r.step): (r.y, r.segment_id) for r in df.collect()}
    assert got == {(h, i): (float(i), n if h == 1 else 0) for h in (1, 2, None) for i, n in ((3, 1), (5, 3), (6, 3), (9, 4))}


def test_grids_grow_in_many_tasks(spark):
    """The few small rows of spans aren't joined into one task, which would make every row of the grid."""
    rows = spark.range(400).select((F.col("id") % 40).alias("household_id"), (F.col("id") * 7 % 1000).alias("step"), F.lit(1.0).alias("y"))
    for common in (False, True):
        df = grid.regular_grid(rows, common=common)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and plan.index("Generate explode") < plan.index("REPARTITION_BY_NUM")
        spans = rows.groupBy("household_id").agg(F.min("step").alias("a"), F.max("step").alias("b")).collect()
        ends = min(r.a for r in spans), max(r.b for r in spans)
        want = {(r.household_id, i) for r in spans for i in (range(ends[0], ends[1] + 1) if common else range(r.a, r.b + 1))}
        got = [(r.household_id, r.step) for r in df.collect()]
        assert len(got) == len(want) and set(got) == want
