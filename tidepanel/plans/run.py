"""The whole analysis over a raw folder: every stage a table under ``out``, computed once."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.columns import draw, finite, numeric
from tidepanel.operators import conformal, encode, features, grid, inference, metrics, models, origins, portfolio, quality, reports, splits
from tidepanel.plans.config import ConfigError, checked, merged, signature
from tidepanel.sources import files

QUARTER = 900_000_000
KEPT = ["household_id", "hp_type", "origin", "target", "horizon", "split", "y_true"]


class Run:
    """Stages read the tables of earlier ones. A run folder belongs to one configuration and one input state."""

    def __init__(self, spark: SparkSession, root: str, out: str, overrides: dict | None = None, holidays: DataFrame | None = None):
        self.spark, self.out = spark, out.rstrip("/")
        self.holidays = features.canton_holidays(spark) if holidays is None else holidays
        self.config = checked(merged(overrides or {}))
        self.adapter = files.Adapter(spark, root)
        self.claim()

    def claim(self) -> None:
        """Refuses a folder that another configuration has used."""
        mine = signature(self.config)
        path = f"{self.out}/run"
        if files._exists(self.spark, path):
            found = self.spark.read.json(path).first()["signature"]
            if found != mine:
                raise ConfigError(f"{self.out} belongs to configuration {found[:12]}, not {mine[:12]}")
        else:
            self.spark.createDataFrame([(mine,)], "signature string").coalesce(1).write.json(path)

    def table(self, name: str, make) -> DataFrame:
        path = f"{self.out}/{name}"
        if not files._exists(self.spark, f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    # ---- inputs ----

    @cached_property
    def households(self) -> DataFrame:
        m = self.adapter.metadata()
        kind = files.hp_type() if "Survey_HeatPump_Installation_Type" in m.columns else F.lit(None).cast("string")
        return m.select(F.col("Household_ID").alias("household_id"), kind.alias("hp_type"), *(F.col(c).alias(f"static__{c}") for c in m.columns if c.startswith("Survey_") and dict(m.dtypes)[c] in ("int", "bigint", "double"))).where("household_id IS NOT NULL")

    @cached_property
    def meters(self) -> DataFrame:
        m = self.adapter.meters()
        return m.select(F.col("Household_ID").alias("household_id"), F.floor(F.unix_micros("Timestamp") / QUARTER).alias("step"), finite(F.col(self.adapter.target)).alias("y"), F.col("Timestamp").cast("timestamp_ntz").alias("ts"))

    @cached_property
    def weather(self) -> DataFrame:
        w = self.adapter.weather_by_household()
        name = features.temperature_column(w.columns)
        value = numeric(F.col(name).cast("string")) if name else F.lit(None).cast("double")
        return w.select(F.col("Household_ID").alias("household_id"), F.floor(F.unix_micros("Timestamp") / QUARTER).alias("step"), value.alias("temperature"))

    @cached_property
    def visits(self) -> DataFrame:
        p = self.adapter.protocols().where("Visit_Date IS NOT NULL AND Household_ID IS NOT NULL")
        return p.select(F.col("Household_ID").alias("household_id"), F.floor(F.unix_micros("Visit_Date") / QUARTER).alias("visit_step"))

    # ---- stages ----

    def audit(self) -> DataFrame:
        """The audit under the configured inclusion, with whether a household has protocols and several visits."""
        i = self.config["inclusion"]
        limits = {"days": i["min_days"], "missing": i["max_target_missing_fraction"], "weather": i["min_weather_match_fraction"], "seasons": i["min_heating_seasons"]}

        def make() -> DataFrame:
            covered = grid.interpolate_onto(self.meters.select("household_id", "step"), self.weather, "temperature", 3).where("temperature IS NOT NULL")
            seasons = quality.heating_seasons(self.meters, "ts", i["heating_months"], i["min_season_days"], self.config["data"]["timezone"])
            out = quality.audit(self.meters.select("household_id", "step", "y"), self.households.select("household_id", "hp_type"), covered, 96, limits, seasons)
            visits = self.visits.groupBy("household_id").agg(F.count("*").alias("_v"))
            return out.join(visits, "household_id", "left").withColumns({"protocol_available": F.col("_v").isNotNull(), "multiple_visits": F.coalesce(F.col("_v") > 1, F.lit(False))}).drop("_v")

        return self.table("audit", make)

    def panels(self) -> DataFrame:
        def make() -> DataFrame:
            f = self.config["features"]
            eligible = self.audit().where("eligible").select("household_id", "hp_type")
            base = self.meters.select("household_id", "step", "y").join(eligible, "household_id", "left_semi")
            panel = grid.fill_short_gaps(grid.regular_grid(base), self.config["data"]["short_gap_steps"])
            panel = grid.interpolate_onto(panel, self.weather, "temperature", 3)
            panel = grid.causal_fill(grid.lagged(panel, "temperature", f["forecast_steps"], "operational"), "temperature", "causal", 4)
            panel = grid.visit_segments(panel, self.visits).join(eligible, "household_id")
            panel = features.load_features(panel, f["lag_steps"], f["rolling_steps"], min(96, f["history_steps"]), f["on_threshold"])
            panel = panel.withColumn("ts", F.timestamp_micros(F.col("step") * QUARTER).cast("timestamp_ntz"))
            return features.calendar(panel, "ts", self.config["data"]["timezone"], self.holidays).drop("ts")

        return self.table("panels", make)

    def split(self) -> DataFrame:
        s = self.config["split"]
        return self.table("split", lambda: splits.stratified_split(self.audit().where("eligible").select("household_id", "hp_type"), s["unseen_household_fraction"], s["validation_household_fraction"], self.config["project"]["seed"]))

    def ends(self) -> DataFrame:
        s = self.config["split"]
        spans = lambda: self.audit().where("eligible").select(F.col("first_step").alias("start"), F.col("last_step").alias("end"))
        return self.table("cutoffs", lambda: splits.cutoffs(spans(), s["temporal_train_fraction"], s["temporal_calibration_fraction"]))

    def supervised(self) -> DataFrame:
        """Origins are thinned before they meet the horizons: a stride for training, clock strata for evaluation."""

        def make() -> DataFrame:
            f, s = self.config["features"], self.config["sampling"]
            panel = origins.contained(self.panels(), f["forecast_steps"])
            found = origins.valid_origins(panel, f["history_steps"], f["forecast_steps"])
            found = found.join(self.split().select("household_id", "role"), "household_id").crossJoin(F.broadcast(self.ends()))
            found = found.withColumn("split", splits.split_label(F.col("step"), F.col("train_end"), F.col("calibration_end"), F.col("role")))
            late = F.when(F.col("split") == "train", F.col("path_end") > F.col("train_end")).when(F.col("split") == "calibration", F.col("path_end") > F.col("calibration_end")).otherwise(False)
            found = found.where(~late).withColumn("local", F.convert_timezone(F.lit("UTC"), F.lit(self.config["data"]["timezone"]), F.timestamp_micros(F.col("step") * QUARTER).cast("timestamp_ntz")))
            train = found.where(F.col("split") == "train").where(F.pmod(F.col("pos") - f["history_steps"], F.lit(s["train_stride"])) == 0)
            rest = found.where(F.col("split") != "train").withColumns({"hr": F.hour("local"), "exact": F.minute("local") == 0})
            rest = origins.clock_stratified(rest, ["household_id", "split"], "hr", s["eval_clock_hours"], s["max_eval_origins_per_household"], exact="exact")
            kept = train.unionByName(rest.drop("hr", "exact"))
            names = [c for c in self.panels().columns if c.startswith("load_")]
            future = tuple(c for c in self.panels().columns if c.startswith("cal_")) + ("temperature", "operational")
            return origins.supervised(self.panels(), kept, list(range(1, f["forecast_steps"] + 1)), keep=("split", "causal", *names), future=future)

        return self.table("supervised", make)

    def leakage(self) -> DataFrame:
        """Raises if a row breaks the protocol."""
        end = self.ends().first()
        checks = quality.protocol_checks(self.supervised(), self.split().select("household_id", "role"), F.lit(end.train_end), F.lit(end.calibration_end), self.config["features"]["forecast_steps"])
        return quality.require(self.table("leakage", lambda: checks))

    def scales(self) -> DataFrame:
        return self.table("scales", lambda: metrics.seasonal_scales(self.panels(), self.split().select("household_id", "hp_type", "role"), F.lit(self.ends().first().train_end), self.config["evaluation"]["mase_season_steps"], self.config["evaluation"]["mase_min_differences"]))

    def model_rows(self, scenario: str) -> tuple[DataFrame, list[str]]:
        """Supervised rows with the scenario's temperature, and the names of the features."""
        rows = self.supervised().withColumn("temperature_c", F.coalesce(features.scenario_value(scenario, "future__temperature", "future__operational"), "causal"))
        return rows, [c for c in rows.columns if c.startswith(("load_", "future__cal_", "baseline_")) or c in ("horizon_sqrt", "temperature_c")]

    def sampled(self, rows: DataFrame, salt: int = 0) -> DataFrame:
        """At most ``max_train_rows`` of ``rows``, evenly over the horizons: by hash, so reruns agree."""
        most, seed, keys = self.config["sampling"]["max_train_rows"], self.config["project"]["seed"] + salt, ["household_id", "origin", "horizon"]
        have = rows.count()
        if have <= most:
            return rows
        rows = rows.where(draw(seed, *(F.col(k).cast("string") for k in keys)) < min(1.0, 1.2 * most / have) * 2**32)
        return splits.capped_sample(rows, "horizon", -(-most // self.config["features"]["forecast_steps"]), most, seed, keys)

    def fitted(self, train: DataFrame, validation: DataFrame, names: list[str], salt: int = 0):
        """(encoder, elastic net, boosted trees) of a sample of ``train``; residuals come from ``validation``."""
        m, keep = self.config["models"], ["y_true", "horizon"]
        train = self.sampled(train, salt)
        encoder = encode.TabularEncoder.fit(train, names)
        x = encoder.transform(train, keep)
        net = models.ElasticNet(names, m["elastic_net"]["alpha"], m["elastic_net"]["l1_ratio"]).fit(x)
        trees = models.BoostedQuantiles(names, m["boosted_trees"]["iterations"], m["boosted_trees"]["depth"], self.config["project"]["seed"])
        return encoder, net, trees.fit(x, encoder.transform(self.sampled(validation, salt), keep))

    def predictions(self, scenario: str | None = None) -> DataFrame:
        """Baselines, elastic net and boosted trees; the fitted models are kept beside the tables."""
        scenario = scenario or self.config["data"]["weather_scenario"]

        def make() -> DataFrame:
            rows, names = self.model_rows(scenario)
            base = models.baselines(rows, keep=("temperature_c",))
            train, held = rows.where("split = 'train'"), rows.where("split = 'unseen_validation'")
            if train.isEmpty():
                return base
            encoder, net, trees = self.fitted(train, rows.where("split = 'calibration'") if held.isEmpty() else held, names)
            net.save(f"{self.out}/models/elastic_net_{scenario}")
            trees.save(f"{self.out}/models/boosted_trees_{scenario}")
            x = encoder.transform(rows.where("split <> 'train'"), KEPT)
            known = rows.select("household_id", "origin", "horizon", "temperature_c").dropDuplicates(["household_id", "origin", "horizon"])
            return base.unionByName(net.predict(x).unionByName(trees.predict(x)).join(known, ["household_id", "origin", "horizon"]))

        return self.table(f"predictions_{scenario}", make)

    def calibrated(self, scenario: str | None = None) -> DataFrame:
        e = self.config["evaluation"]
        scenario = scenario or self.config["data"]["weather_scenario"]

        def make() -> DataFrame:
            p = self.predictions(scenario)
            p = conformal.with_regime(p, conformal.temperature_thresholds(p.where("split = 'calibration'"), e["cold_temperature_quantile"]))
            table = self.table(f"corrections_{scenario}", lambda: conformal.corrections(p.where("split = 'calibration'"), e["alpha"], e["conformal_min_samples"]))
            return conformal.calibrate(p, table)

        return self.table(f"calibrated_{scenario}", make)

    def evaluated(self, scenario: str | None = None) -> DataFrame:
        scenario = scenario or self.config["data"]["weather_scenario"]
        return self.table(f"metrics_{scenario}", lambda: metrics.forecast_metrics(metrics.attach_scale(self.calibrated(scenario), self.scales()), alpha=self.config["evaluation"]["alpha"]))

    def variants(self) -> DataFrame:
        """The same measures of the intervals before calibration and of cold hours, and what calibration changes."""
        e, scored = self.config["evaluation"], metrics.attach_scale(self.calibrated(), self.scales())
        raw = scored.withColumns({"q10": F.col("q10_raw"), "q90": F.col("q90_raw")})
        self.table("metrics_raw", lambda: metrics.forecast_metrics(raw, alpha=e["alpha"]))
        return self.table("metrics_cold", lambda: metrics.forecast_metrics(scored.where("temperature_regime = 'cold'"), alpha=e["alpha"]))

    def peaks(self) -> DataFrame:
        e = self.config["evaluation"]
        return self.table("peaks", lambda: metrics.peak_metrics(self.calibrated().where("split LIKE '%test'"), self.supervised().where("split = 'train'"), e["peak_threshold_quantile"], e["top_peak_fraction"]))

    def transfer(self) -> DataFrame:
        """Boosted trees trained on one type, or both, scored on each type's tests."""

        def make() -> DataFrame:
            rows, names = self.model_rows(self.config["data"]["weather_scenario"])
            parts = []
            for salt, (name, chosen) in enumerate((("ASHP", F.col("hp_type") == "ASHP"), ("GSHP", F.col("hp_type") == "GSHP"), ("combined", F.lit(True))), 1):
                train = rows.where((F.col("split") == "train") & chosen)
                if not train.isEmpty():
                    encoder, _, trees = self.fitted(train, rows.where((F.col("split") == "calibration") & chosen), names, salt)
                    parts.append(trees.predict(encoder.transform(rows.where("split LIKE '%test'"), KEPT)).withColumn("train_types", F.lit(name)))
            return metrics.forecast_metrics(reduce(DataFrame.unionByName, parts), ["model", "train_types", "split", "hp_type", "horizon"])

        return self.table("transfer", make)

    def rolling(self) -> DataFrame:
        """One fit per fold up to its cutoff, its last origins kept for monitoring, scored on the fold's evaluation time."""

        def make() -> DataFrame:
            rows, names = self.model_rows(self.config["data"]["weather_scenario"])
            share, ends, parts = self.config["sampling"]["rolling_monitor_fraction"], self.ends().first(), []
            spans = self.spark.createDataFrame([(float(ends.global_start), float(ends.calibration_end))], "start double, end double")
            for f in splits.rolling_cutoffs(spans, self.config["split"]["rolling_folds"]).collect():
                past = rows.where(F.col("origin") <= f.train_end)
                origins_ = past.select("origin").distinct()
                n = origins_.count()
                test = rows.where((F.col("origin") > f.train_end) & (F.col("origin") <= f.evaluation_end))
                if n < 2 or test.isEmpty():
                    continue
                first = origins_.orderBy(F.col("origin").desc()).limit(min(n - 1, max(1, -(-int(n * share * 1000) // 1000)))).agg(F.min("origin")).first()[0]
                encoder, _, trees = self.fitted(past.where(F.col("origin") < first), past.where(F.col("origin") >= first), names, f.fold)
                parts.append(trees.predict(encoder.transform(self.sampled(test, 100 + f.fold), KEPT)).withColumn("fold", F.lit(f.fold + 1)))
            return metrics.forecast_metrics(reduce(DataFrame.unionByName, parts), ["fold", "model", "hp_type", "horizon"])

        return self.table("rolling", make)

    def importance(self) -> DataFrame:
        """Permutation importance of the kept boosted trees on a bounded sample of test rows."""

        def make() -> DataFrame:
            scenario = self.config["data"]["weather_scenario"]
            self.predictions(scenario)
            rows, names = self.model_rows(scenario)
            trees = models.BoostedQuantiles.load(f"{self.out}/models/boosted_trees_{scenario}")
            encoder = encode.TabularEncoder.fit(self.sampled(rows.where("split = 'train'")), names)
            tests = splits.explanation_sample(rows, 2000, 10000, self.config["project"]["seed"], ["household_id", "origin", "horizon"])
            return models.permutation_importance(trees.predict, encoder.transform(tests, KEPT), names)

        return self.table("importance", make)

    def validation(self) -> DataFrame:
        """(``gate``, ``rows``, ``violations``) of the calibrated predictions; raises if a gate doesn't hold."""

        def make() -> DataFrame:
            c = self.calibrated()
            gates = {
                "quantiles_finite": "q10 IS NOT NULL AND q50 IS NOT NULL AND q90 IS NOT NULL AND NOT isnan(q10 + q50 + q90)", "quantiles_ordered": "q10 <= q50 AND q50 <= q90", "quantiles_not_negative": "q10 >= 0",
                "intervals_never_narrower": "q10 <= q10_raw AND q90 >= q90_raw", "corrections_not_negative": "conformal_correction >= 0", "targets_follow_horizons": "target - origin = horizon",
                "truth_present": "y_true IS NOT NULL", "regimes_known": "temperature_regime IN ('cold', 'normal', 'unknown')",
            }
            counted = c.agg(F.count("*").alias("rows"), *(F.count_if(~F.coalesce(F.expr(g), F.lit(False))).alias(k) for k, g in gates.items()))
            twice = c.groupBy("household_id", "origin", "horizon", "model").count().agg(F.count_if(F.col("count") > 1).alias("rows_unique"))
            names = [*gates, "rows_unique"]
            return counted.crossJoin(twice).select("rows", F.explode(F.array(*(F.struct(F.lit(k).alias("gate"), F.col(k).alias("violations")) for k in names))).alias("g")).select("g.gate", "rows", "g.violations")

        out = self.table("validation", make)
        bad = [r.gate for r in out.where("violations > 0").collect()]
        if bad:
            raise quality.ProtocolError(f"predictions: {bad}")
        return out

    def portfolios(self) -> DataFrame:
        """The detail of load shifting; its invariants are checked."""
        p, e = self.config["portfolio"], self.config["evaluation"]

        def sums() -> DataFrame:
            cohort = F.when(F.col("role") == "train", "seen").when(F.col("role") == "unseen_test", "unseen")
            members = splits.sample_portfolios(self.split().select("household_id", "hp_type", cohort.alias("cohort")).where("cohort IS NOT NULL"), p["sizes"], p["repetitions"], self.config["project"]["seed"], tuple(p["types"]))
            return portfolio.aggregate(self.calibrated().drop("hp_type"), members, p["coverage"])

        def make() -> DataFrame:
            rows = self.table("portfolio_sums", sums)
            bounded = portfolio.with_bounds(rows, self.table("portfolio_corrections", lambda: portfolio.residual_bounds(rows, e["alpha"], p["min_calibration_samples"])))
            steps, room = self.config["features"]["forecast_steps"], p["destination_capacity_factor"]
            each = [portfolio.manage_peaks(bounded, portfolio.peak_thresholds(bounded, q), steps, p["flexible_fractions"], p["shift_hours"], room=room).withColumn("peak_threshold_quantile", F.lit(q)) for q in p["peak_threshold_quantiles"]]
            return reduce(DataFrame.unionByName, each)

        detail = self.table("peak_detail", make)
        bad = [k for k, v in portfolio.invariants(detail).first().asDict().items() if v]
        if bad:
            raise quality.ProtocolError(f"load shifting: {bad}")
        self.table("portfolio_sensitivity", lambda: reports.sensitivity(self.table("portfolio_corrections", None), self.config["statistics"]["portfolio_sensitivity_thresholds"]))
        return self.table("peak_summary", lambda: reduce(DataFrame.unionByName, [portfolio.summarise(detail.where(F.col("peak_threshold_quantile") == q)).withColumn("peak_threshold_quantile", F.lit(q)) for q in p["peak_threshold_quantiles"]]))

    def inference(self) -> DataFrame:
        """Paired tests of the configured comparisons, by households and by days within them, with step-down correction."""
        e, t, seed = self.config["evaluation"], self.config["statistics"], self.config["project"]["seed"]
        rows = self.calibrated().where(F.col("split").isin("seen_test", "unseen_test") & F.col("horizon").isin(e["report_horizons"])).withColumn("day", F.floor(F.col("target") / 96))
        names = {r.model for r in rows.select("model").distinct().collect()}
        pairs = [(a, b) for a, b in t["comparisons"] if {a, b} <= names]
        strata, most, reliable = ["split", "hp_type", "horizon"], t["bootstrap_repetitions"], t["minimum_households_for_confirmatory"]
        deltas = inference.paired(rows, pairs, strata, ["household_id", "day", "origin", "target"])
        self.table("intervals", lambda: inference.metric_intervals(rows, ["model", *strata], "day", most, seed, reliable=reliable))
        for name, nested in (("tests", False), ("tests_nested", True)):
            tests = self.table(name, lambda nested=nested: inference.holm(inference.paired_test(deltas, strata, "day", most, seed, nested, reliable), alpha=t["multiple_testing_alpha"]))
            self.table(f"{name}_summary", lambda tests=tests: reports.test_summary(tests))
        return self.table("tests", None)

    def report(self) -> DataFrame:
        return self.table("winners", lambda: reports.winners(reports.weighted(self.evaluated().where("split LIKE '%test'"), ["model", "split", "hp_type"], ["mae", "approx_crps"]), ["split", "hp_type"], ["mae", "approx_crps"]))

    # ---- entry points ----

    def prepare(self) -> DataFrame:
        return self.leakage()

    def pilot(self) -> DataFrame:
        self.prepare()
        self.evaluated()
        self.validation()
        self.variants()
        return self.peaks()

    def full(self) -> DataFrame:
        self.pilot()
        self.transfer()
        self.rolling()
        self.importance()
        self.portfolios()
        return self.report()

    def suite(self) -> DataFrame:
        """Both weather scenarios and what the realised weather is worth."""
        self.prepare()
        one, two = (self.evaluated(s).select("model", "split", "hp_type", "horizon", F.col("mae").alias(f"mae_{s}")) for s in ("operational", "oracle"))
        return self.table("scenarios", lambda: one.join(two, ["model", "split", "hp_type", "horizon"]).withColumn("mae_difference", F.col("mae_operational") - F.col("mae_oracle")))

    def finalize(self) -> DataFrame:
        return self.inference()
