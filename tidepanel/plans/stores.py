"""Queries over sinks and sources, column choice, kept models and tidied forecasts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidepanel.functions.artifacts import folder
from tidepanel.operators import features, models, quality
from tidepanel.plans import base as b
from tidepanel.plans.registry import query
from tidepanel.sources import files


def _place(df) -> str:
    return f"{folder(df)}/stores/{uuid.uuid4().hex}"


@query("custkey:i name:s acctbal:d", "SELECT c_custkey AS custkey, c_name AS name, c_acctbal AS acctbal FROM customer")
def delimited_round_trip(spark, d):
    """A table written as semicolon text and read back with its schema."""
    c = b.table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"))
    path = _place(c)
    c.write.option("sep", ";").option("header", True).csv(path)
    return files.read_semicolon(spark, path, "custkey bigint, name string, acctbal double")


@query("household_id:i rows:i first:i last:i y:d", b.sql("SELECT household_id, count(*) AS rows, min(step) AS first, max(step) AS last, sum(y) AS y FROM p6 GROUP BY 1", "p6"))
def panel_shards(spark, d):
    """Panels in folders by household; the household is read from the folder's name, so filters on it prune folders."""
    p = b.p6(spark, d)
    shards = files.read_table(spark, files.write_table(p.repartition("household_id"), _place(p), ["household_id"]))
    return shards.groupBy("household_id").agg(F.count("*").alias("rows"), F.min("step").alias("first"), F.max("step").alias("last"), (F.sum(F.round(F.col("y") * 100).cast("long")) / 100).alias("y"))


@query("orderkey:i priority:s", "SELECT o_orderkey AS orderkey, o_orderpriority AS priority FROM orders")
def projection_repeated_names(spark, d):
    """A projection that names a column twice gives it once."""
    return files.read_table(spark, f"{d}/orders.parquet", ["o_orderkey", "o_orderpriority", "o_orderkey"]).toDF("orderkey", "priority")


def _filled_counts(df, names):
    """(``feature``, ``rows``, ``filled``) of each named column, in one pass."""
    counts = df.agg(F.count("*").alias("rows"), *(F.count(c).alias(f"_{i}") for i, c in enumerate(names)))
    return counts.select("rows", F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"_{i}").alias("filled")) for i, c in enumerate(names)))))


def _filled_sql(names: str, *needs: str) -> str:
    return b.sql(" UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS rows, count({c}) AS filled FROM sup" for c in names.split()), *needs)


@query("feature:s rows:i filled:i", _filled_sql("pos horizon horizon_sqrt path_end baseline_persistence baseline_daily baseline_weekly causal future__temperature future__operational", "sup"))
def feature_projection(spark, d):
    """All columns of the supervised rows that are not denied."""
    rows = b.supervised(spark, d)
    return _filled_counts(rows, [c for c in features.feature_columns(rows) if c not in ("train_end", "calibration_end")])


@query("feature:s rows:i filled:i", _filled_sql("baseline_persistence baseline_daily baseline_weekly future__temperature future__operational", "sup"))
def prefix_projection(spark, d):
    rows = b.supervised(spark, d)
    return _filled_counts(rows, features.with_prefix(rows, "baseline_", "future__"))


@query("household_id:i step:i y:d temperature:d", b.sql("SELECT household_id, step, y, hw.temperature FROM p1 LEFT JOIN hw USING (household_id, step)", "p1", "hw"))
def weather_columns(spark, d):
    """The meter's own temperature gives way to the weather's; what isn't a number stays behind."""
    meter = b.p1(spark, d).withColumn("temperature", F.lit(-99.0))
    weather = b.household_weather(spark, d).withColumns({"Date": F.lit("2024-01-01"), "Weather_ID": F.lit(1), "station": F.lit("north")})
    kept, names = features.without_overlap(meter, weather, ["household_id", "step"])
    return kept.join(weather.select("household_id", "step", *names), ["household_id", "step"], "left")


@query("household_id:i hour:i origins:i", b.sql("SELECT household_id, step % 4 AS hour, count(*) AS origins FROM p6 WHERE step % 4 NOT IN (SELECT DISTINCT step % 4 FROM w6 WHERE temperature >= (SELECT median(temperature) FROM w6)) OR household_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1, 2", "p6", "w6"))
def subset_violations(spark, d):
    """Origins whose hour or household isn't among the allowed ones, by anti-joins."""
    p = b.p6(spark, d).select("household_id", "step", (F.col("step") % 4).alias("hour"))
    w = b.weather(spark, d)
    mid = w.agg(F.median("temperature").alias("mid"))
    hours = w.crossJoin(F.broadcast(mid)).where("temperature >= mid").select((F.col("step") % 4).alias("hour"))
    building = b.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("household_id"))
    late, foreign = quality.outside(p, hours, ["hour"]), quality.outside(p, building, ["household_id"])
    return late.union(foreign).distinct().groupBy("household_id", "hour").agg(F.count("*").alias("origins"))


@query("horizon:i rows:i changed:i", b.sql("SELECT horizon, count(*) AS rows, 0 AS changed FROM sup WHERE split = 'seen_test' AND baseline_persistence IS NOT NULL AND baseline_daily IS NOT NULL GROUP BY 1", "sup"))
def kept_model(spark, d):
    """A model that was saved and loaded predicts what it did before."""
    rows = b.supervised(spark, d).where("baseline_persistence IS NOT NULL AND baseline_daily IS NOT NULL")
    model = models.ElasticNet(["baseline_persistence", "baseline_daily", "horizon_sqrt"]).fit(rows.where("split = 'train'"))
    path = _place(rows)
    model.save(path)
    test = rows.where("split = 'seen_test'")
    keys = ["household_id", "origin", "horizon"]
    before, after = model.predict(test), models.ElasticNet.load(path).predict(test)
    both = before.select(*keys, "y_pred").join(after.select(*keys, F.col("y_pred").alias("again")), keys, "full")
    return both.groupBy("horizon").agg(F.count("*").alias("rows"), F.count_if(~F.col("y_pred").eqNullSafe(F.col("again"))).alias("changed"))


@query("household_id:i origin:i target:i horizon:i y_true:d y_pred:d q10:d q50:d q90:d", b.sql("SELECT household_id, origin, target, horizon, y_true, baseline_daily AS y_pred, 0.5 * baseline_daily AS q10, baseline_daily AS q50, 2.0 * baseline_daily AS q90 FROM sup WHERE split = 'seen_test'", "sup"))
def tidied_forecasts(spark, d):
    """Trajectories (an array of three quantiles per horizon) as one row per horizon."""
    rows = b.supervised(spark, d).where("split = 'seen_test'")
    step = F.struct("horizon", "y_true", F.array(F.col("baseline_daily") * 0.5, F.col("baseline_daily"), F.col("baseline_daily") * 2.0).alias("q"))
    paths = rows.groupBy("household_id", "origin").agg(F.array_sort(F.collect_list(step)).alias("p"))
    paths = paths.select("household_id", "origin", F.col("p.q").alias("quantiles"), F.col("p.y_true").alias("actual"))
    return models.tidied(paths, [0.1, 0.5, 0.9])
