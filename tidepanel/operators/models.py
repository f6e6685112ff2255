"""Forecast models. Baselines and interval residuals are plain DataFrame operations; learners are Spark ML's."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import linear_quantiles, sorted_quantiles

PREDICTION = ("household_id", "hp_type", "origin", "target", "horizon", "split", "y_true", "model", "y_pred", "q10", "q50", "q90")


def baselines(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Persistence, daily and weekly forecasts as rows of three models, all quantiles at the point."""
    names = ("persistence", "daily", "weekly")
    long = F.inline(F.array(*(F.struct(F.lit(n).alias("model"), F.col(f"baseline_{n}").alias("y_pred")) for n in names)))
    out = rows.select("household_id", "hp_type", "origin", "target", "horizon", "split", "y_true", *keep, long).where("y_pred IS NOT NULL")
    return out.withColumns({q: F.col("y_pred") for q in ("q10", "q50", "q90")})


def prediction_frame(rows: DataFrame, model: str, point: Column, low: Column, mid: Column, high: Column) -> DataFrame:
    """Predictions in the common schema: nothing below zero, quantiles in order."""
    a, b, c = sorted_quantiles(low, mid, high)
    return rows.withColumns({"model": F.lit(model), "y_pred": F.greatest(point, F.lit(0.0)), "q10": a, "q50": b, "q90": c}).select(*PREDICTION)


def tidied(paths: DataFrame, levels: list[float]) -> DataFrame:
    """One row per horizon of trajectories (``quantiles``: an array of values at ``levels`` per horizon, ``actual``), targets a step apart.

    Of the levels those nearest to 0.1, 0.5 and 0.9 are taken, the middle one as point forecast.
    """
    nearest = [min(range(len(levels)), key=lambda i: abs(levels[i] - want)) for want in (0.1, 0.5, 0.9)]
    steps = paths.select("*", F.posexplode("quantiles").alias("_at", "_q")).withColumn("horizon", F.col("_at") + 1)
    steps = steps.withColumns({"target": F.col("origin") + F.col("horizon"), "y_true": F.get("actual", F.col("_at")), **{c: F.get("_q", F.lit(i)) for c, i in zip(("q10", "q50", "q90"), nearest)}})
    return steps.withColumn("y_pred", F.col("q50")).drop("quantiles", "actual", "_at", "_q")


class ElasticNet:
    """Linear model with an elastic-net penalty on encoded features."""

    def __init__(self, features: list[str], alpha: float = 0.001, l1_ratio: float = 0.2, iterations: int = 200):
        self.features, self.alpha, self.l1_ratio, self.iterations = features, alpha, l1_ratio, iterations

    def fit(self, train: DataFrame) -> "ElasticNet":
        self.assembler = VectorAssembler(inputCols=self.features, outputCol="_x")
        learner = LinearRegression(featuresCol="_x", labelCol="y_true", predictionCol="_p", regParam=self.alpha, elasticNetParam=self.l1_ratio, maxIter=self.iterations, standardization=False)
        self.model = learner.fit(self.assembler.transform(train))
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        p = F.col("_p")
        return prediction_frame(self.model.transform(self.assembler.transform(rows)), "elastic_net", p, p, p, p)


    def save(self, path: str) -> None:
        """Writes the fitted model under ``path``, anywhere Spark writes to."""
        self.model.write().overwrite().save(f"{path}/model")
        _meta(path, self.features)

    @classmethod
    def load(cls, path: str) -> "ElasticNet":
        from pyspark.ml.regression import LinearRegressionModel

        own = cls(_features(path))
        own.assembler, own.model = VectorAssembler(inputCols=own.features, outputCol="_x"), LinearRegressionModel.load(f"{path}/model")
        return own


def _meta(path: str, features: list[str]) -> None:
    from pyspark.sql import SparkSession

    SparkSession.getActiveSession().createDataFrame([(i, f) for i, f in enumerate(features)], "place int, feature string").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def _features(path: str) -> list[str]:
    from pyspark.sql import SparkSession

    return [r.feature for r in SparkSession.getActiveSession().read.parquet(f"{path}/features").orderBy("place").collect()]


class BoostedQuantiles:
    """Boosted trees of least absolute error for the point, empirical residual quantiles per horizon around it.

    Spark's trees have no quantile loss: the interval comes from the residuals of a validation frame.
    """

    def __init__(self, features: list[str], iterations: int = 20, depth: int = 5, seed: int = 2026):
        self.features, self.iterations, self.depth, self.seed = features, iterations, depth, seed

    def fit(self, train: DataFrame, validation: DataFrame) -> "BoostedQuantiles":
        self.assembler = VectorAssembler(inputCols=self.features, outputCol="_x")
        both = train.withColumn("_v", F.lit(False)).unionByName(validation.withColumn("_v", F.lit(True)))
        learner = GBTRegressor(featuresCol="_x", labelCol="y_true", predictionCol="_p", lossType="absolute", maxIter=self.iterations, maxDepth=self.depth, seed=self.seed, validationIndicatorCol="_v")
        self.model = learner.fit(self.assembler.transform(both))
        left = self.model.transform(self.assembler.transform(validation)).select("horizon", (F.col("y_true") - F.col("_p")).alias("_r"))
        self.residuals = linear_quantiles(left, ["horizon"], "_r", {"_lo": 0.1, "_mid": 0.5, "_hi": 0.9})
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        p = F.col("_p")
        out = self.model.transform(self.assembler.transform(rows)).join(F.broadcast(self.residuals), "horizon", "left")
        return prediction_frame(out, "boosted_trees", p, *(p + F.coalesce(f"_{n}", F.lit(0.0)) for n in ("lo", "mid", "hi")))

    def save(self, path: str) -> None:
        """Writes model and residual quantiles under ``path``, anywhere Spark writes to."""
        self.model.write().overwrite().save(f"{path}/model")
        self.residuals.coalesce(1).write.mode("overwrite").parquet(f"{path}/residuals")
        _meta(path, self.features)

    @classmethod
    def load(cls, path: str) -> "BoostedQuantiles":
        from pyspark.ml.regression import GBTRegressionModel
        from pyspark.sql import SparkSession

        own = cls(_features(path))
        own.assembler, own.model = VectorAssembler(inputCols=own.features, outputCol="_x"), GBTRegressionModel.load(f"{path}/model")
        own.residuals = SparkSession.getActiveSession().read.parquet(f"{path}/residuals")
        return own

    def importances(self) -> list[tuple[str, float]]:
        return sorted(zip(self.features, self.model.featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))


def permutation_importance(predict, rows: DataFrame, features: list[str], seed: int = 7) -> DataFrame:
    """(``feature``, ``hp_type``, ``contribution``): how much the error grows with the feature's values dealt anew.

    Rows of a type fall into parts of some 65,536 by a hash, each in another hash's order, and every row takes the
    feature's value of the row before it: one shuffle for all features, no row leaves the executors.
    """
    key = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), "household_id", "origin", "horizon")
    parts = Window.partitionBy("hp_type", F.pmod(key("part"), F.lit(max(1, rows.count() >> 16))))
    before, every = parts.orderBy(key("order"), "household_id", "origin", "horizon"), parts.orderBy(key("order"), "household_id", "origin", "horizon").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = rows.withColumns({f"_dealt_{f}": F.when(F.row_number().over(before) == 1, F.last(f).over(every)).otherwise(F.lag(f).over(before)) for f in features})
    error = lambda df, name: predict(df).groupBy("hp_type").agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias(name))
    base, out = error(rows, "_base"), None
    for f in features:
        worse = error(dealt.withColumn(f, F.col(f"_dealt_{f}")), "_worse")
        part = worse.join(base, "hp_type").select(F.lit(f).alias("feature"), "hp_type", (F.col("_worse") - F.col("_base")).alias("contribution"))
        out = part if out is None else out.unionByName(part)
    return out
