"""Bootstrap intervals and paired tests over household clusters, with reproducible draw tables.

A draw is a hash of seed, replicate and slot, so any engine repeats it. Rows are summed per household (and
day) before they meet the draws; replicates times households is all that is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import draw
from tidepanel.operators.grid import ID


def day_table(predictions: DataFrame, groups: list[str], day: str, values: dict) -> DataFrame:
    """Sums of ``values`` and ``n`` per group, household and day."""
    return predictions.groupBy(*groups, ID, day).agg(*(F.sum(c).alias(n) for n, c in values.items()), F.count("*").alias("n"))


def ratio_draws(days: DataFrame, groups: list[str], day: str, values: list[str], repetitions: int, seed: int, nested: bool = False) -> DataFrame:
    """(group, ``rep``, values): in each replicate the ratio of sums over households drawn with replacement.

    ``nested`` draws each drawn household's days anew, too.
    """
    per_house = days.groupBy(*groups, ID).agg(*(F.sum(c).alias(c) for c in [*values, "n"]))
    w = Window.partitionBy(*groups)
    houses = per_house.withColumns({"_h": F.row_number().over(w.orderBy(ID)) - 1, "_size": F.count("*").over(w)})
    slots = houses.select(*groups, F.col("_h").alias("slot"), "_size").select("*", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("rep"))
    label = [F.coalesce(F.col(g).cast("string"), F.lit("")) for g in groups]
    drawn = slots.withColumn("_h", F.pmod(draw(seed, *label, F.col("rep").cast("string"), F.col("slot").cast("string")), F.col("_size")).cast("int"))
    if nested:
        v = Window.partitionBy(*groups, ID)
        nth = days.withColumns({"_d": F.row_number().over(v.orderBy(day)) - 1, "_days": F.count("*").over(v)}).join(houses.select(*groups, ID, "_h"), [*groups, ID])
        chosen = drawn.join(nth.groupBy(*groups, "_h").agg(F.max("_days").alias("_days")), [*groups, "_h"])
        chosen = chosen.select(*groups, "rep", "slot", "_h", "_days", F.explode(F.sequence(F.lit(0), (F.col("_days") - 1).cast("int"))).alias("dayslot"))
        chosen = chosen.withColumn("_d", F.pmod(draw(seed + 1, *label, F.col("rep").cast("string"), F.col("slot").cast("string"), F.col("dayslot").cast("string")), F.col("_days")).cast("int"))
        joined = chosen.drop("_days").join(nth.drop("_days", ID, day), [*groups, "_h", "_d"])
    else:
        joined = drawn.drop("_size").join(houses.drop("_size", ID), [*groups, "_h"])
    return joined.groupBy(*groups, "rep").agg(*((F.sum(c) / F.sum("n")).alias(c) for c in values))


def intervals(draws: DataFrame, groups: list[str], value: str, confidence: float = 0.95) -> DataFrame:
    a = (1 - confidence) / 2
    return draws.groupBy(*groups).agg(F.percentile(value, F.lit(a)).alias(f"{value}_ci_low"), F.percentile(value, F.lit(1 - a)).alias(f"{value}_ci_high"))


def metric_intervals(predictions: DataFrame, groups: list[str], day: str, repetitions: int = 1000, seed: int = 2026, nested: bool = False, reliable: int = 20) -> DataFrame:
    """MAE and coverage with percentile intervals per group; ``cluster_inference_reliable`` needs enough households."""
    values = {"mae": F.abs(F.col("y_true") - F.col("y_pred")), "picp": F.col("y_true").between(F.col("q10"), F.col("q90")).cast("double")}
    days = day_table(predictions, groups, day, values)
    draws = ratio_draws(days, groups, day, list(values), repetitions, seed, nested)
    point = days.groupBy(*groups).agg((F.sum("mae") / F.sum("n")).alias("mae"), (F.sum("picp") / F.sum("n")).alias("picp"), F.count_distinct(ID).alias("n_households"), F.sum("n").alias("n_rows"))
    out = point.join(intervals(draws, groups, "mae"), groups).join(intervals(draws, groups, "picp"), groups)
    return out.withColumn("cluster_inference_reliable", F.col("n_households") >= reliable)


def paired(predictions: DataFrame, pairs: list[tuple[str, str]], strata: list[str], keys: list[str]) -> DataFrame:
    """(strata, keys, ``candidate``, ``comparator``, ``delta``): differences of absolute errors on rows that both models have."""
    models = sorted({m for p in pairs for m in p})
    wide = predictions.where(F.col("model").isin(models)).groupBy(*strata, *keys).pivot("model", models).agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))))
    cells = F.array(*(F.struct(F.lit(a).alias("candidate"), F.lit(b).alias("comparator"), (F.col(a) - F.col(b)).alias("delta")) for a, b in pairs))
    return wide.select(*strata, *keys, F.explode(cells).alias("_p")).select(*strata, *keys, "_p.*").where("delta IS NOT NULL")


def paired_test(deltas: DataFrame, strata: list[str], day: str, repetitions: int = 1000, seed: int = 2026, nested: bool = False, reliable: int = 20, smoothed: bool = True) -> DataFrame:
    """Mean difference with a percentile interval and a two-sided bootstrap p-value per stratum and pair of models."""
    groups = [*strata, "candidate", "comparator"]
    days = day_table(deltas, groups, day, {"mae_delta": F.col("delta")})
    draws = ratio_draws(days, groups, day, ["mae_delta"], repetitions, seed, nested)
    add = 1 if smoothed else 0
    low, high, n = F.count_if(F.col("mae_delta") <= 0), F.count_if(F.col("mae_delta") >= 0), F.count("*")
    tests = draws.groupBy(*groups).agg(
        F.percentile("mae_delta", F.lit(0.025)).alias("mae_delta_ci_low"), F.percentile("mae_delta", F.lit(0.975)).alias("mae_delta_ci_high"),
        F.least(F.lit(1.0), 2 * F.least((low + add) / (n + add), (high + add) / (n + add))).alias("bootstrap_p_value_two_sided"), F.avg((F.col("mae_delta") < 0).cast("double")).alias("probability_better"),
    )
    point = days.groupBy(*groups).agg((F.sum("mae_delta") / F.sum("n")).alias("mae_delta"), F.count_distinct(ID).alias("n_households"))
    return point.join(tests, groups).withColumn("cluster_inference_reliable", F.col("n_households") >= reliable)


def block_draws(blocks: DataFrame, groups: list[str], order: list[str], value: str, repetitions: int, seed: int) -> DataFrame:
    """(group, ``rep``, value): unweighted means of blocks drawn with replacement."""
    w = Window.partitionBy(*groups)
    ranked = blocks.withColumns({"_b": F.row_number().over(w.orderBy(*order)) - 1, "_size": F.count("*").over(w)})
    label = [F.coalesce(F.col(g).cast("string"), F.lit("")) for g in groups]
    slots = ranked.select(*groups, F.col("_b").alias("slot"), "_size", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("rep"))
    drawn = slots.withColumn("_b", F.pmod(draw(seed, *label, F.col("rep").cast("string"), F.col("slot").cast("string")), F.col("_size")).cast("int"))
    return drawn.select(*groups, "rep", "_b").join(ranked.select(*groups, "_b", value), [*groups, "_b"]).groupBy(*groups, "rep").agg(F.avg(value).alias(value))


def holm(tests: DataFrame, p: str = "bootstrap_p_value_two_sided", family=("candidate", "comparator"), alpha: float = 0.05) -> DataFrame:
    """Step-down corrected p-values within each family (null p-values aside), flags and the effect's direction."""
    some = F.col(p).isNotNull()
    w = Window.partitionBy(*family, some).orderBy(p)
    whole = Window.partitionBy(*family, some)
    ranked = tests.withColumn("_r", F.row_number().over(w)).withColumn("_m", F.count("*").over(whole))
    step = ranked.withColumn("_a", (F.col("_m") - F.col("_r") + 1) * F.col(p))
    adjusted = F.least(F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))
    out = step.withColumn("holm_p_value", F.when(some, adjusted)).withColumn("significant_holm", F.coalesce(F.col("holm_p_value") < alpha, F.lit(False)))
    sure = F.coalesce(F.col("cluster_inference_reliable"), F.lit(False)) if "cluster_inference_reliable" in tests.columns else F.lit(True)
    direction = F.when(F.col("mae_delta") < 0, "candidate_better").when(F.col("mae_delta") > 0, "candidate_worse").otherwise("tie")
    return out.withColumn("confirmatory_holm", F.col("significant_holm") & sure).withColumn("effect_direction", direction).drop("_r", "_m", "_a")
