"""Summaries and report frames over metric and portfolio tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.columns import finite
from tidepanel.operators.grid import ID

LABELS = {"persistence": "Persistence", "daily": "Daily seasonal", "weekly": "Weekly seasonal", "perfect_foresight": "Perfect foresight", "median": "Median", "conformal_upper_bound": "Upper bound", "reference_no_forecast": "No forecast"}


def label(c: Column, labels: dict[str, str] = LABELS) -> Column:
    """Mapped, else the words of the name capitalised."""
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[c]
    return F.coalesce(known, F.initcap(F.regexp_replace(c, "_", " ")))


def feature_label(c: Column) -> Column:
    """A readable name of a feature: prefixes off, words apart and capitalised."""
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(c, "^(cal|static|future|load|weather)_+", ""), "_+", " ")))


def weighted(df: DataFrame, groups: list[str], values: list[str], weight: str = "n") -> DataFrame:
    """Weighted means per group over the rows where a value is finite."""
    return df.groupBy(*groups).agg(*((F.sum(finite(F.col(v)) * F.col(weight)) / F.sum(F.when(finite(F.col(v)).isNotNull(), F.col(weight)))).alias(v) for v in values), F.sum(weight).alias(weight))


def winners(summary: DataFrame, strata: list[str], measures: list[str]) -> DataFrame:
    """The model with the least value of each measure per stratum, the first by name on ties."""
    return summary.groupBy(*strata).agg(*(x for m in measures for x in (F.min_by("model", F.struct(m, "model")).alias(f"best_{m}_model"), F.min(m).alias(f"best_{m}"))))


def calibration_audit(metrics: DataFrame, groups: list[str] = ["split"]) -> DataFrame:  # noqa: B006
    """Macro (plain) and micro (row-weighted) means of coverage and scores over cells, and the cells' models."""
    values = ("picp", "wis", "winkler", "mean_interval_width")
    macro = [F.avg(v).alias(f"macro_{v}") for v in values]
    micro = [(F.sum(F.col(v) * F.col("n")) / F.sum("n")).alias(f"micro_{v}") for v in values]
    return metrics.groupBy(*groups).agg(F.count("*").alias("cells"), F.sum("n").alias("rows"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"), *macro, *micro)


def sensitivity(table: DataFrame, levels: list[int]) -> DataFrame:
    """Per threshold and (type, size): how many cells have that many calibration origins, and whether all do."""
    spec = F.array(*map(F.lit, levels))
    rows = table.select("portfolio_type", "portfolio_size", "calibration_n", F.explode(spec).alias("min_samples"))
    valid = F.col("calibration_n") >= F.col("min_samples")
    return rows.groupBy("min_samples", "portfolio_type", "portfolio_size").agg(
        F.count("*").alias("cells"), F.count_if(valid).alias("valid_cells"), F.avg(valid.cast("double")).alias("valid_fraction"), F.every(valid).alias("reportable"),
        F.min("calibration_n").alias("min_n"), F.median("calibration_n").alias("median_n"), F.max("calibration_n").alias("max_n"),
    )


def test_summary(tests: DataFrame) -> DataFrame:
    s = F.col("significant_holm")
    return tests.agg(F.count("*").alias("tests"), F.count_if(s).alias("significant"), F.count_if(s & (F.col("mae_delta") < 0)).alias("better"), F.count_if(s & (F.col("mae_delta") > 0)).alias("worse"), F.count_if(F.col("confirmatory_holm")).alias("confirmatory"))


def portfolio_report(summary: DataFrame, groups: list[str]) -> DataFrame:
    """Origin-weighted reductions, events per 100 origins and the number of strata."""
    n = F.sum("n_origins")
    rate = lambda c: (100 * F.sum(c) / n).alias(f"{c}_per_100")
    return summary.groupBy(*groups).agg((F.sum(F.col("mean_peak_reduction") * F.col("n_origins")) / n).alias("mean_peak_reduction"), rate("missed_events"), rate("false_interventions"), rate("interventions"), n.alias("n_origins"), F.count_distinct("portfolio_id").alias("portfolios"))


def valid_pairs(table: DataFrame) -> DataFrame:
    """(type, size) all of whose cells are valid."""
    return table.groupBy("portfolio_type", "portfolio_size").agg(F.every("calibration_valid").alias("_v")).where("_v").drop("_v")


def cohort_table(households: DataFrame) -> DataFrame:
    """Households by cohort and type; the cohorts overlap, so they are united."""
    cohorts = {"all": F.lit(True), "train": F.col("role") == "train", "unseen": F.col("role") != "train"}
    parts = F.array(*(F.when(c, F.lit(n)) for n, c in cohorts.items()))
    rows = households.select(ID, "hp_type", F.explode(F.array_compact(parts)).alias("cohort"))
    return rows.groupBy("cohort").agg(F.count("*").alias("households"), F.count_if(F.col("hp_type") == "ASHP").alias("ashp"), F.count_if(F.col("hp_type") == "GSHP").alias("gshp"))


def importance(contributions: DataFrame, top: int) -> DataFrame:
    """The ``top`` features by mean absolute contribution over all types, with one column per type."""
    means = contributions.groupBy("feature", "hp_type").agg(F.avg(F.abs("contribution")).alias("importance"))
    best = means.groupBy("feature").agg(F.avg("importance").alias("overall")).orderBy(F.col("overall").desc(), "feature").limit(top)
    wide = means.groupBy("feature").pivot("hp_type", ["ASHP", "GSHP"]).agg(F.first("importance"))
    return best.join(wide, "feature")


def picp_matrix(metrics: DataFrame, horizons: list[int]) -> DataFrame:
    wide = metrics.groupBy("model", "split", "hp_type").pivot("horizon", horizons).agg(F.avg("picp"))
    return wide.withColumnsRenamed({str(h): f"h{h}" for h in horizons})
