"""Household- and time-disjoint splits and deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import draw
from tidepanel.operators.grid import ID


def hold_out(households: DataFrame, fraction: float, seed: int, stratum: str = "hp_type") -> DataFrame:
    """Adds ``held``: ceil(fraction n) households, shared among strata by largest remainder, drawn by hash.

    Strata count only if there is more than one and each has two households at least.
    """
    sizes = households.groupBy(F.coalesce(F.col(stratum), F.lit("unknown")).alias("_s")).agg(F.count("*").alias("_n"))
    everything = Window.partitionBy(F.lit(1))
    sizes = sizes.withColumn("_split", (F.count("*").over(everything) > 1) & (F.min("_n").over(everything) >= 2)).withColumn("_all", F.sum("_n").over(everything))
    total = F.ceil(F.col("_all") * F.lit(fraction) - 1e-9)
    exact = total * F.col("_n") / F.col("_all")
    sizes = sizes.withColumns({"_total": total, "_base": F.floor(exact), "_rest": exact - F.floor(exact)})
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("_rest").desc(), "_s")
    spare = F.col("_total") - F.sum("_base").over(everything)
    sizes = sizes.withColumn("_quota", F.col("_base") + (F.row_number().over(order) <= spare).cast("long"))
    named = households.withColumn("_s", F.coalesce(F.col(stratum), F.lit("unknown"))).join(sizes, "_s")
    named = named.withColumns({"_part": F.when(F.col("_split"), F.col("_s")).otherwise(""), "_take": F.when(F.col("_split"), F.col("_quota")).otherwise(F.col("_total"))})
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(draw(seed, F.col(ID).cast("string")), ID))
    return named.withColumn("held", nth <= F.col("_take")).select(*households.columns, "held")


def stratified_split(households: DataFrame, test: float = 0.2, validation: float = 0.1, seed: int = 2026) -> DataFrame:
    """Adds ``role``: train, unseen_validation or unseen_test."""
    first = hold_out(households, test, seed)
    rest = hold_out(first.where("NOT held").drop("held"), min(validation / max(1 - test, 1e-9), 0.5), seed + 1)
    tested = first.where("held").drop("held").withColumn("role", F.lit("unseen_test"))
    return rest.withColumn("role", F.when(F.col("held"), "unseen_validation").otherwise("train")).drop("held").unionByName(tested)


def cutoffs(spans: DataFrame, train: float = 0.7, calibration: float = 0.15, start: str = "start", end: str = "end") -> DataFrame:
    """One row: ``global_start``, ``global_end``, ``train_end``, ``calibration_end`` as fractions of the whole span."""
    ends = spans.agg(F.min(start).alias("global_start"), F.max(end).alias("global_end"))
    span = F.col("global_end") - F.col("global_start")
    return ends.withColumn("train_end", F.col("global_start") + train * span).withColumn("calibration_end", F.col("train_end") + calibration * span)


def rolling_cutoffs(spans: DataFrame, folds: int, validation: float = 0.1) -> DataFrame:
    """One row per fold: training up to 55 % and more of the span, then ``validation`` of it."""
    ends = spans.agg(F.min("start").alias("s"), F.max("end").alias("e"))
    fold = ends.select("s", "e", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    span = F.col("e") - F.col("s")
    fold = fold.withColumn("train_end", F.col("s") + (0.55 + F.col("fold") * (0.25 / max(folds - 1, 1))) * span)
    return fold.select("fold", "train_end", F.least(F.col("train_end") + validation * span, F.col("e")).alias("evaluation_end"))


def split_label(origin: Column, train_end: Column, calibration_end: Column, role: Column) -> Column:
    """By the origin's time; a held-out household's role goes before that."""
    by_time = F.when(origin <= train_end, "train").when(origin <= calibration_end, "calibration").otherwise("seen_test")
    return F.when(role == "unseen_test", "unseen_test").when(role == "unseen_validation", "unseen_validation").otherwise(by_time)


def capped_sample(df: DataFrame, stratum: str, per_stratum: int, overall: int, seed: int, keys: list[str]) -> DataFrame:
    """At most ``per_stratum`` rows of each stratum and ``overall`` in all, in the order of a hash of ``keys``."""
    key = draw(seed, *(F.col(k).cast("string") for k in keys))
    ranked = df.withColumn("_k", key)
    w = Window.partitionBy(stratum).orderBy("_k", *keys)
    kept = ranked.withColumn("_r", F.row_number().over(w)).where(f"_r <= {per_stratum}").drop("_r")
    return kept.orderBy("_k", *keys).limit(overall).drop("_k")


def model_sample(df: DataFrame, split: str, per_household: int, per_stratum: int, overall: int, seed: int, keys: list[str], stratum: str = "horizon") -> DataFrame:
    """One split's rows: capped per household, then per stratum, then in all. Raises if the split is empty."""
    rows = df.where(F.col("split") == split)
    if rows.isEmpty():
        raise ValueError(f"no rows in split {split}")
    w = Window.partitionBy(ID).orderBy(draw(seed, *(F.col(k).cast("string") for k in keys)), *keys)
    kept = rows.withColumn("_h", F.row_number().over(w)).where(f"_h <= {per_household}").drop("_h")
    return capped_sample(kept, stratum, per_stratum, overall, seed, keys)


def explanation_sample(df: DataFrame, per_household: int, per_type: int, seed: int, keys: list[str]) -> DataFrame:
    """Test rows capped per household and then per type, in the order of a hash."""
    k = draw(seed, *(F.col(c).cast("string") for c in keys))
    rows = df.where(F.col("split").isin("seen_test", "unseen_test")).withColumn("_k", k)
    for group, most in ((ID, per_household), ("hp_type", per_type)):
        w = Window.partitionBy(group).orderBy("_k", *keys)
        rows = rows.withColumn("_r", F.row_number().over(w)).where(f"_r <= {most}").drop("_r")
    return rows.drop("_k")


def sample_portfolios(households: DataFrame, sizes: list[int], repetitions: int, seed: int = 2026, types=("ASHP", "GSHP", "mixed")) -> DataFrame:
    """(``portfolio_id``, ``cohort``, ``portfolio_type``, ``portfolio_size``, ``repetition``, household): draws without replacement.

    ``households`` has ``cohort``, ``hp_type`` and the household. Mixed portfolios take half, rounded up, from
    ASHP. Sizes that a cohort can't fill are left out. Each (portfolio, type) ranks only its own candidates.
    """
    spark = households.sparkSession
    quotas = [(t, s, r, h, q) for t in types for s in sizes for r in range(repetitions) for h, q in ((("ASHP", -(-s // 2)), ("GSHP", s // 2)) if t == "mixed" else ((t, s),)) if q]
    spec = F.broadcast(spark.createDataFrame(quotas, "portfolio_type string, portfolio_size int, repetition int, hp_type string, quota int"))
    pool = households.withColumn("_have", F.count("*").over(Window.partitionBy("cohort", "hp_type"))).join(spec, "hp_type")
    key = ["cohort", "portfolio_type", "portfolio_size", "repetition"]
    order = Window.partitionBy(*key, "hp_type").orderBy(draw(seed, *(F.col(k).cast("string") for k in key), F.col(ID).cast("string")), ID)
    chosen = pool.where("_have >= quota").withColumn("_r", F.row_number().over(order)).where("_r <= quota")
    whole = chosen.withColumn("_n", F.count("*").over(Window.partitionBy(*key))).where("_n = portfolio_size")
    name = F.concat_ws("_", "cohort", "portfolio_type", F.col("portfolio_size").cast("string"), F.lpad(F.col("repetition").cast("string"), 3, "0"))
    return whole.select(name.alias("portfolio_id"), *key, ID)
