"""Forecast origins and the rows of each origin's horizons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import thin
from tidepanel.operators.grid import ID, STEP, by_time


def positions(panel: DataFrame) -> DataFrame:
    """Adds ``pos``, the row's place in its series from 0, and ``len``."""
    return panel.withColumn("pos", (F.row_number().over(by_time()) - 1).cast("long")).withColumn("len", F.count("*").over(Window.partitionBy(ID)))


def valid_origins(panel: DataFrame, history: int, forecast: int, stride: int = 1, value: str = "y") -> DataFrame:
    """Rows from which a full past and future can be taken: ``panel`` with ``pos``, ``len``.

    The past ``history`` values (the row's included) may be imputed but not missing; the row itself and the
    ``forecast`` values after it were observed; past, row and end lie in one segment. Places run from
    ``history`` in steps of ``stride``.
    """
    w = by_time()
    p = positions(panel)
    first = F.lag("segment_id", history - 1).over(w)
    last = F.lead("segment_id", forecast).over(w)
    good = F.col(value).isNotNull().cast("int")
    seen = F.when(F.col(value).isNotNull() & (F.col("originally_missing") == 0), 1).otherwise(0)
    p = p.withColumns({
        "_past": F.sum(good).over(w.rowsBetween(1 - history, 0)),
        "_next": F.sum(seen).over(w.rowsBetween(1, forecast)),
        "_one": (first == F.col("segment_id")) & (last == F.col("segment_id")),
    })
    ok = F.col("_one") & (F.col("_past") == history) & (F.col("_next") == forecast) & (F.col("originally_missing") == 0)
    inside = (F.col("pos") >= history) & (F.col("pos") < F.col("len") - forecast) & (F.pmod(F.col("pos") - history, F.lit(stride)) == 0)
    return p.where(inside & ok).drop("_past", "_next", "_one")


def contained(panel: DataFrame, forecast: int) -> DataFrame:
    """Adds ``path_end``, the step of the last target of a forecast from the row (null where the series ends before)."""
    return panel.withColumn("path_end", F.lead(STEP, forecast).over(by_time()))


def clock_stratified(origins: DataFrame, groups: list[str], hour: str, hours: list[int], most: int, order: str = STEP, exact: str | None = None) -> DataFrame:
    """At most ``most`` origins of each group, spread over the clock hours and evenly within each.

    The first hours get the rest of the division. What an hour can't fill is taken, evenly, from the group's
    other origins at these hours (``exact``: flag of origins on the full hour; others don't count).
    """
    base, extra = divmod(most, len(hours))
    pool = origins.where(F.col(hour).isin(hours) & (F.col(exact) if exact else F.lit(True)))
    quota = F.create_map(*[F.lit(x) for i, h in enumerate(hours) for x in (h, base + (i < extra))])[F.col(hour)]
    chosen = thin(pool, [*groups, hour], [order], quota)
    counts = chosen.groupBy(*groups).agg(F.count("*").alias("_have"))
    left = pool.join(chosen.select(*groups, order), [*groups, order], "left_anti").join(counts, groups, "left")
    refill = thin(left, groups, [order], F.lit(most) - F.coalesce("_have", F.lit(0))).drop("_have")
    return chosen.unionByName(refill.select(chosen.columns))


def supervised(panel: DataFrame, origins: DataFrame, horizons: list[int], season: int = 96, week: int = 672, value: str = "y", keep: tuple[str, ...] = (), future: tuple[str, ...] = ()) -> DataFrame:
    """One row per origin and horizon: ``origin``, ``target``, ``y_true``, the naive forecasts, ``keep`` at the origin and ``future`` columns at the target.

    Thin the origins first: rows are origins times horizons. All look-ups are equi-joins on (series, place)
    and share the panel's partitioning by series.
    """
    p = positions(panel)
    rows = origins.select(ID, "hp_type", "segment_id", "pos", F.col(STEP).alias("origin"), F.col(value).alias("baseline_persistence"), *keep)
    rows = rows.select("*", F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    rows = rows.withColumns({"_t": F.col("pos") + F.col("horizon"), "_d": F.col("pos") + F.col("horizon") - season, "_w": F.col("pos") + F.col("horizon") - week})
    at = lambda k, name: p.select(ID, F.col("pos").alias(k), F.col(value).alias(name))
    targets = p.select(ID, F.col("pos").alias("_t"), F.col(STEP).alias("target"), F.col(value).alias("y_true"), *(F.col(c).alias(f"future__{c}") for c in future))
    out = rows.join(targets, [ID, "_t"]).join(at("_d", "baseline_daily"), [ID, "_d"], "left").join(at("_w", "baseline_weekly"), [ID, "_w"], "left")
    return out.drop("_t", "_d", "_w").withColumn("horizon_sqrt", F.sqrt(F.col("horizon").cast("double")))


def latest_sequence(rows: DataFrame, cutoff: int, least: int, most: int) -> DataFrame:
    """Of each household, the last ``max(most, least)`` rows up to ``cutoff`` of the sequence that ends last and has at least ``least``."""
    seen = rows.where(F.col(STEP) <= cutoff)
    ends = seen.groupBy(ID, "sequence_id").agg(F.max(STEP).alias("_end"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    best = ends.groupBy(ID).agg(F.max_by("sequence_id", "_end").alias("sequence_id"))
    w = Window.partitionBy(ID).orderBy(F.col(STEP).desc())
    return seen.join(best, [ID, "sequence_id"]).withColumn("_r", F.row_number().over(w)).where(f"_r <= {max(most, least)}").drop("_r")


def fit_and_stop_blocks(block: DataFrame, encoder: int, prediction: int, fraction: float) -> DataFrame:
    """Adds ``role`` to the rows of one sequence per household: fitting, context of the early-stop block, early-stop targets.

    The last max(prediction, ceil(fraction n)) rows are targets of the early-stop block; the ``encoder`` rows
    before them also serve as its context (``context`` true).
    """
    w = Window.partitionBy(ID)
    held = F.greatest(F.lit(prediction), F.ceil(F.count("*").over(w) * F.lit(fraction) - 1e-9))
    nth = F.row_number().over(w.orderBy(STEP))
    cut = F.count("*").over(w) - held
    return block.withColumns({"role": F.when(nth > cut, "early_stop").otherwise("fit"), "context": (nth <= cut) & (nth > cut - encoder)})


def evaluation_windows(sequences: DataFrame, origins: DataFrame, encoder: int, prediction: int) -> DataFrame:
    """``encoder`` rows up to each origin and ``prediction`` after it, where they lie in one sequence without gaps."""
    nth = F.row_number().over(Window.partitionBy("sequence_id").orderBy(STEP))
    s = sequences.withColumn("_n", nth)
    at = s.join(origins.select(ID, F.col("origin").alias(STEP)), [ID, STEP]).select("sequence_id", F.col(STEP).alias("origin"), F.col("_n").alias("_o"))
    rows = at.select("*", F.explode(F.sequence(F.col("_o") - encoder + 1, F.col("_o") + prediction)).alias("_n"))
    joined = rows.join(s, ["sequence_id", "_n"])
    w = Window.partitionBy("sequence_id", "origin")
    whole = (F.count("*").over(w) == encoder + prediction) & (F.max(STEP).over(w) - F.min(STEP).over(w) == encoder + prediction - 1)
    return joined.withColumn("_ok", whole).where("_ok").drop("_ok", "_o", "_n")
