"""Column expressions shared by the operators. Missing values are NULL; NaN and infinities count as missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """``c`` as a double, NULL where it is NaN or infinite."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def numeric(c: Column) -> Column:
    """Text to a finite double, NULL where it isn't a number."""
    return finite(c.try_cast("double"))


def isclose(a: Column, b: Column | float, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    b = b if isinstance(b, Column) else F.lit(float(b))
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def micros(ts: str) -> Column:
    """Microseconds since 1970 of the timestamp (without time zone) that the SQL expression ``ts`` gives."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def rounded(c: Column, digits: int = 6) -> Column:
    """Cut after ``digits`` decimals, 0.37 of the last one added first.

    Means of decimal amounts often end on exactly half a digit; the odd offset keeps the result from hanging on
    the last bit of a sum, so engines that add in another order agree.
    """
    scale = float(10**digits)
    return F.floor(c * scale + 0.37) / scale


def sorted_quantiles(low: Column, mid: Column, high: Column) -> tuple[Column, Column, Column]:
    """Non-negative and in order, row by row."""
    zero = F.lit(0.0)
    three = F.array_sort(F.array(F.greatest(low, zero), F.greatest(mid, zero), F.greatest(high, zero)))
    return three[0], three[1], three[2]


def pinball(y: Column, q: Column, level: float) -> Column:
    return F.greatest(level * (y - q), (level - 1) * (y - q))


def crps(l10: Column, l50: Column, l90: Column) -> Column:
    """Twice the trapezoidal integral of three pinball losses over 0.1, 0.5 and 0.9."""
    return 0.4 * l10 + 0.8 * l50 + 0.4 * l90


def winkler(y: Column, low: Column, high: Column, alpha: float = 0.2) -> Column:
    zero = F.lit(0.0)
    return (high - low) + 2 / alpha * F.greatest(low - y, zero) + 2 / alpha * F.greatest(y - high, zero)


def interval_score(y: Column, mid: Column, low: Column, high: Column, alpha: float = 0.2) -> Column:
    """Weighted interval score of one interval and the median."""
    return (0.5 * F.abs(y - mid) + alpha / 2 * winkler(y, low, high, alpha)) / 1.5


def upper_rank(n: Column, p: float) -> Column:
    """1-based rank of the conservative finite-sample quantile: the level ceil((n+1)p)/n, taken 'higher'."""
    k = F.ceil((n + 1) * F.lit(p) - 1e-9)
    return F.when(k < n, k + 1).otherwise(n)


def lower_rank(n: Column, half: float) -> Column:
    """1-based rank of the lower variant: the level floor((n+1)half)/n, taken 'lower'."""
    return F.greatest(F.floor((n + 1) * F.lit(half) + 1e-9), F.lit(1))


def rank_values(df: DataFrame, groups: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """One row per group: the ``value`` at each of ``ranks`` (expressions of the group's row count ``n``), and ``n``.

    Exact without sorting a group: values are counted in narrow buckets, combined before the shuffle; prefix
    sums find the buckets that hold the ranks, and only their rows are ranked, if they differ at all. Null keys
    are a group. Buckets are those of magnitudes: asinh itself cancels to noise below zero.
    """
    width = F.asinh(F.abs(F.col(value)) * 1e6) * 64
    rows = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).alias("_v"), F.floor(F.when(F.col(value) < 0, -width).otherwise(width)).alias("_b"))
    counts = rows.groupBy(*groups, "_b").agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    w = Window.partitionBy(*(groups or [F.lit(1)]))
    reached = counts.withColumns({"n": F.sum("_c").over(w), "_before": F.coalesce(F.sum("_c").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    wanted = reached.withColumn("_w", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items()))))
    edge = wanted.where((F.col("_before") < F.col("_w.rank")) & (F.col("_w.rank") <= F.col("_before") + F.col("_c")))
    alike = edge.where("_lo = _hi").select(*groups, "n", F.col("_w.name").alias("_name"), F.col("_lo").alias("_v"))
    mixed = edge.where("_lo <> _hi").select(*(F.col(g).alias(f"_{g}") for g in groups), F.col("_b").alias("_eb"), "n", F.col("_w.name").alias("_name"), (F.col("_w.rank") - F.col("_before")).alias("_need"))
    same = all_of([F.col("_b") == F.col("_eb"), *(F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups)])
    within = Window.partitionBy(*groups, "_name").orderBy("_v")
    inside = rows.join(mixed, same).withColumn("_nth", F.row_number().over(within)).where("_nth = _need").select(*groups, "n", "_name", "_v")
    found = alike.unionByName(inside).groupBy(*groups).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("_name") == k, F.col("_v"))).alias(k) for k in ranks))
    return found.select(*groups, *ranks, "n").where("n IS NOT NULL")


def rank_quantile(df: DataFrame, groups: list[str], value: str, rank: Column, name: str) -> DataFrame:
    """:func:`rank_values` of one rank."""
    return rank_values(df, groups, value, {name: rank})


def linear_quantiles(df: DataFrame, groups: list[str], value: str, levels: dict[str, float]) -> DataFrame:
    """One row per group: linearly interpolated quantiles of ``value``, exact and without a group in one task."""
    place = lambda p: (F.col("n") - 1) * F.lit(p)
    ranks = {f"_{end}_{k}": r(place(p)) + 1 for k, p in levels.items() for end, r in (("low", F.floor), ("high", F.ceil))}
    between = lambda k, p: F.col(f"_low_{k}") + (F.col(f"_high_{k}") - F.col(f"_low_{k}")) * (place(p) - F.floor(place(p)))
    return rank_values(df, groups, value, ranks).select(*groups, *(between(k, p).alias(k) for k, p in levels.items()))


def linear_quantile(df: DataFrame, groups: list[str], value: str, level: float, name: str) -> DataFrame:
    return linear_quantiles(df, groups, value, {name: level})


def thin(df: DataFrame, groups: list[str], order: list[str | Column], quota: Column | int) -> DataFrame:
    """At most ``quota`` rows of each group, evenly spread in ``order``: places int(j (n-1)/(m-1)) for j < m, the last one n-1."""
    w = Window.partitionBy(*groups)
    m = quota if isinstance(quota, Column) else F.lit(quota)
    ranked = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w)).withColumn("_m", m.cast("int"))
    step = (F.col("_n") - 1) / F.greatest(F.col("_m") - 1, F.lit(1))
    spots = F.transform(F.sequence(F.lit(0), F.greatest(F.col("_m") - 1, F.lit(0))), lambda j: F.when((j == F.col("_m") - 1) & (F.col("_m") > 1), F.col("_n") - 1).otherwise(F.floor(j * step)).cast("int"))
    keep = (F.col("_m") > 0) & ((F.col("_n") <= F.col("_m")) | F.array_contains(spots, F.col("_i")))
    return ranked.where(keep).drop("_i", "_n", "_m")


def draw(*parts: Column | str | int) -> Column:
    """A portable number in [0, 2^32) from a hash of the parts, for reproducible draws."""
    text = F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def last_value(c: Column | str, w) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def next_value(c: Column | str, back) -> Column:
    """The value at the row or the next one after it; the window ``back`` is in falling order.

    Spark adds up a frame that reaches to the end anew for each row, which is quadratic in the rows of a group; one from the start grows.
    """
    return last_value(c, back)


def all_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, flags)


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``; raises if two rows share ``keys`` (a join against it would multiply rows)."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"rows are not unique by {keys}")
    return df
