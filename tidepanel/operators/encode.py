"""Numeric encoding fitted on training rows: sorted category codes, exact medians."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions.columns import finite


class TabularEncoder:
    """Learns categories and medians; ``transform`` gives the training schema to any frame."""

    def __init__(self, medians: dict[str, float], categories: dict[str, DataFrame], columns: list[str]):
        self.medians, self.categories, self.columns = medians, categories, columns

    @classmethod
    def fit(cls, train: DataFrame, columns: list[str]) -> "TabularEncoder":
        kinds = {f.name: f.dataType for f in train.schema}
        numeric = [c for c in columns if isinstance(kinds[c], (T.NumericType, T.BooleanType))]
        row = train.agg(*(F.median(finite(F.col(c).cast("double"))).alias(c) for c in numeric)).first() if numeric else None
        medians = {c: row[c] if row[c] is not None else 0.0 for c in numeric}
        codes = {}
        for c in columns:
            if c not in medians:
                distinct = train.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("_c")).distinct()
                codes[c] = distinct.select("_c", (F.row_number().over(Window.orderBy("_c")) - 1).cast("double").alias("_code"))
        return cls(medians, codes, columns)

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` and the encoded columns: unknown or missing categories -1, missing numbers and absent columns the median."""
        out = df
        for i, (c, codes) in enumerate(self.categories.items()):
            if c in df.columns:
                coded = codes.withColumnRenamed("_c", f"_c{i}").withColumnRenamed("_code", f"_code{i}")
                out = out.join(coded, F.col(c).cast("string") == F.col(f"_c{i}"), "left").withColumn(c, F.coalesce(f"_code{i}", F.lit(-1.0))).drop(f"_c{i}", f"_code{i}")
            else:
                out = out.withColumn(c, F.lit(-1.0))
        for c, m in self.medians.items():
            out = out.withColumn(c, F.coalesce(finite(F.col(c).cast("double")), F.lit(float(m))) if c in df.columns else F.lit(float(m)))
        return out.select(*keep, *self.columns)


def harmonise(train: DataFrame, *others: DataFrame, features: list[str]) -> list[DataFrame]:
    """All frames with the training frame's numeric features, missing ones at its medians; features it never has go."""
    row = train.agg(*(F.median(finite(F.col(c).cast("double"))).alias(c) for c in features)).first()
    known = [c for c in features if row[c] is not None]
    out = []
    for df in (train, *others):
        fixed = df.withColumns({c: F.coalesce(finite(F.col(c).cast("double")), F.lit(row[c])) if c in df.columns else F.lit(row[c]) for c in known})
        out.append(fixed.drop(*(c for c in features if c not in known)))
    return out
