"""Sources and sinks: semicolon files, Parquet, JSON and fingerprints, by paths that Spark reads."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.columns import finite
from tidepanel.operators.grid import dedup_last

LAYOUT = ("meta_data/households.csv", "meta_data/meta_data.csv", "smart_meter_data/overview/smart_meter_data_15min_overview.csv", "reports/protocols.csv", "smart_meter_data/15min", "weather_data/hourly")
TYPES = {"air-source": "ASHP", "ground-source": "GSHP"}


class SourceError(ValueError):
    """An input is missing or unreadable."""


def read_semicolon(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    reader = spark.read.option("sep", ";").option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def hp_type(survey: str = "Survey_HeatPump_Installation_Type"):
    """Survey answer to ASHP or GSHP, NULL for anything else; exact match."""
    return F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])[F.col(survey)]


class Adapter:
    """The raw folder as DataFrames. Readings of all households are one frame; nothing is read twice for metadata."""

    def __init__(self, spark: SparkSession, root: str, target: str = "kWh_received_HeatPump"):
        self.spark, self.root, self.target = spark, root.rstrip("/"), target
        missing = [p for p in LAYOUT if not _exists(spark, f"{self.root}/{p}")]
        if missing:
            raise SourceError(f"missing in {root}: {missing}")
        self._metadata: DataFrame | None = None

    def metadata(self) -> DataFrame:
        """Full outer join of both household files on the numeric id."""
        if self._metadata is None:
            left, right = (read_semicolon(self.spark, f"{self.root}/meta_data/{n}.csv") for n in ("households", "meta_data"))
            numbered = [d.withColumn("Household_ID", F.col("Household_ID").cast("string").try_cast("bigint")) for d in (left, right)]
            self._metadata = numbered[0].join(numbered[1], "Household_ID", "full").orderBy("Household_ID").cache()
        return self._metadata

    def overview(self) -> DataFrame:
        return read_semicolon(self.spark, f"{self.root}/{LAYOUT[2]}")

    def protocols(self) -> DataFrame:
        """Visits; dates that can't be read are null."""
        return read_semicolon(self.spark, f"{self.root}/reports/protocols.csv", "Report_ID string, Household_ID bigint, Visit_Date string").withColumn("Visit_Date", F.expr("try_to_timestamp(Visit_Date)"))

    def _series(self, folder: str, name: str) -> DataFrame:
        rows = read_semicolon(self.spark, f"{self.root}/{folder}").select("*", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("_file"), F.monotonically_increasing_id().alias("_row"))
        return rows.withColumn(name, F.regexp_replace("_file", r"\.csv$", "")).withColumn("Timestamp", F.expr("try_to_timestamp(cast(Timestamp as string))"))

    def meters(self) -> DataFrame:
        """All meter readings: unreadable times dropped, the last of repeated times kept, the target finite or null."""
        rows = self._series("smart_meter_data/15min", "_id").withColumn("Household_ID", F.col("_id").try_cast("bigint"))
        return dedup_last(rows.drop("_id", "_file"), ["Household_ID", "Timestamp"], "_row").drop("_row").withColumn(self.target, finite(F.col(self.target)))

    def weather(self) -> DataFrame:
        """All hourly weather, by ``Weather_ID`` as its file is named."""
        rows = self._series("weather_data/hourly", "_id").drop("Weather_ID", "_file").withColumnRenamed("_id", "Weather_ID")
        return dedup_last(rows, ["Weather_ID", "Timestamp"], "_row").drop("_row")

    def weather_by_household(self) -> DataFrame:
        """Each household's weather; ids that differ only as numbers (7, 7.0) match."""
        named = lambda c: F.coalesce(c.cast("string").try_cast("double").try_cast("bigint").cast("string"), c.cast("string"))
        houses = self.metadata().select("Household_ID", named(F.col("Weather_ID")).alias("_w"))
        return houses.join(self.weather().withColumn("_w", named(F.col("Weather_ID"))), "_w").drop("_w")


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> str:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return path


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns, or the named ones, each once."""
    df = spark.read.parquet(path)
    return df.select(*dict.fromkeys(columns)) if columns else df


def row_count(spark: SparkSession, path: str) -> int:
    """From an empty projection: Parquet footers suffice."""
    return spark.read.parquet(path).count()


def write_csv(df: DataFrame, path: str, digits: int | None = None) -> str:
    """One file, for tables of report size; with ``digits`` doubles are rounded."""
    if digits is not None:
        df = df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def atomic_json(data: dict, path: str) -> str:
    """Written beside and renamed, so readers never see half of it."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.tmp", "w") as f:
        json.dump(data, f, indent=2, sort_keys=True, default=str)
    os.replace(f"{path}.tmp", path)
    return path


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(``path``, ``bytes``, ``modified``, ``sha256``) of all files below a path, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
