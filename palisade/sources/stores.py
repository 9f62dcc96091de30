"""What scans remember: package versions that were scanned, and verdicts of reviews.  Tables in folders, so that any executor can write and read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

SCANNED = "name string, version string, integrity string"
VERDICT = "context_key string, classification string, confidence double, reasoning string, created_at date"


def _load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing was kept yet
        return spark.createDataFrame([], schema)


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """Package versions of the last scan; none before the first."""
    return _load(spark, path, SCANNED)


def keep_scanned(packages: DataFrame, path: str) -> None:
    """Remember the package versions of this scan, and forget those that are gone."""
    packages.select("name", "version", "integrity").distinct().write.mode("overwrite").parquet(path)


def verdicts(spark: SparkSession, path: str, today: Column, days: int = 30) -> DataFrame:
    """The latest verdict of each context key that is no older than ``days``; days that are over aren't read."""
    rows = _load(spark, path, VERDICT).where(F.col("created_at") >= F.date_sub(today, days))
    latest = F.max_by(F.struct("classification", "confidence", "reasoning"), F.struct("created_at", "classification", "confidence", "reasoning"))
    return rows.groupBy("context_key").agg(latest.alias("v"), F.max("created_at").alias("created_at")).select("context_key", "v.*", "created_at")


def keep_verdicts(rows: DataFrame, path: str) -> None:
    """Add verdicts, a folder for each day; findings without a key aren't kept."""
    names = [c.split()[0] for c in VERDICT.split(", ")]
    rows.where("context_key is not null").select(*names).write.mode("append").partitionBy("created_at").parquet(path)
