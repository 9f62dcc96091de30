"""Context and keys for findings under review, verdicts kept for a time, and what a review cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def context(lines: DataFrame, key: str, around: int = 30) -> DataFrame:
    """``context``: the numbered lines from ``around`` before to ``around`` after each line."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(-around, around)
    return lines.withColumn("context", F.array_join(F.collect_list(F.concat(F.col("line_no").cast("string"), F.lit(": "), F.col("line"))).over(w), "\n"))


def context_keys(lines: DataFrame, key: str, around: int = 10) -> DataFrame:
    """``context_key``: the first twelve hex digits of a hash of the lines around each."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(-around, around)
    return lines.withColumn("context_key", F.left(F.sha2(F.array_join(F.collect_list("line").over(w), "\n"), 256), F.lit(12)))


def header(lines: DataFrame, key: str, is_header: Column, most: int = 30) -> DataFrame:
    """Lines from the first on, ``most`` of them, as long as each is part of a header."""
    w = Window.partitionBy(key).orderBy("line_no")
    rows = lines.where(F.col("line_no") <= most).withColumn("__h", F.min(F.when(is_header, 1).otherwise(0)).over(w))
    return rows.where("__h = 1").drop("__h")


def cached(findings: DataFrame, verdicts: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Findings with the verdict of their context key, if it is no older than ``days``."""
    fresh = verdicts.where(F.col("created_at") >= F.date_sub(now, days))
    return findings.join(fresh, "context_key", "left")


def tally(verdicts: DataFrame, by: list[str]) -> DataFrame:
    is_ = lambda x: F.count_if(F.col("classification") == x)
    return verdicts.groupBy(*by).agg(is_("TP").alias("tp"), is_("FP").alias("fp"), is_("NI").alias("ni"), F.count("*").alias("total"))


def packages(verdicts: DataFrame) -> DataFrame:
    """(package, verdict, tp, fp, ni, total): a package is right to be reported if one finding is, open if one is, else clean (FP)."""
    sums = tally(verdicts, ["package"])
    return sums.withColumn("verdict", F.when(F.col("tp") > 0, "TP").when(F.col("ni") > 0, "NI").otherwise("FP"))


def settled(classification: Column, confidence: Column, least: float = 0.5) -> Column:
    """A verdict below ``least`` confidence needs investigation."""
    return F.when(confidence < least, "NI").otherwise(classification)


def within_budget(rows: DataFrame, cost: str, budget: float, order: list[str], by: str) -> DataFrame:
    """Rows taken one after another until their cost so far reaches the budget of their group."""
    spent = F.sum(cost).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.where(F.lit(True)).withColumn("__s", F.coalesce(spent, F.lit(0.0))).where(F.col("__s") < budget).drop("__s")
