"""Scores: categories with diminishing returns, their total, and a grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deductions(findings: DataFrame, order: list[str], by: str = "category") -> DataFrame:
    """``findings`` with ``multiplier``: what each takes off, in units of the category's base.

    The k-th medium and low finding of a category weigh less; a finding known not
    to be reachable weighs a tenth.  ``order`` puts findings of one severity in a
    total order, so that scores don't depend on how rows arrive.
    """
    k = F.row_number().over(Window.partitionBy(by, "severity").orderBy(*order)) - 1
    weight = F.when(F.col("severity") == "critical", 3.0).when(F.col("severity") == "high", 2.0).when(F.col("severity") == "medium", 1 / (1 + k * 0.1)).otherwise(0.3 / (1 + k * 0.15))
    return findings.withColumn("multiplier", weight * F.when(~F.coalesce(F.col("reachable"), F.lit(True)), 0.1).otherwise(1.0))


def category_scores(findings: DataFrame, categories: DataFrame, order: list[str], by: str = "category") -> DataFrame:
    """(category, n, score, max_score) for each row of ``categories`` (category, max_score); one without findings keeps its maximum."""
    sums = deductions(findings, order, by).groupBy(by).agg(
        F.count("*").alias("n"), F.sum("multiplier").alias("taken"), F.bool_or(F.col("severity").isin("critical", "high")).alias("grave")
    )
    raw = F.greatest(F.lit(0.0), F.col("max_score") - F.col("max_score") / (F.col("n") + 1) * F.col("taken"))
    floor = F.when(F.col("grave"), 0.0).otherwise(F.col("max_score") * 0.3)
    rows = categories.join(sums, by, "left")
    return rows.select(by, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(F.col("n").isNull(), F.col("max_score")).otherwise(F.greatest(raw, floor)).alias("score"), "max_score")


def grade(total: Column) -> Column:
    return F.when(total >= 90, "A").when(total >= 75, "B").when(total >= 60, "C").when(total >= 40, "D").otherwise("F")


def project_grade(scores: DataFrame) -> DataFrame:
    """(total, grade) over all categories; 100 without any."""
    total = F.when(F.coalesce(F.sum("max_score"), F.lit(0.0)) == 0, 100.0).otherwise(F.round(F.sum("score") / F.sum("max_score") * 100))
    return scores.agg(total.alias("total")).select("total", grade(F.col("total")).alias("grade"))


def visible(confidence: Column, least: int) -> Column:
    """Whether a persona that wants confidence ``least`` (0 low to 2 high) or more sees a finding; one without confidence always."""
    from ..schema import CONFIDENCES

    return confidence.isNull() | (F.array_position(F.array(*map(F.lit, CONFIDENCES)), confidence) - 1 >= least)
