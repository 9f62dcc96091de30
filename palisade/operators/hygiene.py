"""Repository hygiene from listings and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules


def missing_policy(listing: DataFrame) -> DataFrame:
    """H001: projects of ``listing`` (project, path) without a security policy."""
    has = listing.groupBy("project").agg(F.bool_or(F.col("path").isin("SECURITY.md", ".github/SECURITY.md", "docs/SECURITY.md")).alias("has"))
    return has.where("not has").select("project", F.lit("H001").alias("rule_id"), F.lit("medium").alias("severity"))


def missing_ignores(projects: DataFrame, ignore_lines: DataFrame) -> DataFrame:
    """H002: patterns that a project's ignore file (project, line) lacks, with or without a slash before them."""
    needed = projects.select("project").distinct().withColumn("pattern", F.explode(F.array(*map(F.lit, rules.REQUIRED_IGNORES))))
    has = ignore_lines.select("project", F.regexp_replace(F.trim("line"), "^/", "").alias("pattern")).distinct()
    return needed.join(has, ["project", "pattern"], "left_anti").withColumn("rule_id", F.lit("H002")).withColumn("severity", F.lit("medium"))


def ignored_locks(locks: DataFrame, ignored: DataFrame) -> DataFrame:
    """H003, D001: lock files (project, path) that version control ignores."""
    return locks.join(ignored.select("project", "path").distinct(), ["project", "path"], "left_semi").withColumn("rule_id", F.explode(F.array(F.lit("H003"), F.lit("D001"))))


def unprotected(branches: DataFrame) -> DataFrame:
    """H004: default branches known not to be protected; an unknown state is no finding."""
    return branches.where("is_default and protected = false").select("project", F.lit("H004").alias("rule_id"), F.lit("medium").alias("severity"))
