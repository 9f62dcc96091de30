"""Rules on workflow files, line by line; state along a file is held by windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules


def unpinned(lines: DataFrame) -> DataFrame:
    """W001: actions used at anything but a commit."""
    use = F.regexp_extract("line", r"""uses:\s*["']?([^"'\s#]+)""", 1)
    rows = lines.withColumn("action", use).where((F.col("action") != "") & F.col("action").contains("@") & ~F.col("action").startswith("./") & ~F.col("action").startswith("docker://"))
    return rows.where(~F.col("action").rlike(r"@[0-9a-f]{40}$")).select("file", "line_no", "action", F.lit("W001").alias("rule_id"), F.lit("high").alias("severity"))


def permissions(lines: DataFrame) -> DataFrame:
    """W002: no permissions at column 0, or the first such line grants write-all."""
    top = lines.where(F.col("line").startswith("permissions:")).groupBy("file").agg(F.min_by("line", "line_no").alias("first"))
    files = lines.select("file").distinct().join(top, "file", "left")
    return files.where("first is null or first like '%write-all%'").select("file", F.when(F.col("first").isNull(), "missing").otherwise("write-all").alias("reason"), F.lit("W002").alias("rule_id"), F.lit("medium").alias("severity"))


def checkout_of_requests(lines: DataFrame) -> DataFrame:
    """W003: checkouts in files that run on pull_request_target."""
    flagged = lines.withColumn("target", F.bool_or(F.col("line").contains("pull_request_target")).over(Window.partitionBy("file")))
    rows = flagged.where(F.col("target") & F.col("line").contains("actions/checkout") & ~F.trim("line").startswith("#"))
    return rows.select("file", "line_no", F.lit("W003").alias("rule_id"), F.lit("critical").alias("severity"))


def run_lines(lines: DataFrame) -> DataFrame:
    """Lines that are a ``run:`` or lie in its block scalar.

    A block goes on while every line that isn't blank is indented more than its
    ``run:``; the least indent since then says so.
    """
    indent = F.length("line") - F.length(F.ltrim("line"))
    start = F.when(F.col("line").rlike(r"^\s*-?\s*run:"), F.col("line_no"))
    order = Window.partitionBy("file").orderBy("line_no")
    rows = lines.withColumn("indent", indent).withColumn("run", F.last(start, ignorenulls=True).over(order))
    own = F.when((F.col("line_no") != F.col("run")) & (F.trim("line") != ""), F.col("indent"))
    block = Window.partitionBy("file", "run").orderBy("line_no")
    rows = rows.withColumn("least", F.min(own).over(block)).withColumn("base", F.first("indent").over(block))
    return rows.where(F.col("run").isNotNull() & ((F.col("line_no") == F.col("run")) | F.col("least").isNull() | (F.col("least") > F.col("base")))).select("file", "line_no", "line")


def injections(lines: DataFrame) -> DataFrame:
    """W004: expressions that outsiders control, within a run."""
    has = lambda e: F.col("line").contains("${{ " + e) | F.col("line").contains("${{" + e)
    hits = F.array(*[F.when(has(e), F.lit(e)) for e in rules.INJECTABLE])
    rows = run_lines(lines).select("file", "line_no", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("expression"))
    return rows.select("file", "line_no", "expression", F.lit("W004").alias("rule_id"), F.lit("critical").alias("severity"))


def git_flags(lines: DataFrame) -> DataFrame:
    """W005: git without hooks, and pushes by force."""
    no_verify = F.col("line").rlike(r"git\s.*--no-verify")
    force = F.col("line").rlike(r"git\s+push\s.*--force(\s|$)")
    rows = lines.where(no_verify | force)
    return rows.select("file", "line_no", F.when(no_verify, "--no-verify").otherwise("--force").alias("flag"), F.lit("W005").alias("rule_id"), F.lit("medium").alias("severity"))


def pinned(lines: DataFrame, shas: DataFrame) -> DataFrame:
    """Lines with an action's reference replaced by its commit and kept as a comment; ``shas`` has (action, sha)."""
    used = unpinned(lines).select("file", "line_no", "action").join(F.broadcast(shas), "action")  # the actions of one repository's workflows
    rows = lines.join(used, ["file", "line_no"], "left")
    new = F.concat(F.replace("line", F.col("action"), F.concat(F.substring_index("action", "@", 1), F.lit("@"), F.col("sha"))), F.lit(" # "), F.substring_index("action", "@", -1))
    return rows.select("file", "line_no", F.coalesce(F.when(F.col("sha").isNotNull(), new), F.col("line")).alias("line"))
