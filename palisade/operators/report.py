"""Reports: roll-ups for people, JSON and SARIF for machines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules
from ..schema import ordinal, severity_name


def by_package(findings: DataFrame, order: list[str], rank: int = 3) -> DataFrame:
    """(package, n, severity, labels, first_places, suggestion): one row a package, its gravest severity and first places.

    Only the first ``rank`` places are gathered, so a package with a third of all
    findings costs its task no more memory than others.
    """
    w = Window.partitionBy("package").orderBy(*order)
    sums = findings.groupBy("package").agg(F.count("*").alias("n"), severity_name(F.max(ordinal("severity"))).alias("severity"), F.array_sort(F.collect_set("rule_id")).alias("labels"), F.min_by("suggestion", F.struct(*order)).alias("suggestion"))
    first = findings.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= rank)
    first = first.groupBy("package").agg(F.array_sort(F.collect_list(F.struct("__k", "place"))).alias("p")).select("package", F.col("p.place").alias("first_places"))
    return sums.join(first, "package")


def top_packages(findings: DataFrame, n: int = 8) -> DataFrame:
    """(package, n, severity): the ``n`` packages with the gravest, then the most findings."""
    sums = findings.groupBy("package").agg(F.count("*").alias("n"), F.max(ordinal("severity")).alias("o"))
    return sums.orderBy(F.desc("o"), F.desc("n"), "package").limit(n).select("package", "n", severity_name(F.col("o")).alias("severity"))


def executive(findings: DataFrame) -> DataFrame:
    """(category, n, critical, high, packages, reachable): the counts that a summary shows."""
    grave = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return findings.groupBy("category").agg(F.count("*").alias("n"), grave("critical"), grave("high"), F.countDistinct("package").alias("packages"), F.count_if("reachable").alias("reachable"))


def by_reach(findings: DataFrame) -> DataFrame:
    """(bucket, package, n): findings in what runs, and in what only builds."""
    bucket = F.when(F.col("reachable"), "runtime").otherwise("build").alias("bucket")
    return findings.groupBy(bucket, "package").agg(F.count("*").alias("n"))


def detection_matrix(samples: DataFrame) -> DataFrame:
    """(layer, detected, total, percent) of samples (layer, detected), and OVERALL."""
    out = samples.rollup("layer").agg(F.count_if("detected").alias("detected"), F.count("*").alias("total"))
    return out.select(F.coalesce("layer", F.lit("OVERALL")).alias("layer"), "detected", "total", (F.lit(100.0) * F.col("detected") / F.col("total")).alias("percent"))


def glossary(spark: SparkSession) -> DataFrame:
    """(rule_id, description) of the line rules."""
    return spark.createDataFrame([(r.id, r.description) for r in rules.LINE_RULES], "rule_id string, description string")


def explained(findings: DataFrame, glossary: DataFrame) -> DataFrame:
    """(rule_id, description, n, severity): the rules that findings broke, the gravest first; rules without an entry have no description."""
    sums = findings.groupBy("rule_id").agg(F.count("*").alias("n"), F.max(ordinal("severity")).alias("__o"))
    rows = sums.join(glossary, "rule_id", "left").orderBy(F.desc("__o"), "rule_id")
    return rows.select("rule_id", "description", "n", severity_name(F.col("__o")).alias("severity"))


def sarif_document(rules_: DataFrame, results: DataFrame, name: str = "palisade", version: str = "1") -> str:
    """A whole SARIF 2.1.0 document, for reports that a person reads: rules and results come to the driver."""
    listed = [{"id": r["rule_id"], "shortDescription": {"text": r["text"]}, "defaultConfiguration": {"level": r["level"]}} for r in rules_.orderBy("rule_id").collect()]
    found = [json.loads(r["json"]) for r in results.collect()]
    run = {"tool": {"driver": {"name": name, "version": version, "rules": listed}}, "results": found}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2)


def text_report(findings: DataFrame, order: list[str], most: int | None = None, width: int = 100) -> DataFrame:
    """(place, line): findings as lines of text, wrapped at ``width`` characters, the gravest first; ``most`` of them if that is given."""
    rows = findings.orderBy(F.desc(ordinal("severity")), *order)
    rows = rows if most is None else rows.limit(most)
    where = F.concat_ws(":", "file", F.col("line").cast("string"))
    line = F.concat_ws("  ", F.rpad(F.upper("severity"), 8, " "), F.rpad("rule_id", 10, " "), F.coalesce(F.nullif(where, F.lit("")), F.col("package"), F.lit("project")), "message")
    return rows.select(F.monotonically_increasing_id().alias("place"), wrapped(line, width).alias("line"))


def wrapped(text, width: int):
    """Text broken at spaces into lines of at most ``width`` characters, where words allow it."""
    return F.regexp_replace(F.regexp_replace(text, rf"(.{{1,{width - 1}}}\S)(?:\s+|$)", "$1\n"), r"\n$", "")


def sarif_level(severity):
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def sarif_rules(findings: DataFrame, order: list[str]) -> DataFrame:
    """(rule_id, level, text): a rule by its first finding, 100 characters of its message."""
    first = findings.groupBy("rule_id").agg(F.min_by(F.struct("severity", "message"), F.struct(*order)).alias("f"))
    return first.select("rule_id", sarif_level(F.col("f.severity")).alias("level"), F.left("f.message", F.lit(100)).alias("text"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """A JSON line for each result, null fields left out."""
    place = F.when(F.col("file").isNotNull(), F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("startLine"))).alias("region")).alias("physicalLocation"))))
    return findings.select(F.to_json(F.struct(F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"))).alias("json"))


def json_lines(findings: DataFrame) -> DataFrame:
    return findings.select(F.to_json(F.struct(*findings.columns)).alias("json"))


def scorecard(scores: list[tuple[str, float, float]], total: float, grade: str) -> str:
    """A text card of category scores (category, score, maximum)."""
    width = max([8, *(len(c) for c, _, _ in scores)])
    bars = [f"{c:<{width}}  {'#' * round(20 * s / m if m else 0):<20}  {s:5.1f}/{m:.0f}" for c, s, m in scores]
    return "\n".join([f"Grade {grade}  ({total:.0f}/100)", *bars])


def badge(grade: str) -> str:
    """An SVG badge of a grade."""
    colour = {"A": "#4c1", "B": "#97ca00", "C": "#dfb317", "D": "#fe7d37"}.get(grade, "#e05d44")
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="90" height="20"><rect width="90" height="20" rx="3" fill="#555"/><rect x="64" width="26" height="20" rx="3" fill="{colour}"/><g fill="#fff" font-family="sans-serif" font-size="11"><text x="8" y="14">security</text><text x="73" y="14">{grade}</text></g></svg>'
