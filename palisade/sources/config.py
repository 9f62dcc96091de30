"""Project settings and user rules from TOML, read on the driver: a few small files."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Points of a category, and what scans keep by default.
WEIGHTS = {"workflows": 25, "deps": 20, "patterns": 10, "secrets": 25, "hygiene": 10, "capabilities": 10}


@dataclass
class Config:
    ignored_rules: list[str] = field(default_factory=list)
    allow: dict[str, list[str]] = field(default_factory=dict)
    skip_dirs: list[str] = field(default_factory=list)
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    max_findings: int = 50

    def allow_list(self, spark: SparkSession) -> DataFrame:
        """(package, rule_id) of allowed findings."""
        return spark.createDataFrame([(p, r) for p, rs in self.allow.items() for r in rs], "package string, rule_id string")

    def categories(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c, float(w)) for c, w in self.weights.items()], "category string, max_score double")


def parsed(text: str | None) -> Config:
    """A project's settings; without a file, or with one that can't be read, the defaults."""
    try:
        top = tomllib.loads(text or "")
    except tomllib.TOMLDecodeError:
        top = {}
    patterns, ignore = top.get("patterns", {}), top.get("ignore", {})
    return Config(ignore.get("patterns", []), patterns.get("allow", {}), patterns.get("skip_dirs", []), WEIGHTS | top.get("scoring", {}), top.get("triage", {}).get("max_findings", 50))


def rule(text: str) -> dict | None:
    """A user rule as ``patterns.external`` takes it; None without an id or a pattern."""
    try:
        r = tomllib.loads(text)["rule"]
        m = r.get("match", {})
        out = {"id": r["id"], "severity": r.get("severity", "medium"), "file_patterns": m.get("file_patterns", []), "content_patterns": m.get("content_patterns", [])}
    except (tomllib.TOMLDecodeError, KeyError, TypeError):
        return None
    return out if out["content_patterns"] else None


def baseline(hosts: DataFrame, created: str) -> str:
    """A learned baseline as JSON: hosts in order, each once."""
    names = [r[0] for r in hosts.select("host").where(F.col("host").isNotNull()).distinct().orderBy("host").collect()]  # hosts of one learning run
    return json.dumps({"version": 1, "created": created, "allowed_hosts": names}, indent=2)
