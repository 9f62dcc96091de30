"""What can be said of packages before they are installed: facts about releases, install scripts, references of actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T

SYSTEMS = {"npm": "npm", "PyPI": "pypi", "crates.io": "cargo", "Go": "go"}  # fixed values: names of ecosystems where releases are looked up


def release_keys(packages: DataFrame) -> DataFrame:
    """(ecosystem, name, version, key) of packages whose releases can be looked up, each once; ``key`` is the path of the lookup."""
    system = F.coalesce(*[F.when(F.col("ecosystem") == e, s) for e, s in SYSTEMS.items()])
    rows = packages.select("ecosystem", "name", "version").distinct().withColumn("__s", system).where("__s is not null")
    key = F.concat_ws("/", F.lit("systems"), "__s", F.lit("packages"), T.url_encoded(F.col("name")), F.lit("versions"), T.url_encoded(F.col("version")))
    return rows.select("ecosystem", "name", "version", key.alias("key"))


def releases(packages: DataFrame, facts: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """T002 for versions published within ``days``, T004 for those without a linked source.

    ``facts`` has (ecosystem, name, version, published, labels), labels being those of
    a release's links.  A version without facts is no finding.
    """
    keys = ["ecosystem", "name", "version"]
    rows = release_keys(packages).join(facts, keys)
    new = F.when(T.recently(F.col("published"), today, days), F.struct(F.lit("T002").alias("rule_id"), F.lit("medium").alias("severity")))
    bare = F.when(~F.array_contains(F.coalesce("labels", F.array().cast("array<string>")), "SOURCE_REPO"), F.struct(F.lit("T004").alias("rule_id"), F.lit("low").alias("severity")))
    return rows.select(*keys, F.explode(F.filter(F.array(new, bare), lambda h: h.isNotNull())).alias("h")).select(*keys, "h.rule_id", "h.severity")


def install_scripts(manifests: DataFrame) -> DataFrame:
    """PF001: every install script of the project's own manifest (path, text), whatever it does."""
    scripts = manifests.where("path = 'package.json'").select("path", F.explode(F.from_json("text", "scripts map<string,string>")["scripts"]).alias("hook", "command"))
    return scripts.where(F.col("hook").isin(rules.DEPENDENCY_HOOKS)).select(F.lit("PF001").alias("rule_id"), F.lit("medium").alias("severity"), F.col("path").alias("file"), "hook", "command")


def resolved(actions: DataFrame, refs: DataFrame) -> DataFrame:
    """(action, sha): the commit that each used action (owner/name/folder@ref) stands for.

    ``refs`` has (repository, kind, ref, sha, target): a tag counts before a branch of
    the same name, and an annotated tag stands for its target.
    """
    parts = F.split(F.substring_index("action", "@", 1), "/")
    used = actions.select("action").distinct().select("action", F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))).alias("repository"), F.substring_index("action", "@", -1).alias("ref"))
    known = refs.where("kind in ('tags', 'heads')").groupBy("repository", "ref").agg(F.max_by(F.coalesce("target", "sha"), F.col("kind")).alias("sha"))  # tags sort after heads
    return used.join(known, ["repository", "ref"]).select("action", "sha")
