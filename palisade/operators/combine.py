"""Signals of one file or package together: escalation, combinations, suppression, reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

OBFUSCATION = ["P014", "P017", "P007"]


def any_of(rule: Column, ids: list[str], over: Window | None = None) -> Column:
    flag = F.coalesce(F.bool_or(rule.isin(ids)), F.lit(False))
    return flag if over is None else F.coalesce(F.bool_or(rule.isin(ids)).over(over), F.lit(False))


def escalated(findings: DataFrame) -> DataFrame:
    """Dynamic loading next to obfuscation or evidence removal in one file is critical; removal next to execution says so."""
    w = Window.partitionBy("file")
    has = lambda ids: any_of(F.col("rule_id"), ids, w)
    rows = findings.where("file is not null").withColumn("__d", has(["P013"])).withColumn("__o", has(OBFUSCATION)).withColumn("__a", has(["P015"])).withColumn("__e", has(["P001"]))
    up = (F.col("rule_id") == "P013") & (F.col("__o") | F.col("__a"))
    note = (F.col("rule_id") == "P015") & (F.col("__d") | F.col("__e"))
    message = F.when(up, F.concat("message", F.lit(" (graver: the same file hides what it does)"))).when(note, F.concat("message", F.lit(" (graver: the same file loads or runs code)"))).otherwise(F.col("message"))
    return rows.withColumn("severity", F.when(up, "critical").otherwise(F.col("severity"))).withColumn("message", message).select(*findings.columns).unionByName(findings.where("file is null"))


def combinations(findings: DataFrame) -> DataFrame:
    """(package, rule_id, severity, confidence): what a package's findings amount to together.

    The sets of files hold at most those of one package with two kinds of rule, and
    are compared as sets.
    """
    r = F.col("rule_id")
    files = lambda ids: F.collect_set(F.when(r.isin(ids), F.col("file")))
    p = findings.where("package is not null").groupBy("package").agg(
        any_of(r, ["P004"]).alias("cred"), any_of(r, ["P003", "P006", "P010", "P011"]).alias("net"), any_of(r, ["P001", "P008"]).alias("run"),
        any_of(r, OBFUSCATION).alias("obf"), any_of(r, ["P013"]).alias("dyn"), files(["P004"]).alias("cred_files"), files(["P003", "P006", "P001"]).alias("net_files"),
    )
    apart = (F.size("net_files") > 0) & ~F.arrays_overlap("cred_files", "net_files")
    case = lambda cond, rule, conf: F.when(cond, F.struct(F.lit(rule).alias("rule_id"), F.lit("critical").alias("severity"), F.lit(conf).alias("confidence")))
    cases = F.array(case(F.col("cred") & (F.col("net") | F.col("run")) & apart, "COMBO-001", "high"), case(F.col("run") & F.col("obf"), "COMBO-002", "medium"), case(F.col("dyn") & F.col("obf"), "COMBO-003", "medium"))
    return p.select("package", F.explode(F.filter(cases, lambda c: c.isNotNull())).alias("c")).select("package", "c.*")


def allowed(findings: DataFrame, allow: DataFrame, on: list[str]) -> DataFrame:
    """Findings without those that the allow list names."""
    return findings.join(allow.select(*on).distinct(), on, "left_anti")


def reachable(findings: DataFrame, imports: DataFrame, dev: DataFrame | None = None) -> DataFrame:
    """``reachable``: whether the application imports the finding's package, whatever its version, and it isn't for development only; null without a package."""
    rows = findings.withColumn("__n", T.without_version(F.col("package")))
    rows = rows.join(imports.select(F.col("package").alias("__i")).distinct(), F.col("__n") == F.col("__i"), "left")
    used = F.col("__i").isNotNull()
    if dev is not None:
        rows = rows.join(dev.select(F.col("package").alias("__v")).distinct(), F.col("__n") == F.col("__v"), "left")
        used = used & F.col("__v").isNull()
    return rows.withColumn("reachable", F.when(F.col("package").isNotNull(), used)).drop("__i", "__n", *(["__v"] if dev is not None else []))


def build_downgraded(findings: DataFrame) -> DataFrame:
    """Capability findings that can't be reached are medium if critical, else low."""
    hidden = F.col("rule_id").startswith("CAP") & (F.col("reachable") == F.lit(False))
    return findings.withColumn("severity", F.when(hidden, F.when(F.col("severity") == "critical", "medium").otherwise("low")).otherwise(F.col("severity")))
