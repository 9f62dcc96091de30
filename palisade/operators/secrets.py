"""Credentials: formats, and assignments judged by name, entropy and length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T

ALLOW = "scan:allow"  # on a line, this silences it
IP = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"


def silenced(lines: DataFrame) -> DataFrame:
    """Lines without those that carry the allow mark."""
    return lines.where(~F.col("line").contains(ALLOW))


def addresses(lines: DataFrame, *keep: str) -> DataFrame:
    """(keep, line_no, place, ip, imds): every raw IPv4 address of a line, and whether it is that of the metadata service."""
    found = lines.where(F.col("line").rlike(IP)).select(*keep, "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(IP), F.lit(0))).alias("place", "ip"))
    return found.withColumn("imds", F.col("ip") == "169.254.169.254")


def assignments(lines: DataFrame, key: str) -> DataFrame:
    """(key, line_no, place, name, value, n_chars, bits, rule_id, severity): quoted values given to a name that speaks of a credential, each of a line by its place from 0.

    Name, entropy and length make S021, high; the name alone S022, medium.  Lines
    with the allow mark don't count.
    """
    rows = silenced(lines.where(F.col("line").rlike(rules.ASSIGNMENT)))
    each = [F.regexp_extract_all("line", F.lit(rules.ASSIGNMENT), F.lit(i)).alias(n) for i, n in ((1, "name"), (2, "value"))]
    rows = rows.select(key, "line_no", F.posexplode(F.arrays_zip(*each)).alias("place", "x")).select(key, "line_no", "place", "x.name", "x.value")
    rows = rows.withColumn("n_chars", F.length("value").cast("long")).withColumn("bits", T.entropy(F.col("value")))
    strong = (F.col("bits") > rules.ENTROPY_BITS) & (F.col("n_chars") > rules.LONG_SECRET)
    return rows.withColumn("rule_id", F.when(strong, "S021").otherwise("S022")).withColumn("severity", F.when(strong, "high").otherwise("medium"))


def bare_values(lines: DataFrame, key: str) -> DataFrame:
    """S023: quoted values of high entropy whose line names no credential."""
    quoted = r"""['"]([^'"\s]{31,})['"]"""
    rows = silenced(lines.where(F.col("line").rlike(quoted) & ~F.col("line").rlike(rules.ASSIGNMENT)))
    rows = rows.select(key, "line_no", F.regexp_extract("line", quoted, 1).alias("value")).withColumn("bits", T.entropy(F.col("value")))
    return rows.where(F.col("bits") > rules.ENTROPY_BITS).withColumn("rule_id", F.lit("S023")).withColumn("severity", F.lit("low"))


def formats(lines: DataFrame, key: str) -> DataFrame:
    """(key, line_no, rule_id, severity, masked): each format a line has, the value shown by its ends."""
    hits = F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(i).alias("rule_id"), F.lit("medium" if i in ("S010", "S011") else "high").alias("severity"), T.masked(F.regexp_extract("line", f"({p})", 1)).alias("masked"))) for i, p in rules.SECRET_PATTERNS.items()])
    rows = silenced(lines).select(key, "line_no", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
    return rows.select(key, "line_no", "h.rule_id", "h.severity", "h.masked")


def format_counts(lines: DataFrame) -> DataFrame:
    """(rule_id, n) for every format, 0 included: one pass, one row of sums."""
    sums = lines.agg(*[F.count_if(F.col("line").rlike(p)).alias(i) for i, p in rules.SECRET_PATTERNS.items()])
    return sums.unpivot([], list(rules.SECRET_PATTERNS), "rule_id", "n")
