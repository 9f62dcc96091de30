"""Repeat scans: what changed since a snapshot, and findings that outlive it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["name", "version"]


def changed(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Packages (name, version, integrity) that the snapshot lacks or has with another checksum."""
    return current.join(snapshot.select(*KEY, F.col("integrity").alias("__i")), [*[current[k] == snapshot[k] for k in KEY], current["integrity"].eqNullSafe(F.col("__i"))], "left_anti")


def pruned(snapshot: DataFrame, current: DataFrame) -> DataFrame:
    return snapshot.join(current.select(*KEY).distinct(), KEY, "left_semi")


def merged(snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """(name, version, before, after, state) of every package of either side: added, removed, changed or same."""
    a, b = snapshot.select(*KEY, F.col("integrity").alias("before"), F.lit(True).alias("__a")), current.select(*KEY, F.col("integrity").alias("after"), F.lit(True).alias("__b"))
    state = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "same").otherwise("changed")
    return a.join(b, KEY, "full_outer").select(*KEY, "before", "after", state.alias("state"))


def carried(new: DataFrame, old: DataFrame, rescanned: DataFrame, current: DataFrame) -> DataFrame:
    """Findings after a delta scan: the new ones, and the old ones of packages that are still there and weren't scanned again."""
    kept = old.join(rescanned.select("package").distinct(), "package", "left_anti").join(current.select("package").distinct(), "package", "left_semi")
    return new.unionByName(kept)
