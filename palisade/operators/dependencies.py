"""Dependencies against advisories, popular names, and facts about releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def advisory_severity(scores: Column, database: Column) -> Column:
    """Severity of the first score, else the database's, else medium."""
    first = F.get(scores, F.lit(0))
    return F.coalesce(F.when(first.isNotNull(), T.cvss_severity(T.cvss_score(first))), F.lower(database), F.lit("medium"))


def advised(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """A finding for each package version and advisory: malware is critical, anything else by its score."""
    keys = ["ecosystem", "name", "version"]
    rows = packages.dropDuplicates(keys).join(advisories, keys)
    malware = F.col("id").startswith("MAL-")
    return rows.select(
        *keys, F.concat(F.when(malware, "MAL:").otherwise("V:"), F.col("id")).alias("rule_id"),
        F.when(malware, "critical").otherwise(advisory_severity(F.col("scores"), F.col("database_severity"))).alias("severity"), F.get("fixed", F.lit(0)).alias("fixed_in"),
    )


def first_fixed(affected: Column) -> Column:
    """First fixed version in affected → ranges → events."""
    events = F.flatten(F.flatten(F.transform(affected, lambda a: F.transform(a["ranges"], lambda r: r["events"]))))
    return F.get(F.filter(F.transform(events, lambda e: e["fixed"]), lambda v: v.isNotNull()), F.lit(0))


def lookalikes(names: DataFrame, popular: DataFrame) -> DataFrame:
    """(name, like): names one edit from a popular one, the best ranked, unless they are popular themselves.

    ``popular`` is (popular, rank).  Names one edit apart share a deletion variant:
    a name and itself without one of its characters.  So the join is an equi-join on
    variants and the distance is computed for candidates alone.
    """
    def variants(col: str) -> Column:
        n = F.length(col)
        less = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(F.col(col), F.lit(1), i - 1), F.substring(F.col(col), i + 1, n)))
        return F.explode(F.array_distinct(F.array_append(less, F.col(col))))

    asked = names.select("name").distinct().join(popular.select(F.col("popular").alias("name")), "name", "left_anti")
    pairs = asked.withColumn("v", variants("name")).join(popular.withColumn("v", variants("popular")), "v").select("name", "popular", "rank").distinct()
    near = pairs.where(F.levenshtein("name", "popular", 1) == 1)
    return near.groupBy("name").agg(F.min_by("popular", "rank").alias("like"))


def batches(packages: DataFrame, order: list[str], size: int = 1000) -> DataFrame:
    """``batch``: the number of the request of ``size`` packages that each falls in.

    Places come from counts of ranges of the order, so no task numbers all rows.
    """
    parts = packages.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()).persist()
    counts = parts.groupBy("__p").agg(F.count("*").alias("n"))
    base = counts.select("__p", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("__b"))
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) + F.col("__b") - 1
    return parts.join(F.broadcast(base), "__p").withColumn("batch", F.floor(place / size).cast("long")).drop("__p", "__b")


def without_integrity(locks: DataFrame) -> DataFrame:
    """T007: (file, missing, total) of lock entries without a checksum."""
    return locks.groupBy("file").agg(F.count_if(F.coalesce(F.col("integrity"), F.lit("")) == "").alias("missing"), F.count("*").alias("total")).where("missing > 0")
