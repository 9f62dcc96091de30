"""Source trees as tables: paths are judged before any content is read."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T


def sampled(content: Column) -> Column:
    """Text of a file; of one above 500,000 bytes its first and last 50,000.  Bytes that aren't UTF-8 are replaced."""
    n = rules.SAMPLE_EACH
    part = F.when(F.length(content) > rules.SAMPLE_ABOVE, F.concat(F.substring(content, F.lit(1), F.lit(n)), F.substring(content, F.length(content) - n + 1, F.lit(n)))).otherwise(content)
    return F.regexp_replace(F.decode(part, "UTF-8"), "\u0000", "")


HIDDEN = [".github/workflows", ".venv"]


def read(spark: SparkSession, root: str, depth: int | None = None, glob: str | None = None) -> DataFrame:
    """(path below ``root``, length, content) of all files; unused content isn't read.

    Listings leave out folders whose name starts with a dot or an underscore, so the
    ones in HIDDEN, where they exist, are listed for themselves.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [root]
    for name in HIDDEN:
        p = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        if p.getFileSystem(conf).exists(p):
            paths.append(p.toString())
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = re.escape(root.rstrip("/").split("://")[-1].lstrip("/"))
    rows = reader.load(paths).select(F.regexp_replace(F.col("path"), f"^[a-z]+:/*{base}/", "").alias("path"), "length", "content")
    return rows if depth is None else rows.where(F.size(F.split("path", "/")) <= depth)


def dependency_files(spark: SparkSession, root: str, more_skipped: list[str] = (), depth: int = 7) -> DataFrame:
    """(path, text) of scannable files in dependency folders."""
    rows = read(spark, root, depth + 1)
    path = F.col("path")
    inside = F.exists(F.split(path, "/"), lambda p: p.isin(rules.DEPENDENCY_DIRS))
    rows = rows.where(inside & T.scannable(path) & ~T.in_skipped_dir(path, list(more_skipped)))
    return rows.select("path", sampled(F.col("content")).alias("text"))


def package_dir(path: Column) -> Column:
    """Folder of the package that a file belongs to; null outside dependency folders."""
    return F.nullif(F.regexp_extract(path, r"^(.*node_modules/(?:@[^/]*/)?[^/]*|vendor/.*?gems/[^/]*|\.?venv/.*?site-packages/[^/]*)/", 1), F.lit(""))


def of_packages(files: DataFrame, packages: DataFrame, depth: int = 3) -> DataFrame:
    """Files of the packages (dir_path) at most ``depth`` below their folder: an equi-join on the folder."""
    rows = files.withColumn("__dir", package_dir(F.col("path")))
    rows = rows.where(F.size(F.split("path", "/")) - F.size(F.split("__dir", "/")) <= depth)
    return rows.join(packages.select(F.col("dir_path").alias("__dir")).distinct(), "__dir", "left_semi").drop("__dir")


def uncovered(files: DataFrame, packages: DataFrame) -> DataFrame:
    """Files whose top folder no locked package covers."""
    top = lambda c: F.get(F.split(c, "/"), F.lit(0))
    covered = packages.where("dir_path is not null").select(top("dir_path").alias("__top")).distinct()
    return files.withColumn("__top", top("path")).join(covered, "__top", "left_anti").drop("__top")


def workflow_lines(spark: SparkSession, root: str) -> DataFrame:
    rows = read(spark, root).where(F.col("path").rlike(r"^\.github/workflows/[^/]+\.ya?ml$"))
    return T.lines(rows.select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("text")), "file")


def repository_remote(lines: DataFrame) -> DataFrame:
    """Web address of ``origin`` in the lines (file, line_no, line) of a git configuration."""
    from pyspark.sql import Window

    section = F.last(F.when(F.col("line").startswith("["), F.trim("line")), ignorenulls=True).over(Window.partitionBy("file").orderBy("line_no"))
    rows = lines.withColumn("section", section).where((F.col("section") == '[remote "origin"]') & F.col("line").rlike(r"^\s*url\s*="))
    return rows.select("file", T.repository_url(F.regexp_extract("line", r"=\s*(.*)$", 1)).alias("url"))
