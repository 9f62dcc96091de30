"""Text that system tools print, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SOCKET = r"^ESTAB\S*\s+\d+\s+\d+\s+\S+\s+([0-9.]+):(\d+)\s+users:\(\(\"([^\"]+)\",pid=(\d+)"
OPEN_NETWORK = r"^(\S+)\s+(\d+)\s.*TCP\s+\S+->([0-9.]+):(\d+)\s+\(ESTABLISHED\)"


def connections(lines: DataFrame) -> DataFrame:
    """(remote_host, remote_port, pid, process_name) from lines of a socket or open-file listing; works on streams."""
    def rows(pattern: str, host: int, port: int, pid: int, name: int) -> DataFrame:
        x = lambda i: F.regexp_extract("line", pattern, i)
        return lines.where(F.col("line").rlike(pattern)).select(x(host).alias("remote_host"), x(port).cast("int").alias("remote_port"), x(pid).cast("int").alias("pid"), x(name).alias("process_name"))

    return rows(SOCKET, 1, 2, 4, 3).unionByName(rows(OPEN_NETWORK, 3, 4, 2, 1))


def writable(flags):
    """Whether octal flags of a file descriptor allow writing."""
    return F.conv(flags, 8, 10).cast("long").bitwiseAND(F.lit(3)) != 0


def open_files(lines: DataFrame) -> DataFrame:
    """(pid, process_name, path, writable) of a field listing: p, c, f, a and n lines; a new descriptor forgets the access before it."""
    from pyspark.sql import Window

    order = Window.partitionBy("file").orderBy("line_no")
    tag, value = F.left("line", F.lit(1)), F.expr("substring(line, 2)")
    last = lambda t: F.last(F.when(tag == t, value), ignorenulls=True).over(order)
    fd = F.sum(F.when(tag.isin("f", "p"), 1).otherwise(0)).over(order)
    rows = lines.withColumn("pid", last("p").cast("int")).withColumn("process_name", last("c")).withColumn("fd", fd)
    access = F.last(F.when(tag == "a", value), ignorenulls=True).over(Window.partitionBy("file", "fd").orderBy("line_no"))
    return rows.withColumn("access", access).where(tag == "n").select("pid", "process_name", value.alias("path"), F.coalesce(F.col("access").isin("w", "u"), F.lit(False)).alias("writable"))


def captured_hosts(lines: DataFrame) -> DataFrame:
    """Hosts of a capture file, each once; lines with a hash sign are remarks."""
    host = F.trim("line")
    return lines.where((host != "") & ~host.startswith("#")).select(host.alias("host")).distinct()
