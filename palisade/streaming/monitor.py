"""Observations of running processes as streams.

The watermark bounds what is remembered of connections seen; a session's state is
a few counts, given up when its time is over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.monitor import connection_class, of_tree, process_tree, verdict


def events(spark, folder: str, schema) -> DataFrame:
    """A stream of Parquet files whose ``ts`` is a timestamp."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def classified(stream: DataFrame, allowed: list[str] = ()) -> DataFrame:
    return stream.withColumn("class", connection_class(F.col("remote_host"), F.col("resolved_host"), F.col("process_name"), list(allowed)))


def seen_once(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Connections by host, port and process, each once within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["remote_host", "remote_port", "pid"])


def files_once(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Open files by process and path, each once within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["pid", "path"])


def sessions(stream: DataFrame, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(key, begin, end, n): runs of observations of a key with no gap as long as ``gap``."""
    rows = stream.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def within_tree(processes: Callable[[], DataFrame], root: int, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: hands on the connections of processes below ``root``, by the processes as they are at each batch."""

    def run(batch: DataFrame, number: int) -> None:
        sink(of_tree(batch, process_tree(processes(), root)), number)

    return run


def kill_chain(stream: DataFrame, key: str = "user_id", delay: str = "2 days") -> DataFrame:
    """(key, day, canary, unexpected, critical, verdict), updated as observations come; ``stream`` has ts, is_canary and class.

    Tumbling days by event time; observations later than the watermark don't count.
    """
    sums = stream.withWatermark("ts", delay).groupBy(key, F.window("ts", "1 day").alias("w")).agg(
        F.count_if("is_canary").alias("canary"), F.count_if(~F.col("is_canary") & (F.col("class") == "unexpected")).alias("unexpected"), F.count_if(~F.col("is_canary") & (F.col("class") == "critical")).alias("critical")
    )
    return sums.select(key, F.to_date("w.start").alias("day"), "canary", "unexpected", "critical", verdict(F.col("canary"), F.col("unexpected"), F.col("critical")).alias("verdict"))


def learned_hosts(stream: DataFrame, delay: str = "1 day", span: str = "1 day") -> DataFrame:
    """(day, remote_host, n): hosts with how often they were seen in each ``span``; the state goes when its span is over."""
    rows = stream.withWatermark("ts", delay).groupBy(F.window("ts", span).alias("w"), "remote_host").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("begin"), "remote_host", "n")
