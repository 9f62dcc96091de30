"""Helpers that the operators of this subpackage share.

Lineage is cut with Parquet tables in the folder that the cluster names in
``spark.checkpoint.dir``; where the setting is absent (local tests) a folder of
this process is used.  Nothing here keeps state on an executor's own disk.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors can reach."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="palisade-")
    return f"file://{_own_dir}"


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that ``cut`` has written and nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        _written.remove(path)


def written() -> list[str]:
    """Tables that ``cut`` has written and that are still there."""
    return list(_written)


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or not _written:
        return
    try:
        drop(spark, written())
    except Exception:  # the JVM may be gone when the process ends
        pass


#: Rows of numbers that one file of a written table can well hold.
FILE_ROWS = 500_000


def cut(df: DataFrame, most_rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result doesn't depend on executors' disks: a lost executor costs at
    most a re-read.  The tables go when the driver process ends.  A table of short
    rows, at most about ``most_rows``, is written as few files.
    """
    spark = df.sparkSession
    if most_rows is not None:
        df = df.coalesce(1 + most_rows // FILE_ROWS)
    path = f"{shared_dir(spark)}/palisade-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``__row`` (a row number of its own) and the named columns of ``docs``.

    The numbers come from a row's partition and place, so two rows that are
    equal in every column stay apart.  They are stable while ``docs`` reads
    files or tables, which all the queries here do.
    """
    steady(docs.sparkSession)
    return docs.select(F.monotonically_increasing_id().alias("__row"), *[F.col(c) for c in columns])


def remainder(column: str, modulus: int):
    """crc32 of a column as text, modulo ``modulus``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


#: White space of ASCII, which ends a word under every rule of words here.
SPACES = frozenset(" \t\n\v\f\r")


def blocks(text: str, size: int = 1 << 20):
    """Cut a long text before ASCII white space into pieces of about ``size`` characters, losing nothing."""
    at, n = 0, len(text)
    while n - at > size:
        end = at + size
        while end < n and text[end] not in SPACES:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


#: Rows and bytes of the batches that go to Python workers, unless the session sets less.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def steady(spark: SparkSession) -> None:
    """Pin how files are split, so that row numbers stay the same if executors come or go between two reads, and bound batches by bytes."""
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(max(1, spark.sparkContext.defaultParallelism)))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, str(min(BATCH_ROWS, int(spark.conf.get(name, "10000")) or BATCH_ROWS)))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "", "-1", "-1b", "9223372036854775807", "9223372036854775807b"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores at its end if ``df`` has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of the table of row numbers, 64 numbers to a row, up to which it is broadcast.
BITMAP_ROWS = 1 << 20


class Rows:
    """A set of row numbers, to split a table by without moving it.

    The numbers become bitmaps of 64 rows each; ``among`` and ``apart`` broadcast
    these as long as they are BITMAP_ROWS at most (some 40 MB, over 64 million rows
    where they lie close), and join by shuffles beyond.
    """

    def __init__(self, numbers: DataFrame, name: str):
        bits = numbers.select(F.shiftright(name, 6).alias("high"), F.expr(f"shiftleft(1L, cast(`{name}` & 63 as int))").alias("bits"))
        self.bits = cut(bits.groupBy("high").agg(F.bit_or("bits").alias("bits")))
        count = self.bits.count()
        self.small, self.most = count <= BITMAP_ROWS, 64 * count

    def _met(self, df: DataFrame, name: str):
        high, bits = fresh(df, "__high"), fresh(df, "__bits")
        table = self.bits.toDF(high, bits)
        met = df.withColumn(high, F.shiftright(name, 6)).join(F.broadcast(table) if self.small else table, high, "left")
        inside = F.coalesce(F.expr(f"shiftright(`{bits}`, cast(`{name}` & 63 as int)) & 1"), F.lit(0)) == 1
        return met, inside, (high, bits)

    def among(self, df: DataFrame, name: str) -> DataFrame:
        """Rows of ``df`` whose number in column ``name`` is in the set."""
        met, inside, gone = self._met(df, name)
        return met.where(inside).drop(*gone)

    def apart(self, df: DataFrame, name: str) -> DataFrame:
        """Rows of ``df`` whose number in column ``name`` isn't in the set."""
        met, inside, gone = self._met(df, name)
        return met.where(~inside).drop(*gone)


def slices(batches, rows: int = 512):
    """Batches in slices of ``rows`` at most, so that few texts at a time become Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
