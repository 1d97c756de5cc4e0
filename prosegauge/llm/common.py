"""What the operators share: the shared work folder, word and fold rules, distributed ranks."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word: a maximal run of characters that aren't ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII letters are the only ones that are lower-cased.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only a local session that names none (tests, a laptop) gets a temporary folder instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="prosegauge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/prosegauge/{uuid.uuid4().hex}"


def staged(df: DataFrame, path: str) -> DataFrame:
    """Write df and read it again: lineage ends here, and a lost executor costs nothing before it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filtering_session(spark: SparkSession) -> SparkSession:
    """A session of its own, in which even small scans are thinned by a Bloom filter of the other side of a join
    before they are shuffled.

    The filter has Spark's own bound (spark.sql.optimizer.runtime.bloomFilter.maxNumBits); where it is full, more
    rows are moved, and the result is the same.
    """
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.session.timeZone", "spark.sql.autoBroadcastJoinThreshold"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
    own.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    own.conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "1g")
    return own


def dropped(spark: SparkSession, *paths: str) -> None:
    """Remove staged tables that no plan reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, unless the session has bounds of its own."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20)), ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")):
        if spark.conf.get(key, None) in (None, "10000", "2147483647", str((1 << 31) - 1), str((1 << 63) - 1), "268435456", "256MB"):
            spark.conf.set(key, value)


def released() -> None:
    """Give memory that is free back to the system: Python workers outlive their tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems have other allocators
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that leaves no free memory behind."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        released()

    return tidied


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n.  A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def power_of_two(n: int) -> int:
    """The least power of two that is n or more."""
    return 1 << max(0, n - 1).bit_length()


def offsets(cells: DataFrame, group: list[str], outer: list[str], inner: list[str], n: str) -> DataFrame:
    """Rows before each cell within its group, cells ordered by outer and then inner.

    Two prefix sums, so that no window has all cells of a hot group: within (group, outer) over inner,
    and within group over outer.  outer and inner may be empty, but not both.
    """
    before = lambda w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if not outer or not inner:
        return cells.withColumn("before", before(Window.partitionBy(*group).orderBy(*outer, *inner)))
    tops = cells.groupBy(*group, *outer).agg(F.sum(n).alias(n))
    tops = tops.withColumn("above", before(Window.partitionBy(*group).orderBy(*outer))).drop(n)
    cells = cells.withColumn("beside", before(Window.partitionBy(*group, *outer).orderBy(*inner)))
    return cells.join(tops, [*group, *outer]).withColumn("before", F.col("above") + F.col("beside")).drop("above", "beside")
