"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only where a local session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="prosegauge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/prosegauge/{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, unless the session has bounds of its own: by default it is 10,000 rows,
    however long their texts are."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20)), ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")):
        if spark.conf.get(key, None) in (None, "10000", "2147483647", str((1 << 31) - 1), str((1 << 63) - 1), "268435456", "256MB"):
            spark.conf.set(key, value)
