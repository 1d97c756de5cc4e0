"""Files that change while their findings are worked on: each batch of files updates the items' lines.

The items are kept as versions, one folder for each batch.  A batch that is run again reads the version before it
and writes its own anew, so it gives the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prosegauge.functions import text as T
from prosegauge.operators import comments
from prosegauge.operators import relational as R


def items(spark: SparkSession, store: str, version: int) -> DataFrame:
    """The items after a batch; -1 are those before the first."""
    return spark.read.parquet(f"{store}/version={version}")


def start(items_: DataFrame, store: str) -> None:
    items_.withColumn("done", F.lit(False)).write.mode("overwrite").parquet(f"{store}/version=-1")


def follow(files: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """A stream of files (path, text) as they are now.  A file is best sent once a batch."""

    def update(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = comments.extract_blocks(batch).select("file", T.norm_hash(F.col("text")).alias("hash"), "start", "end")
        again = R.rescan(items(spark, store, number - 1), found, batch.select(F.col("path").alias("file")))
        again.write.mode("overwrite").parquet(f"{store}/version={number}")

    return files.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
