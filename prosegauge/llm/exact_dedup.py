"""Exact deduplication by a stream with disk-backed keyed state that never expires.

The stream's state (RocksDB, under the shared checkpoint folder) has one entry per digest: the stable id
and the locator (file, row) of the text that stays, and a count.  A later run with the same checkpoint goes
on where the last one stopped and reads only new files.  A digest seen twice is a hit; hits, and hits alone, have
their full bytes compared, and a digest that covers different texts is divided by text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.llm.common import filtering_session, staged, whole, work_folder

def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


LOCAL_FILES = "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"
PLACE = ("_metadata.file_path", "_metadata.row_index")


def _session(spark: SparkSession, partitions: int | None, checkpoint: str) -> SparkSession:
    """A session of its own: state-store settings shouldn't leak into the caller's.

    Over a local file system Spark's usual way to rename a checkpoint's files starts 16 processes (readlink) for each
    partition of the state; the other way starts none.  Elsewhere the usual way stays: it can replace a file.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "64")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB", "4")
    own.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")  # what stays is on disk
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # else every partition takes some MB at once
    own.conf.set("spark.sql.streaming.metricsEnabled", "false")
    if checkpoint.startswith("file:"):
        own.conf.set("spark.sql.streaming.checkpointFileManagerClass", LOCAL_FILES)
    own.conf.set("spark.sql.shuffle.partitions", str(partitions or spark.conf.get("spark.sql.shuffle.partitions")))
    own.conf.set("spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


def located(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """text, doc_id, digest and the row's place, which stays the same when a task is run again."""
    return docs.select(
        "doc_id",
        whole(F.col("text")).alias("text"),
        digest(whole(F.col("text"))).alias("digest"),
        F.col(PLACE[0]).alias("file"),
        F.col(PLACE[1]).alias("row"),
    )


def _pattern(path: str) -> str:
    """path as a glob that matches it alone: a stream over a plain path wants a folder, and a table may be one file."""
    path = path.rstrip("/")
    return re.sub(r"([\\\[\]{}*?^])", r"\\\1", path[:-1]) + f"[{path[-1]}]"


def run_stream(spark: SparkSession, path: str, schema, checkpoint: str, partitions: int | None = None, digest: Callable[[Column], Column] = sha256) -> None:
    """Take all files of path that the checkpoint's state hasn't seen yet."""
    own = _session(spark, partitions, checkpoint)
    rows = located(own.readStream.schema(schema).parquet(_pattern(path)), digest).drop("text")
    state = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("keeper"), F.count("*").alias("n"))
    query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """digest, keeper (doc_id, file, row), n: the stream's state as it stands."""
    kept = spark.read.format("statestore").load(checkpoint)
    keeper, n = [f.name for f in kept.schema["value"].dataType.fields][:2]
    return kept.select(F.col("key")["digest"].alias("digest"), F.col("value")[keeper].alias("keeper"), F.col("value")[n].alias("n"))


def exact_groups(docs: DataFrame, path: str | None = None, checkpoint: str | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """docs -> row (struct of all its columns), doc_id, keep_id, group_size, kept, text_sha256; one row a row.

    path: a folder of Parquet files that docs is all of, if there is one; otherwise docs is written to the
    shared folder first.  digest: what texts are keyed by.  Null text counts as empty.  Of equal texts the row
    with the largest doc_id stays, null below all others; among rows that share the id too, the one whose file
    and row come last.  Very long texts are read whole; the state has only their digest.  An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    folder = work_folder(spark)
    try:
        docs.select(*PLACE)
    except AnalysisException:
        path = None
    if path is None:
        path = f"{folder}/input"
        docs = staged(docs, path)
    checkpoint = checkpoint or f"{folder}/stream"
    schema = docs.select("doc_id", "text").schema
    run_stream(spark, path, schema, checkpoint, digest=digest)
    state = staged(read_state(spark, checkpoint), f"{folder}/state")
    # on hits, the full bytes: one row a digest and map task is moved, so a hot text is no load
    own = filtering_session(spark)
    hits = own.read.schema(state.schema).parquet(f"{folder}/state").where("n > 1").select("digest")
    checked = located(own.read.schema(schema).parquet(path), digest).select("digest", "text").join(hits, "digest", "left_semi")
    checked = checked.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most"))
    checked.where("least != most").select("digest").write.parquet(f"{folder}/clash")
    clash = spark.read.schema("digest string").parquet(f"{folder}/clash")
    text = whole(F.col("text"))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", digest(text).alias("digest"), F.sha2(text, 256).alias("text_sha256"), F.col(PLACE[0]).alias("file"), F.col(PLACE[1]).alias("at"))
    if clash.isEmpty():
        out = rows.join(state, "digest")
    else:  # different texts with one digest: the text itself is the key of those
        divided = located(docs, digest).join(clash, "digest").groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "row")).alias("keeper"), F.count("*").alias("n"))
        clean = rows.join(clash, "digest", "left_anti").join(state, "digest")
        mixed = rows.withColumn("text", whole(F.col("row.text"))).join(divided, ["digest", "text"])
        out = clean.unionByName(mixed.drop("text"))
    kept = (F.col("keeper.file") == F.col("file")) & (F.col("keeper.row") == F.col("at"))
    return out.select("row", "doc_id", F.col("keeper.doc_id").alias("keep_id"), F.col("n").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")
