"""Sharding by weighted rendezvous hashing.

Each (key, shard) pair has a hash u in (0, 1); the key goes to the shard with the least -ln(u) / weight.
A shard's hash doesn't depend on the others, so one more shard only takes rows, and a changed weight
moves only what that shard gains or loses.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegauge.llm.common import offsets, power_of_two, staged, whole, work_folder

#: Rows of a shard share a window task up to about this many.
ROWS_PER_CELL = 1 << 15
FEWEST_SALTS = 16


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of key.  Shards of weight 0 get nothing; equal scores go to the lower shard."""
    def price(shard: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((-F.log(u) / F.lit(float(weight))).alias("price"), F.lit(shard).alias("shard"))

    bids = [price(shard, weight) for shard, weight in enumerate(weights) if weight > 0]
    return reduce(F.least, [bids[0], *bids[1:]])["shard"] if len(bids) == 1 else F.least(*bids)["shard"]


def sharded(docs: DataFrame, weights: list[float] | int = 16, key: str = "doc_id") -> DataFrame:
    """docs -> doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text has no bytes: size 1, crc32 0.  Null keys are one key like any other, so they share a
    shard, as repeated keys do.  Slots follow (salt, key, size, crc32); rows alike in all of these are
    interchangeable.  An empty table gives an empty result, and other columns aren't read.
    """
    spark = docs.sparkSession
    weights = [1.0] * weights if isinstance(weights, int) else list(weights)
    salts = max(FEWEST_SALTS, power_of_two(docs.count() // (len(weights) * ROWS_PER_CELL) + 1))
    data = whole(F.col("text")).cast("binary")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), [*weights, 1.0]).alias("grown_shard"),
    )
    # not by the key alone: rows of one hot key share a shard, but needn't share a task
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit("slot")), F.lit(salts)).cast("int"))
    folder = work_folder(spark)
    cells = staged(rows.groupBy("shard", "salt").agg(F.count("*").alias("n")), f"{folder}/cells")
    cells = offsets(cells, ["shard"], [], ["salt"], "n").drop("n")
    order = Window.partitionBy("shard", "salt").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    rows = rows.withColumn("place", F.row_number().over(order)).join(cells, ["shard", "salt"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard")
