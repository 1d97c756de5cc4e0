"""Byte-level BPE encoding and decoding.

A text of up to `chunk` code points is encoded as it is.  A longer one is cut into overlapping chunks that are
pre-tokenised in parallel.  The pattern looks forward only, so two tokenisations that share a boundary agree
from there on: each chunk is joined to the one before at the first boundary that both have in their overlap,
and the pieces between these joints are encoded.  A text without such a joint (one huge word) is encoded whole.
Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegauge.llm.common import small_batches, tidy, whole

CHUNK, OVERLAP = 1 << 15, 512
#: A token's extent can depend on this many characters after its end: on one by look-ahead, or on those of a
#: contraction that starts at its last one.
LOOK = 4


@lru_cache(maxsize=2)
def codec(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
    return tiktoken.Encoding("prosegauge", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=2)
def splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def cuts(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Where overlapping chunks start and end."""
    return [(max(0, at - overlap), min(len(text), at + size + overlap)) for at in range(0, len(text), size)]


def joints(piece: str, start: int, last: bool, size: int, overlap: int, pattern: str) -> tuple[list[int], list[int]]:
    """Boundaries of the chunk that starts at `start`, in its overlap with the chunk before and after.

    Only those that the end of the chunk can't have moved, and only after a character that isn't white space:
    elsewhere cutting there would let a run of white space end earlier than in the whole text.
    """
    ends = np.array([m.end() for m in splitter(pattern).finditer(piece)], dtype=np.int64)
    if not last:
        ends = ends[ends <= len(piece) - LOOK]
    ends = [int(e) for e in ends if not piece[e - 1].isspace()]
    return [start + e for e in ends if e <= 2 * overlap], [start + e for e in ends if e >= len(piece) - 2 * overlap]


def _packed(encoding, text: str) -> bytes:
    return np.array(encoding.encode_ordinary(text), dtype="<u4").tobytes()


def encoded(docs: DataFrame, ranks: bytes, pattern: str, keep: tuple[str, ...] = ("doc_id",), chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs (text and `keep`) -> keep, n_tokens, ids (binary: little-endian unsigned 32-bit).

    ranks: the contents of a rank file, a vocabulary of fixed size.  Null text counts as empty and gives no
    ids; rows may repeat; an empty table gives an empty result; columns not in `keep` aren't read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    said = spark.sparkContext.broadcast(ranks)
    rows = docs.select(F.struct(*keep).alias("kept"), whole(F.col("text")).alias("text"))
    kept_type = rows.schema["kept"].dataType.simpleString()

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = codec(said.value, pattern)
        for b in batches:
            ids = [_packed(encoding, t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("kept"), pa.array(ids, pa.binary())], ["kept", "ids"])

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                parts = cuts(text, chunk, overlap)
                for at in range(0, len(parts), 64):
                    some = parts[at : at + 64]
                    yield pa.RecordBatch.from_pydict({"key": [key] * len(some), "k": list(range(at, at + len(some))), "of": [len(parts)] * len(some), "start": [s for s, _ in some], "piece": [text[s:e] for s, e in some]}, schema=pieces)

    pieces = pa.schema([("key", pa.string()), ("k", pa.int32()), ("of", pa.int32()), ("start", pa.int64()), ("piece", pa.string())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            both = [joints(p, s, k == of - 1, chunk, overlap, pattern) for p, s, k, of in zip(d["piece"], d["start"], d["k"], d["of"], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in both], pa.list_(pa.int64())), pa.array([x[1] for x in both], pa.list_(pa.int64()))], [*b.schema.names, "head", "tail"])

    def piecewise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = codec(said.value, pattern)
        for b in batches:
            d = b.to_pydict()
            out = [_packed(encoding, p[f - s : t - s]) for p, s, f, t in zip(d["piece"], d["start"], d["from"], d["to"], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("k"), pa.array(out, pa.binary())], ["key", "k", "ids"])

    brief = rows.where(F.length("text") <= chunk).mapInArrow(tidy(short), f"kept {kept_type}, ids binary")
    # keyed by content: the same whenever a task is run again, and a text that many rows have is encoded once
    long = rows.where(F.length("text") > chunk).withColumn("key", F.sha2("text", 256))
    parts = long.select("key", "text").mapInArrow(tidy(chunked), "key string, k int, of int, start long, piece string")
    parts = parts.dropDuplicates(["key", "k"]).mapInArrow(tidy(split), "key string, k int, of int, start long, piece string, head array<bigint>, tail array<bigint>")
    order = Window.partitionBy("key").orderBy("k")
    parts = parts.withColumn("from", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect(F.lag("tail").over(order), F.col("head")))))
    parts = parts.withColumn("to", F.when(F.col("k") == F.col("of") - 1, F.col("start") + F.length("piece")).otherwise(F.lead("from").over(order)))
    parts = parts.withColumn("whole", F.min((F.col("from").isNotNull() & F.col("to").isNotNull()).cast("int")).over(Window.partitionBy("key")) == 1)
    # without a joint somewhere: the own part of every chunk, put together again
    lost = parts.where("not whole").withColumn("own", F.substring("piece", (F.lit(chunk) * F.col("k") - F.col("start") + 1).cast("int"), F.lit(chunk)))
    lost = lost.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "own"))).alias("all"))
    lost = lost.select(F.struct("key").alias("kept"), F.array_join(F.transform("all", lambda x: x["own"]), "").alias("text"))
    lost = lost.mapInArrow(tidy(short), "kept struct<key:string>, ids binary").select("kept.key", "ids")
    done = parts.where("whole").select("key", "k", "start", "piece", "from", "to").mapInArrow(tidy(piecewise), "key string, k int, ids binary")
    done = done.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("all"))
    done = done.select("key", F.aggregate("all", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    long = long.select("key", "kept").join(done.unionByName(lost), "key").select("kept", "ids")
    out = brief.unionByName(long)
    return out.select("kept.*", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def decoded(rows: DataFrame, ranks: bytes, pattern: str, ids: str = "ids") -> DataFrame:
    """rows with a column of packed ids -> the same, with `bytes` instead of it.  Null ids count as none."""
    spark = rows.sparkSession
    small_batches(spark)
    said = spark.sparkContext.broadcast(ranks)
    rest = [c for c in rows.columns if c != ids]
    flat = rows.select(F.struct(*rest).alias("kept"), ids)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = codec(said.value, pattern)
        for b in batches:
            out = [encoding.decode_bytes(np.frombuffer(x or b"", dtype="<u4").tolist()) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("kept"), pa.array(out, pa.binary())], ["kept", "bytes"])

    kept_type = flat.schema["kept"].dataType.simpleString()
    return flat.mapInArrow(tidy(joined), f"kept {kept_type}, bytes binary").select("kept.*", "bytes")


def as_ids(packed: Column) -> Column:
    """Packed ids as array<bigint>."""
    byte = lambda i, k: F.conv(F.hex(F.substring(packed, i * 4 + k + 1, F.lit(1))), 16, 10).cast("long")
    one = lambda i: byte(i, 0) + byte(i, 1) * 256 + byte(i, 2) * 65536 + byte(i, 3) * 16777216
    n = (F.octet_length(packed) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<bigint>"))


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, **how) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the ids, and the bytes that they give again, as digests."""
    rows = encoded(docs, ranks, pattern, **how)
    rows = rows.select("doc_id", "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"), "ids")
    rows = decoded(rows, ranks, pattern)
    return rows.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("bytes"), 256).alias("decoded_sha256"))
