"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints of 64 bits link when at most three bits differ.  They are cut into four blocks of 16; three
errors leave one block whole, the anchor.  The other 48 bits are two words of 24, and one of these has at most
one error.  The extended Golay code [24, 12, 8] puts every such word within three bits of one codeword, or
four bits from exactly six; two words that differ in one bit at most share one of these codewords.  So
(anchor, codeword index) keys, about 25 a fingerprint and 31 bits long, bring every linked pair together; the
pairs that share a key are verified.

Equal fingerprints are one node.  A key that many fingerprints share is worked on in blocks, and gives a
spanning forest of its links instead of all of them.  Components come from alternating star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import dropped, small_batches, staged, tidy, whole, work_folder

SHINGLE, BITS, ERRORS = 3, 64, 3
#: A key with more fingerprints than this is compared in blocks of BLOCK.
HOT_KEY, BLOCK = 128, 512
#: The generator polynomial of the binary Golay code.
GENERATOR = 0b110001110101


def fingerprint(data: bytes) -> int:
    """Majority of each bit over the XXH64 hashes (seed 42) of the word shingles; 0 without words.

    bytes.lower() changes A-Z alone, and bytes.split() cuts at ASCII white space alone.
    """
    import xxhash

    words = data.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        words = [b" ".join(words)]
        shingles, n = iter(words), 1
    else:
        shingles, n = map(b" ".join, zip(words, words[1:], words[2:], strict=False)), len(words) - SHINGLE + 1
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(42))
    counts, left = np.zeros(BITS, dtype=np.int64), n
    while left:
        take = min(left, 1 << 16)
        h = np.fromiter(hashes, dtype=np.uint64, count=take)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        left -= take
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """check[info]: the 12 check bits of a codeword; and for each syndrome the nearest error words and how many."""
    check = np.zeros(4096, dtype=np.int64)
    for info in range(4096):
        rest = info << 11
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= GENERATOR << (bit - 11)
        word = info << 11 | rest
        check[info] = rest << 1 | word.bit_count() & 1
    errors = np.zeros((4096, 6), dtype=np.int64)
    found = np.zeros(4096, dtype=np.int64)
    weight = np.full(4096, 9)
    for w in range(5):
        for places in combinations(range(24), w):
            e = sum(1 << p for p in places)
            s = int(check[e >> 12]) ^ (e & 4095)
            if weight[s] < w:
                continue
            weight[s] = w
            errors[s, found[s]] = e
            found[s] += 1
    return check, errors, found


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place of its fingerprint) for all keys of unsigned fingerprints."""
    check, errors, found = golay()
    fps = fps.astype(np.uint64)
    blocks = [((fps >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64) for k in range(4)]
    out, of = [], []
    for anchor in range(4):
        a, b, c = (blocks[k] for k in range(4) if k != anchor)
        rest = a | b << 16 | c << 32
        for half in range(2):
            word = rest >> (24 * half) & 0xFFFFFF
            s = check[word >> 12] ^ (word & 4095)
            for nth in range(6):
                on = np.flatnonzero(found[s] > nth)
                index = (word[on] ^ errors[s[on], nth]) >> 12
                out.append((anchor * 2 + half) << 28 | blocks[anchor][on] << 12 | index)
                of.append(on)
    return np.concatenate(out), np.concatenate(of)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", whole(F.col("text")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fps), 20_000):
            part = fps[at : at + 20_000]
            k, of = keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(part[of].view(np.int64))], ["key", "fp"])


def _forest(group: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links among the fingerprints of two blocks."""
    fps = np.unique(group["fp"].to_numpy(dtype=np.int64).view(np.uint64))
    root = np.arange(len(fps))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x in range(len(fps)):
        for y in np.flatnonzero(np.bitwise_count(fps[x + 1 :] ^ fps[x]) <= ERRORS) + x + 1:
            a, b = top(x), top(int(y))
            if a != b:
                root[b] = a
                out.append((fps[x], fps[y]))
    pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})


def links(fps: DataFrame, folder: str) -> DataFrame:
    """fps (fp, distinct) -> u, v: enough links to join what is linked."""
    all_keys = staged(fps.select("fp").mapInArrow(tidy(_keyed), "key long, fp long"), f"{folder}/keys")
    shared = all_keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = staged(all_keys.join(shared, "key"), f"{folder}/shared")
    cold = rows.where(F.col("n") <= HOT_KEY)
    a, b = cold.select("key", F.col("fp").alias("u")), cold.select("key", F.col("fp").alias("v"))
    x = "(u ^ v)"
    mask = lambda k: f"{x} & {np.uint64(0xFFFF << 16 * k).astype(np.int64)}L"
    anchor, half = "shiftright(key, 29)", "shiftright(key, 28) & 1"
    # a pair counts at its first whole block and first nearly whole half alone
    first = " and ".join(f"({anchor} <= {k} or ({mask(k)}) != 0)" for k in range(3))
    low = "case {a} when 0 then shiftrightunsigned({x}, 16) & 16777215 when 1 then ({x} & 65535) | (shiftrightunsigned({x}, 16) & 16711680) else {x} & 16777215 end".format(a=anchor, x=x)
    nearly = f"({half} = 0 or bit_count({low}) > 1)"
    pairs = a.join(b, (a["key"] == b["key"]) & F.expr("u < v")).drop(b["key"])
    pairs = pairs.where(F.expr(f"bit_count({x}) <= {ERRORS} and {first} and {nearly}")).select("u", "v")
    hot = rows.where(F.col("n") > HOT_KEY).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    hot = hot.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    hot = hot.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    forests = hot.groupBy("key", "i", "j").applyInPandas(_forest, "u long, v long")
    return pairs.unionByName(forests).distinct()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """edges (u, v) -> node, label: the least node that can be reached.  Nodes without an edge aren't there.

    Large star, then small star, until nothing changes; every round is a table in the shared folder.
    """
    spark = edges.sparkSession
    edges = staged(edges.where("u != v").select("u", "v"), f"{folder}/edges")
    mark, k = None, 0
    while True:
        k += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = staged(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), f"{folder}/large{k}")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
        dropped(spark, f"{folder}/large{k - 1}", f"{folder}/small{k - 2}")
        edges = staged(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{folder}/small{k}")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def near_groups(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp, component_id: the least doc_id that links lead to, itself included.

    Null text counts as empty; texts without words have fingerprint 0 and link like any other.  Rows may
    repeat; a null id is nobody's least one, unless there is no other.  An empty table gives an empty
    result; other columns aren't read.
    """
    folder = work_folder(docs.sparkSession)
    rows = staged(fingerprinted(docs), f"{folder}/fps")
    fps = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{folder}/distinct")
    labels = staged(components(links(fps, folder), folder), f"{folder}/labels")
    dropped(docs.sparkSession, f"{folder}/keys", f"{folder}/shared", f"{folder}/edges")
    linked = fps.join(labels, fps["fp"] == labels["node"]).select("fp", "label", "least")
    groups = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    linked = linked.join(groups, "label").select("fp", "component_id")
    named = fps.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    named = staged(named, f"{folder}/named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without all but one document of each group: the one with the least doc_id.

    Of rows that repeat this doc_id one stays.  Rows without an id can't be named, and stay.
    """
    kept = near_groups(docs).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).join(kept, "doc_id", "left_semi")
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))
