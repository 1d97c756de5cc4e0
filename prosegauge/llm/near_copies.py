"""Near copies for the pipeline: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

The method is that of simhash.py, Golay-code fuzzy hashing of SimHash fingerprints, at a larger distance.  At 0.8
each bit of two fingerprints differs with chance acos(8/9) / pi, about 0.15, so a fingerprint has as many tables of
bits as such a pair needs to share a key but for a chance of MISSED.  In each table some bits are the anchor, and 24
are a word whose nearest codewords (one within three bits, or six at four) are found by their syndrome; (table,
anchor, codeword index) are the keys.  The anchor grows with the number of sets, and the number of tables with it, so
that few sets share a key by chance.  Of the sets that share a key, those whose sizes, or 128 bits that are in no key, are too
far apart are dropped; of the others each is first checked, on whole sets, with the nearest one before it alone.  Where
that leaves a key with more than one component, the sets of its nodes are open.  Two similar sets share one of the
first shingles of each, in any order that holds for all sets; with the shingles first that no two components
share, and then the rare ones, these are few.  So open sets meet again in those shingles, and pairs between components are
checked.  Nothing is lost by that, and a large group of texts that are much alike, but not alike enough, isn't compared
pair by pair.

Tables are worked through a few at a time, so what lies on disk at once is in proportion to the texts, and it holds
no sets but those that are checked; no texts but theirs are moved.  Equal sets are one node.  In a key that many sets
share, each is first compared with the first one and its neighbours only; a shingle that many sets share is worked on
in blocks.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegauge.llm.common import dropped, filtering_session, small_batches, staged, tidy, whole, work_folder
from prosegauge.llm.simhash import BLOCK, components, golay

SHINGLE = 5
#: In a key of more sets each is compared with the first one and WINDOW others, and then in blocks of BLOCK.
HOT_KEY, WINDOW = 1024, 64
#: Similarity of 4/5 or more, in whole numbers.
OVER, UNDER = 4, 5
#: The chance that two sets of just this similarity share no key.
MISSED = 0.001
#: Bits of a word; keys a word has on average; the chance that two words share one where each bit differs as at 0.8.
WORD_BITS, KEYS, SHARED = 24, 3.16, 0.38
#: Sets that share a key by chance, about, at most; and the least anchor.
BY_CHANCE, LEAST_ANCHOR = 64, 2
#: Of 64 and 128 bits, so many differ at most; at 0.8 it is 10 and 19 on average, with deviations of 3 and 4.
FAR_64, FAR = 27, 40
#: Tables whose keys are on disk at once.
TABLES_AT_ONCE = 8
#: What met() returns.
MET = "u long, v long, key long, node long, n long, a long, b long"
#: Rows of keys that are compared at once.
ROWS_AT_ONCE = 1 << 16


def shingles(data: bytes) -> np.ndarray:
    """XXH64 hashes of the distinct word shingles, in order; a shorter text is one shingle, one without words none."""
    import xxhash

    words = data.lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    if len(words) < SHINGLE:
        parts, n = iter([b" ".join(words)]), 1
    else:
        parts, n = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False)), len(words) - SHINGLE + 1
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), dtype=np.uint64, count=n).view(np.int64))


def similar(common, n, m):
    """Whether sets of n and m shingles, so many of them common, are similar enough."""
    return common * (OVER + UNDER) >= OVER * (n + m)


def _node(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.tobytes())


def width(anchor: int, tables: int) -> int:
    """Words of 64 bits that a signature has: those of the keys, and two that are in none."""
    return -(-tables * (anchor + WORD_BITS) // 64) + 2


def layout(n: int) -> tuple[int, int]:
    """Bits of the anchor and number of tables for n sets."""
    anchor = max(LEAST_ANCHOR, math.ceil(math.log2(max(1, n) * KEYS / (1 << 12) / BY_CHANCE)))
    alike = 1 - math.acos(2 * OVER / (OVER + UNDER)) / math.pi
    return anchor, math.ceil(math.log(MISSED) / math.log(1 - SHARED * alike**anchor))


def signature(s: np.ndarray, words: int) -> np.ndarray:
    """The SimHash of a set in 64 bits times `words`: majority of each bit over its shingles' hashes."""
    steps = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, len(s), 255):  # as many as a byte can count
        h = s[at : at + 255].view(np.uint64)[:, None] + steps
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        bits = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little")
        counts += bits.view(np.uint64).sum(axis=0).view(np.uint8)
    return np.packbits(counts * 2 > len(s), bitorder="little").view(np.uint64)


def signed(docs: DataFrame, words: int) -> DataFrame:
    """docs (doc_id, text) -> doc_id, digest, node (hash of the set), n (its size), bits (its signature)."""
    small_batches(docs.sparkSession)
    text = whole(F.col("text"))
    rows = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), text.cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, bits = [], [], []
            for data in b.column("data").to_pylist():
                s = shingles(data)
                nodes.append(_node(s))
                sizes.append(len(s))
                bits.append(signature(s, words).tobytes())
            nodes = np.array(nodes, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array(nodes), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())], ["doc_id", "digest", "node", "n", "bits"])

    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest binary, node long, n long, bits binary")


def keyed(nodes: DataFrame, anchor: int, tables: range) -> DataFrame:
    """nodes (node, n, bits) -> key, node, n, a, b: the keys of some tables; a and b are the last 128 bits, which are in no key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check, errors, found = golay()
        for batch in batches:
            if not len(batch):
                continue
            packed = np.frombuffer(b"".join(batch.column("bits").to_pylist()), dtype=np.uint8).reshape(len(batch), -1)
            node, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n"))
            last = np.ascontiguousarray(packed[:, -16:]).view(np.int64)
            flat = np.unpackbits(packed, axis=1, bitorder="little")
            keys, of = [], []
            for table in tables:
                at = table * (anchor + WORD_BITS)
                own = flat[:, at : at + anchor].astype(np.int64) @ (1 << np.arange(anchor, dtype=np.int64))
                word = flat[:, at + anchor : at + anchor + WORD_BITS].astype(np.int64) @ (1 << np.arange(WORD_BITS, dtype=np.int64))
                syndrome = check[word >> 12] ^ (word & 4095)
                for nth in range(6):
                    on = np.flatnonzero(found[syndrome] > nth)
                    keys.append((table << anchor | own[on]) << 12 | (word[on] ^ errors[syndrome[on], nth]) >> 12)
                    of.append(on)
            of = np.concatenate(of)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(keys), node[of], n[of], last[of, 0], last[of, 1])], ["key", "node", "n", "a", "b"])

    return nodes.mapInArrow(tidy(run), "key long, node long, n long, a long, b long")


def _near(x: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j and bits that differ: of places in the columns key, node, n, a, b (and component, left) those that may be similar."""
    on = np.bitwise_count((x[3][i] ^ x[3][j]).view(np.uint64)) <= FAR_64
    i, j = i[on], j[on]
    bits = sum(np.bitwise_count((x[k][i] ^ x[k][j]).view(np.uint64)).astype(np.int64) for k in (3, 4))
    n, m = x[2][i], x[2][j]
    on = (x[1][i] != x[1][j]) & (bits <= FAR) & (np.minimum(n, m) * UNDER >= OVER * np.maximum(n, m))
    if len(x) > 5:
        on &= (x[5][i] != x[5][j]) & similar(np.minimum(x[6][i], x[6][j]), n, m)
    return i[on], j[on], bits[on]


def met(rows: DataFrame, hot_key: int) -> DataFrame:
    """rows (key, node, n, a, b) -> u, v: pairs to check; and key, node, n, a, b of what may have more pairs.

    Of its pairs in a key, a node has that with the nearest one before it alone.  Where there are others, or a key
    has more than hot_key rows, its nodes come too.  Rows with two columns more, component and left (see shared()),
    have all their pairs between components instead, and no key may have too many to compare.
    """
    across = "component" in rows.columns
    names = rows.columns

    def pairs(x: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        both = np.unique(np.sort(np.stack([x[1][i], x[1][j]], axis=1), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), *[pa.nulls(len(both), pa.int64())] * 5], ["u", "v", *names[:5]])

    def compared(x: list[np.ndarray], hot: np.ndarray, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, found, at, step = x[0], [], np.arange(len(x[0])), 1
        while True:
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
            if step > WINDOW:
                at = at[~hot[at]]
            if not len(at):
                break
            found.append(_near(x, at, at + step))
            step += 1
        late = np.flatnonzero(hot & (np.arange(len(key)) > first + WINDOW))
        found.append(_near(x, first[late], late))
        i, j, bits = (np.concatenate(c) for c in zip(*found, strict=True))
        if across:
            yield pairs(x, i, j)
            return
        order = np.lexsort((bits, j))
        i, j = i[order], j[order]
        nearest = np.r_[True, j[1:] != j[:-1]][: len(j)]
        yield pairs(x, i[nearest], j[nearest])
        more = np.unique(np.concatenate([i, j]))
        more = more[np.isin(key[more], key[j[~nearest]]) & ~hot[more]]
        more = np.concatenate([more, np.flatnonzero(hot)])
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(more), pa.int64())] * 2, *[pa.array(c[more]) for c in x]], ["u", "v", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, open_key = [], 0, None  # a hot key that isn't over, of which the first row alone is still there

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal parts, size, open_key
            x = [np.concatenate(c) for c in zip(*parts, strict=True)]
            start = np.flatnonzero(np.r_[True, x[0][1:] != x[0][:-1]])
            length = np.diff(np.r_[start, len(x[0])])
            many = (length > hot_key) & (not across)
            if open_key is not None:
                many |= x[0][start] == open_key
            end, rest = len(x[0]), []
            if not last and many[-1]:
                rest, open_key = [c[start[-1] : start[-1] + 1] for c in x], x[0][start[-1]]
            elif not last:
                end, open_key = start[-1], None
                rest = [c[end:] for c in x]
            parts, size = [rest] if rest else [], len(rest[0]) if rest else 0
            if end:
                yield from compared([c[:end] for c in x], np.repeat(many, length)[:end], np.repeat(start, length)[:end])

        for batch in batches:
            if len(batch):
                parts.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
                size += len(batch)
            if size >= ROWS_AT_ONCE:
                yield from done(False)
        if size:
            yield from done(True)

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(tidy(run), MET)


def sets_of(texts: DataFrame) -> DataFrame:
    """texts (node, text) -> node, set."""
    rows = texts.select("node", F.col("text").cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x) for x in b.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    return rows.mapInArrow(tidy(run), "node long, set array<bigint>")


def _freed(spark: SparkSession) -> None:
    spark.sparkContext._jvm.System.gc()  # so that the files of shuffles that are over go


def _sets(docs: DataFrame, nodes: DataFrame, asked: DataFrame, folder: str) -> str:
    """The name of a table of node and set for the asked nodes, bucketed by node, in the folder.

    Sets are made from the texts each time, for they take more room.  A text is found by its digest, so that
    those that aren't asked for are left out before anything is moved, even where the asked ones can't be broadcast.
    """
    spark, name = docs.sparkSession, uuid.uuid4().hex
    wanted = staged(nodes.select("node", "digest", "n").join(asked, "node", "left_semi"), f"{folder}/wanted")
    own = filtering_session(spark)
    small_batches(own)
    docs.select(whole(F.col("text")).alias("text")).createGlobalTempView(f"texts_{name}")
    try:
        texts = own.table(f"global_temp.texts_{name}").withColumn("digest", F.unhex(F.sha2("text", 256)))
        # without a condition on what is wanted no filter is made of it
        texts = texts.join(own.read.schema(wanted.schema).parquet(f"{folder}/wanted").where("n > 0"), "digest").dropDuplicates(["node"])
        # bucketed, so that sets lie still when pairs come to them
        sets_of(texts).write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "node").option("path", f"{folder}/sets").saveAsTable(f"sets_{name}")
    finally:
        spark.catalog.dropGlobalTempView(f"texts_{name}")
    dropped(spark, f"{folder}/wanted")
    _freed(spark)
    return f"sets_{name}"


def _checked(pairs: DataFrame, table: str, folder: str) -> DataFrame:
    """Those of the pairs u, v whose whole sets, from the table, are similar; written to the folder.  The table goes."""
    spark = pairs.sparkSession
    sets = spark.table(table)
    # one set of each pair goes to the other
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("set_u")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("set_v")), "v")
    both = both.where(similar(F.size(F.array_intersect("set_u", "set_v")), F.size("set_u"), F.size("set_v")))
    both = staged(both.select("u", "v"), f"{folder}/links")
    spark.sql(f"drop table {table}")
    dropped(spark, *[f"{folder}/{x}" for x in ("sets", "pairs", "asked")])
    _freed(spark)
    return both


def shared(sets: DataFrame) -> DataFrame:
    """sets (node, n, component, set) -> key, node, n, component, left: the shingles in which sets of different components must meet.

    All sets have their shingles in one order: those of one component alone first, then the rarer ones.  left: how
    many of its set come from this one on, itself included; no set that has this shingle as the first common one has
    more in common.  Shingles with too few left for any set that has them aren't there.
    """
    flat = sets.select("node", "n", "component", F.explode("set").alias("key"))
    of = flat.groupBy("key").agg(F.count("*").alias("m"), F.min("n").alias("least"), F.min("component").alias("low"), F.max("component").alias("high"))
    flat = flat.join(of.where("low != high").select("key", "m", "least"), "key")
    flat = flat.withColumn("left", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("m"), F.desc("key"))).cast("long"))
    least = F.greatest(F.col("least"), F.ceil(F.col("n") * OVER / UNDER))
    return flat.where(similar(F.col("left"), F.col("n"), least)).select("key", "node", "n", "component", "left")


def _across(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows of shared(), nodes (node, a, b) -> u, v: pairs between components to check."""
    more = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    rows = rows.join(more.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "key").join(nodes.select("node", "a", "b"), "node")
    # keys of blocks are hashes: where two are equal, more is compared
    own, names = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), ["node", "n", "a", "b", "component", "left"]
    parted = rows.where("blocks > 1").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parted = parted.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), *names)
    rows = rows.where("blocks = 1").select("key", *names).unionByName(parted)
    return met(rows, HOT_KEY).select("u", "v").distinct()


def links(docs: DataFrame, nodes: DataFrame, anchor: int, tables: int, folder: str) -> DataFrame:
    """docs (text), nodes (node, digest of a text, n, bits; distinct) -> u, v: enough links to join the nodes of what is similar."""
    spark = docs.sparkSession
    paths = []
    for at in range(0, tables, TABLES_AT_ONCE):
        paths.append(f"{folder}/met{at}")
        staged(met(keyed(nodes.select("node", "n", "bits"), anchor, range(at, min(tables, at + TABLES_AT_ONCE))), HOT_KEY), paths[-1])
        _freed(spark)
    seen = spark.read.schema(MET).parquet(*paths)
    pairs = staged(seen.where("key is null").select("u", "v").distinct(), f"{folder}/nearest/pairs")
    asked = staged(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), f"{folder}/nearest/asked")
    found = _checked(pairs, _sets(docs, nodes, asked, f"{folder}/nearest"), f"{folder}/nearest")
    # what these links joined needn't be compared again
    rows = seen.where("key is not null").select("key", "node", "n", "a", "b").distinct()
    if not rows.isEmpty():
        labels = staged(components(found, f"{folder}/first"), f"{folder}/first/labels")
        rows = staged(rows.join(labels, "node", "left").withColumn("component", F.coalesce("label", "node")).drop("label"), f"{folder}/parts")
        more = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
        asked = staged(rows.join(more, "key", "left_semi").select("node", "n", "a", "b", "component").distinct(), f"{folder}/rest/asked")
        if not asked.isEmpty():
            table = _sets(docs, nodes, asked, f"{folder}/rest")
            rows = staged(shared(spark.table(table).join(asked.select("node", "n", "component"), "node")), f"{folder}/rest/shared")
            pairs = staged(_across(rows, asked), f"{folder}/rest/pairs")
            dropped(spark, f"{folder}/rest/shared")
            _freed(spark)
            found = found.unionByName(_checked(pairs, table, f"{folder}/rest"))
        dropped(spark, *[f"{folder}/{x}" for x in ("first", "parts")])
    dropped(spark, *paths)
    _freed(spark)
    return found


def near_groups(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, digest (of the text), node, component: equal for rows that links lead between.

    Null text counts as empty; texts without words are copies of each other.  Rows may repeat; an empty table
    gives an empty result; other columns aren't read.
    """
    spark = docs.sparkSession
    folder = work_folder(spark)
    small_batches(spark)
    anchor, tables = layout(docs.count())
    rows = staged(signed(docs, width(anchor, tables)), f"{folder}/signed")
    nodes = staged(rows.where("n > 0").select("node", "digest", "n", "bits").dropDuplicates(["node"]), f"{folder}/nodes")
    labels = staged(components(links(docs, nodes, anchor, tables, folder), folder), f"{folder}/labels")
    dropped(spark, *[f"{folder}/{x}" for x in ("nodes", "nearest", "rest", "edges")])
    return rows.select("doc_id", "digest", "node").join(labels, "node", "left").select("doc_id", "digest", "node", F.coalesce("label", "node").alias("component"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each group: the one with the least doc_id, then the least digest of its text.

    Only members of a group replace each other, whatever their ids; a row without an id comes after those with one.
    Of rows that have this id and text one stays.
    """
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("digest"))
    # one column names a row by text and id, so that texts move once
    name = F.concat(F.hex("digest"), F.when(F.col("doc_id").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("doc_id").cast("string"))))
    kept = near_groups(docs).groupBy("component").agg(F.min_by(F.struct("doc_id", "digest"), order).alias("kept")).select("kept.*")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.unhex(F.sha2(whole(F.col("text")), 256)).alias("digest"), "doc_id")
    rows = rows.select("row", name.alias("name")).join(kept.select(name.alias("name")), "name", "left_semi")
    return rows.groupBy("name").agg(F.first("row").alias("row")).select("row.*")
