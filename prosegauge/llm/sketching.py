"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so its length scales with the
document, sketches of parts merge by union, and both resemblance and containment can be estimated between
documents of very unequal length.  All of it is Spark expressions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegauge.llm.common import whole

SHINGLE = 5
#: One hash in so many is kept.
SCALE = 8
#: Rows of a run of neighbouring doc_ids that share a window task, about, and the most runs: a square.
ROWS_PER_RUN, MOST_RUNS = 512, 1 << 14


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(w: Column, k: int = SHINGLE) -> Column:
    """Hashes of every run of k words, chained word by word; of the whole text if it is shorter."""
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))
    return F.when(n >= k, runs).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def sketch(hashes: Column, scale: int = SCALE) -> Column:
    """Hashes under the threshold, sorted; the least one alone if none is, so only wordless texts have none."""
    limit = (1 << 64) // scale - (1 << 63)
    low = F.filter(hashes, lambda h: h < F.lit(limit))
    least = F.filter(F.array(F.array_min(hashes)), lambda h: h.isNotNull())
    return F.array_sort(F.array_distinct(F.when(F.exists(hashes, lambda h: h < F.lit(limit)), low).otherwise(least)))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of the union of two sets of hashes, from their sketches.

    A hash at or over the threshold is the least one of a set that has none below it, so it goes as soon as the
    union has one below, and otherwise the lesser of two such stays: merging loses nothing.
    """
    return sketch(F.concat(a, b), scale)


def resemblance(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """The share of the smaller one that the larger one has."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, (F.size(a) == F.size(b)).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / least)


def written(s: Column, scale: int = SCALE) -> Column:
    return F.concat(F.lit(f"{scale}:"), F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), ""))


def with_sketch(df: DataFrame, text: str, out: str, scale: int = SCALE) -> DataFrame:
    # steps in selects of their own: each is used more than once, and so is computed once
    df = df.withColumn("__w", words(F.col(text))).withColumn("__h", shingle_hashes(F.col("__w")))
    return df.withColumn(out, sketch(F.col("__h"), scale)).drop("__w", "__h")


def _runs(rows: DataFrame) -> Column:
    """The number of a row's run: by quantiles of doc_id, whatever gaps ids have.

    An id that several bounds fall on has many rows; those are divided by digest of their text, as are rows
    without an id, whose runs are numbered below 0.
    """
    n, nulls = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    digest = F.conv(F.substring(F.sha2("text", 256), 1, 8), 16, 10).cast("long")
    without = max(1, min(MOST_RUNS, nulls // ROWS_PER_RUN))
    # in the order of next_rows(): ids descending, digests ascending
    run = -1 - F.shiftright(digest * F.lit(without), 32)
    wanted = min(MOST_RUNS, (n - nulls) // ROWS_PER_RUN)
    if wanted < 2:
        return F.when(F.col("doc_id").isNull(), run).otherwise(F.lit(0).cast("long"))
    bounds = rows.agg(F.percentile_approx("doc_id", [k / wanted for k in range(1, wanted)], 4 * wanted)).first()[0]
    # two steps of about sqrt(wanted) comparisons each
    width = max(1, int(len(bounds) ** 0.5))
    tops = [bounds[at] for at in range(0, len(bounds), width)]
    count = lambda a, test: F.size(F.filter(a, test)).cast("long")
    array = lambda x: F.from_json(F.lit(json.dumps(x)), "array<bigint>")
    lists = F.from_json(F.lit(json.dumps([bounds[at : at + width] for at in range(0, len(bounds), width)])), "array<array<bigint>>")

    def below(inclusive: bool) -> Column:
        test = (lambda b: b <= F.col("doc_id")) if inclusive else (lambda b: b < F.col("doc_id"))
        top = count(array(tops), test)
        inner = F.when(top > 0, count(F.element_at(lists, F.greatest(top, F.lit(1)).cast("int")), test)).otherwise(F.lit(0))
        return F.when(top > 0, (top - 1) * width + inner).otherwise(F.lit(0).cast("long"))

    repeats = len(set(bounds)) < len(bounds)
    if not repeats:
        own = below(True)
    else:
        low, high = below(False), below(True)
        own = high - F.shiftright(digest * F.greatest(high - low, F.lit(1).cast("long")), 32)
    return F.when(F.col("doc_id").isNull(), run).otherwise(own)


def next_rows(rows: DataFrame, payload: str) -> tuple[DataFrame, DataFrame]:
    """rows (doc_id, payload) -> the rows with their run, dealt by run; and the last row of each run with `next`.

    The order is by doc_id, descending, then digest of the payload.  A row's next one is in its run, but for the
    last, whose next one is the head of the run below, round to the first.  Rows move once, to their runs.
    """
    rows = rows.withColumn("run", _runs(rows))
    rows = rows.repartition("run")
    order = F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id").cast("decimal(20,0)")).alias("id"), F.sha2(payload, 256).alias("digest"))
    ends = rows.groupBy("run").agg(F.min_by(payload, order).alias("head"), F.max_by(F.struct("doc_id", payload), order).alias("last"))
    down = Window.orderBy(F.col("run").desc())  # one row for each run: at most twice MOST_RUNS
    around = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    names = rows.groupBy("run").agg(F.lit(1).alias("one"))
    names = names.select(F.col("run").alias("above"), F.coalesce(F.lead("run").over(down), F.first("run").over(around)).alias("run"))
    heads = ends.select("run", F.col("head").alias("next")).join(names, "run").select(F.col("above").alias("run"), "next")
    last = ends.select("run", "last.*").join(heads, "run").drop("run")
    return rows, last


def fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """docs (doc_id, text) -> the fingerprint of each text and of its edited text, and their likeness.

    Null text counts as empty; texts without words have an empty sketch, alike only to each other.  Very long
    texts are read whole, and their sketch grows with them.  Rows that repeat a doc_id follow each other by the
    digest of their text; null ids come last.  A single row is its own next one.  An empty table gives an empty
    result; other columns aren't read.
    """
    rows, last = next_rows(docs.select("doc_id", whole(F.col("text")).alias("text")), "text")
    order = Window.partitionBy("run").orderBy(F.col("doc_id").desc_nulls_last(), F.sha2("text", 256))
    # each sketch is made once, between the exchange and the window
    inner = with_sketch(rows, "text", "sketch", scale)
    inner = inner.withColumn("next", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order)).where("next is not null")
    last = with_sketch(with_sketch(last, "text", "sketch", scale), "next", "next_sketch", scale)
    names = ["doc_id", "text", "next", "sketch", "next_sketch"]
    rows = inner.select(*names).unionByName(last.select(*names))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half)))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "edited", "sketch", "next_sketch")
    rows = with_sketch(rows, "edited", "edited_sketch", scale)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("sketch"), scale).alias("fingerprint"),
        written(F.col("edited_sketch"), scale).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("contained_next"),
    )
