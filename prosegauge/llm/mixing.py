"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source size.  Documents
stand in a fixed order within their source; the running sum of expected copies, shifted by one random
offset, gives a copy at every integer it passes.  The order is by size, so by summation by parts the
words taken from a source miss its target by about its largest document at most.

The running sum is rate * rank, and ranks are distributed: cells of (source, size class, salt) are
counted, prefix-summed and joined back, so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegauge.llm.common import WORD, offsets, staged, work_folder

#: Documents of one source and size class are spread over this many cells, by a hash of their id.
SALTS = 1 << 12


def size_of(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Octaves of size, eight steps to each: whole-number arithmetic, alike in every engine."""
    octave = F.length(F.bin(size)).cast("long")
    step = octave * 8 + F.pmod(F.expr("shiftright(__size, cast(length(bin(__size)) as int) - 4)"), F.lit(8))
    return F.when(size < 16, size).otherwise(F.coalesce(step, F.lit(0).cast("long")))


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, ceiling: float) -> DataFrame:
    """sources: (key, source_size), one row a source -> with target and offset.

    Weights repeat in order of key.  Water level: the level L with sum(min(w L, cap)) = share * total,
    found in closed form at the sorted break points cap / w.  A mix is a matter of sources, of which
    there are few; this table has one row for each.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("place", F.row_number().over(Window.orderBy("key")))
    s = s.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(ceiling)))
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("allw", F.sum("w").over(everything))
    up = Window.orderBy(F.col("cap") / F.col("w"), "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("capped", F.sum("cap").over(up)).withColumn("gone", F.sum("w").over(up))
    # the level if exactly the sources before this one are at their ceiling
    s = s.withColumn("level", (F.col("budget") - (F.col("capped") - F.col("cap"))) / (F.col("allw") - (F.col("gone") - F.col("w"))))
    s = s.withColumn("open", F.col("level") * F.col("w") < F.col("cap"))
    s = s.withColumn("water", F.min(F.when(F.col("open"), F.struct("gone", "level"))).over(everything)["level"])
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("w")))
    return s.withColumn("target", target).select("key", "source_size", "target")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, seed: int = 17, size: Column | None = None) -> DataFrame:
    """docs (doc_id, text, source, ...) -> row (struct of all columns), size, source_size, target, copies, taken.

    size: where it is known already, the column that has it; otherwise words are counted, in two passes.
    Null text has size 0; a source of size 0 has target 0 and gives nothing.  Null is a source, the last.
    Rows that repeat count one by one; an empty table gives an empty result.  Other columns ride along in
    `row`, so their names can't clash.  Null or repeated doc_id are only ties of the order.  A very long text
    is one row like any other, whose size may exceed its source's target: then it is taken or not, whole.
    """
    spark = docs.sparkSession
    # keys sort by code point (UTF-8 bytes do), null last.  Neither key, size nor salt can be null, or the join
    # on them would have the optimizer look for nulls first, and so count words once more
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.coalesce("source", F.lit(""))))
    number = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    salt = F.coalesce(number % F.lit(SALTS), F.lit(0).cast("long"))
    size = size_of(F.col("text")) if size is None else F.coalesce(size.cast("long"), F.lit(0).cast("long"))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(key, F.lit("1")).alias("key"), size.alias("__size"), F.col("doc_id").alias("__id"), salt.alias("salt"))
    rows = rows.withColumn("step", size_class(F.col("__size")))
    folder = work_folder(spark)
    cells = staged(rows.groupBy("key", "step", "salt").agg(F.count("*").alias("n"), F.sum("__size").alias("words")), f"{folder}/cells")
    plan = targets(cells.groupBy("key").agg(F.sum("words").alias("source_size")), weights, share, ceiling)
    plan = plan.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    plan = plan.withColumn("offset", u)
    cells = staged(offsets(cells.drop("words"), ["key"], ["step"], ["salt"], "n").join(plan, "key").drop("n"), f"{folder}/plan")
    place = F.row_number().over(Window.partitionBy("key", "step", "salt").orderBy("__size", F.col("__id").asc_nulls_first()))
    out = rows.withColumn("place", place).join(cells, ["key", "step", "salt"])
    rank = F.col("before") + F.col("place")
    upto = lambda k: F.floor(F.col("offset") + F.col("rate") * k.cast("double"))
    out = out.withColumn("copies", (upto(rank) - upto(rank - 1)).cast("long"))
    return out.select("row", F.col("__size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("__size")).alias("taken"))


def taken_rows(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix has them: each row as often as it is taken."""
    out = mixed(docs, **how).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
