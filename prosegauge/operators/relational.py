"""Snapshots, pairs, ranges, clones, distributions, lift: joins and aggregates over findings and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegauge.functions import text as T

# --- snapshots: (hash, code) ---------------------------------------------------


def snapshot(items: DataFrame) -> DataFrame:
    """items (hash, rule) -> hash, code: what is known."""
    return items.select("hash", T.rule_code(F.col("rule")).alias("code")).distinct()


def new_findings(items: DataFrame, known: DataFrame) -> DataFrame:
    return items.withColumn("code", T.rule_code(F.col("rule"))).join(known, ["hash", "code"], "left_anti")


def fixed(items: DataFrame, known: DataFrame) -> DataFrame:
    """Known ones that are gone."""
    return known.join(snapshot(items), ["hash", "code"], "left_anti")


def keep(known: DataFrame, items: DataFrame) -> DataFrame:
    return known.unionByName(snapshot(items)).distinct()


def snapshot_lines(known: DataFrame) -> DataFrame:
    """hash, line: the lines of a snapshot file, codes in order."""
    codes = known.groupBy("hash").agg(F.array_join(F.array_sort(F.collect_set("code")), "\t").alias("codes"))
    return codes.select("hash", F.concat_ws("\t", "hash", "codes").alias("line"))


def parse_snapshot(lines: DataFrame, version: int = 3, line: str = "line") -> DataFrame:
    """Lines of a file of version 1 (hash, rule, path), 2 (hash, rules) or 3 (hash, codes) -> hash, code."""
    fields = F.split(line, "\t", -1)
    rows = lines.where((F.col(line) != "") & ~F.col(line).startswith("#")).withColumn("f", fields)
    rows = rows.withColumn("f", F.when(F.size("f") < 2, F.raise_error(F.concat(F.lit("expected a hash and at least one rule code: "), F.col(line)))).otherwise(F.col("f")))
    rest = F.slice("f", 2, 1) if version == 1 else F.slice("f", F.lit(2), F.size("f") - 1)
    rows = rows.select(F.col("f")[0].alias("hash"), F.explode(rest).alias("rule"))
    return rows.select("hash", (F.col("rule") if version == 3 else T.rule_code(F.col("rule"))).alias("code")).distinct()


# --- joins ---------------------------------------------------------------------


def touching(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Blocks that overlap a range of their file: an equi-join on the file, then the interval test."""
    b, r = blocks.alias("b"), ranges.alias("r")
    return b.join(r, (F.col("b.file") == F.col("r.file")) & (F.col("r.from_line") <= F.col("b.end")) & (F.col("b.start") <= F.col("r.to_line")), "left_semi")


def copies(blocks: DataFrame) -> DataFrame:
    """blocks (hash, ...) -> with how many have the same hash; counted first, so a common text is no hot window."""
    n = blocks.groupBy("hash").agg(F.count("*").alias("copies"))
    return blocks.join(n, "hash")


def pair_match(old: DataFrame, new: DataFrame) -> DataFrame:
    """Blocks of two versions, first to first, by file and the code below: file, next, place, old_text, new_text, kind."""
    order = Window.partitionBy("file", "next").orderBy("start")
    a = old.select("file", "next", F.row_number().over(order).alias("place"), F.col("text").alias("old_text"))
    b = new.select("file", "next", F.row_number().over(order).alias("place"), F.col("text").alias("new_text"))
    both = a.join(b, ["file", "next", "place"], "full_outer")
    kind = F.when(F.col("old_text").isNull() | F.col("new_text").isNull(), "lost").when(F.col("old_text") == F.col("new_text"), "same").otherwise("pair")
    return both.withColumn("kind", kind)


def rescan(items: DataFrame, blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Items (file, hash, start, end, ...) after `files` were read again, with `blocks` in them now.

    A block is found by its hash, the last of equal ones; its lines are updated.  One that isn't there any more
    is done.  Items of other files stay as they are.
    """
    now = blocks.groupBy("file", "hash").agg(F.max(F.struct("start", "end")).alias("__now"))
    rows = items.join(files.select("file", F.lit(True).alias("__read")).distinct(), "file", "left").join(now, ["file", "hash"], "left")
    rows = rows.withColumn("start", F.coalesce("__now.start", "start")).withColumn("end", F.coalesce("__now.end", "end"))
    gone = F.coalesce("__read", F.lit(False)) & F.col("__now").isNull()
    done = gone | F.col("done") if "done" in items.columns else gone
    return rows.withColumn("done", done).drop("__now", "__read")


def merge_spans(spans: DataFrame) -> DataFrame:
    """spans (file, start, end, own_line) -> neighbours that have their lines to themselves, as one."""
    order = Window.partitionBy("file").orderBy("start", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    joins = F.col("own_line") & F.lag("own_line").over(order) & (F.col("start") <= F.max("end").over(before) + 1)
    rows = spans.withColumn("island", F.sum(F.when(joins, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("file", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("own_line").alias("own_line"), F.count("*").alias("spans")).drop("island")


def batch(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (hash, file, place, ...) on blocks: by hash and file, else by hash; of several the last one."""
    last = lambda keys: Window.partitionBy(*keys).orderBy(F.col("place").desc())
    exact = edits.where("file is not null").withColumn("n", F.row_number().over(last(["hash", "file"]))).where("n = 1").select("hash", "file", F.col("action").alias("own"))
    loose = edits.where("file is null").withColumn("n", F.row_number().over(last(["hash"]))).where("n = 1").select("hash", F.col("action").alias("any"))
    rows = blocks.join(exact, ["hash", "file"], "left").join(loose, "hash", "left")
    return rows.withColumn("action", F.coalesce("own", "any")).where("action is not null").drop("own", "any")


def lost_edits(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits that no block is meant by: the caller reports them as errors, nothing is lost silently."""
    exact = edits.where("file is not null").join(blocks.select("hash", "file").distinct(), ["hash", "file"], "left_anti")
    loose = edits.where("file is null").join(blocks.select("hash").distinct(), "hash", "left_anti")
    return exact.unionByName(loose)


# --- clones ---------------------------------------------------------------------


def clones(files: DataFrame, window: int = 5, least: int = 3) -> DataFrame:
    """files (key, text) -> key, loc, marked: significant lines that are in a window of lines seen before.

    Windows are made within each row's array; the only shuffles are by window hash, with a partial minimum
    first, so a common window is no hot task.
    """
    lines = F.filter(F.transform(T.lines(F.col("text")), T.trimmed), lambda s: F.length(s) > least)
    rows = files.select("key", lines.alias("l"))
    n = F.size("l") - (window - 1)
    cut = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(k.alias("at"), F.sha1(F.array_join(F.slice("l", k, window), "\n").cast("binary")).alias("h")))).otherwise(F.array().cast("array<struct<at:int,h:string>>"))
    windows = rows.select("key", F.explode(cut).alias("w")).select("key", "w.at", "w.h")
    first = windows.groupBy("h").agg(F.min(F.struct("key", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    seen = windows.join(first, "h").where(F.struct("key", "at") != F.col("first"))
    marked = seen.select("key", F.explode(F.sequence(F.col("at"), F.col("at") + window - 1)).alias("line")).distinct().groupBy("key").agg(F.count("*").alias("marked"))
    return rows.select("key", F.size("l").cast("long").alias("loc")).join(marked, "key", "left").select("key", "loc", F.coalesce("marked", F.lit(0)).cast("long").alias("marked"))


# --- distributions ----------------------------------------------------------------


def percentiles(values: DataFrame, of: list[int], by: list[str] = (), value: str = "value") -> DataFrame:
    """by, p, value: the sorted values' entry at min(n * p / 100, n - 1), whole-number division.

    Counted by value first: what is ordered is the distinct values, not the rows.
    """
    counts = values.groupBy(*by, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)]).orderBy(value)
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("n").over(Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)]))
    rows = counts.withColumn("upto", upto).withColumn("total", total).withColumn("p", F.explode(F.lit(of)))
    at = F.least(F.floor(F.col("total") * F.col("p") / 100), F.col("total") - 1)
    hit = rows.where((at < F.col("upto")) & (at >= F.col("upto") - F.col("n")))
    return hit.select(*by, "p", F.col(value).alias("value"))


def histogram(values: DataFrame, edges: list[int], value: str = "value") -> DataFrame:
    """bucket, n: how many fall up to each edge; the last bucket is open."""
    label, low = F.lit(f"{edges[-1] + 1}+"), 0
    for k in range(len(edges) - 1, -1, -1):
        low = edges[k - 1] if k else 0
        name = str(edges[k]) if edges[k] - low <= 1 else f"{low + 1}-{edges[k]}"
        label = F.when(F.col(value) <= edges[k], name).otherwise(label)
    return values.groupBy(label.alias("bucket")).agg(F.count("*").alias("n"))


def cost(values: DataFrame, limits: list[int], value: str = "value") -> DataFrame:
    """limit, over, share: what would be a finding at each limit."""
    sums = values.agg(F.count("*").alias("n"), *[F.count_if(F.col(value) > x).alias(f"o{x}") for x in limits])
    rows = sums.select(F.explode(F.array(*[F.struct(F.lit(x).alias("limit"), F.col(f"o{x}").alias("over"), F.col("n")) for x in limits])).alias("r")).select("r.*")
    return rows.select("limit", "over", F.when(F.col("n") > 0, F.col("over") * 100.0 / F.col("n")).otherwise(F.lit(0.0)).alias("share"))


# --- lift -------------------------------------------------------------------------


def lift(found: DataFrame, sides: DataFrame, least: int = 20) -> DataFrame:
    """found (doc_id, side, category, rule, hard, count), sides (side, words, docs) -> name, ai, human, lift, human_share.

    A row for each rule and, as [Category], for each category of soft rules; hits and documents in one pass
    of two levels, so no distinct count is needed.
    """
    per = found.select("doc_id", "side", "count", F.explode(F.when(F.col("hard"), F.array("rule")).otherwise(F.array("rule", F.concat(F.lit("["), F.col("category"), F.lit("]"))))).alias("name"))
    per = per.groupBy("name", "side", "doc_id").agg(F.sum("count").alias("hits"))
    per = per.groupBy("name").agg(
        *[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("hits"))), F.lit(0)).cast("long").alias(f"{s}_hits") for s in ("ai", "human")],
        F.count_if(F.col("side") == "human").alias("human_docs"),
    )
    # both sides as one row, by which every name is divided
    side = lambda s, c: F.coalesce(F.max(F.when(F.col("side") == s, F.col(c))), F.lit(0))
    whole = sides.groupBy(F.lit(1).alias("one")).agg(*[side(s, c).alias(f"{s}_{n}") for s in ("ai", "human") for c, n in (("words", "words"), ("docs", "all"))])
    per = per.where(F.col("ai_hits") + F.col("human_hits") >= least).withColumn("one", F.lit(1)).join(F.broadcast(whole), "one")
    rate = lambda s: F.col(f"{s}_hits") * 100000.0 / F.greatest(F.col(f"{s}_words"), F.lit(1))
    return per.select("name", "ai_hits", "human_hits", rate("ai").alias("ai_rate"), rate("human").alias("human_rate"), F.when(F.col("human_hits") > 0, rate("ai") / rate("human")).alias("lift"), (F.col("human_docs") * 100.0 / F.greatest(F.col("human_all"), F.lit(1))).alias("human_share"))


def inherited(own: Column, category: Column) -> Column:
    return F.coalesce(F.when(own != 0, own), category, F.lit(0.0))
