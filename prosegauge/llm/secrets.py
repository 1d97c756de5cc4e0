"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by its content.  The ledger says which (blob, rule version) pairs were
scanned and what they gave; a run scans only pairs that it lacks, adds them, and joins findings back to all
paths that have the blob.  Regexes, positions and joins are Spark expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegauge.llm.common import staged, whole, work_folder


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regex that matches without overlap, and what a match must also meet."""

    kind: str
    version: int
    regex: str
    group: int = 0  # of this group ...
    least: int = 0  # ... so many characters at least


#: hex and access runs are maximal, so their least length can stand in the regex; for assign it can't: a
#: match that is too short still uses up its characters.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{24,}"),
)


def spans(blobs: DataFrame, rules: tuple[Rule, ...], wanted: dict[Rule, Column]) -> DataFrame:
    """blobs (blob, text) -> blob, kind, version, spans: array<struct<start, end>> in code points, by start.

    Every regex runs over a text a fixed number of times.  Matches stand where the pieces between them say; the
    running sum over pieces is a window over the rows of one blob and rule, so time is linear in the matches
    but for the sort.
    """
    lengths = lambda a: F.transform(a, lambda x: F.length(x))

    def parts(r: Rule) -> Column:
        found = lambda group: lengths(F.regexp_extract_all("text", F.lit(r.regex), F.lit(group)))
        each = F.arrays_zip(lengths(F.split("text", r.regex, -1)).alias("gap"), found(0).alias("n"), found(r.group).alias("said"))
        each = F.when(F.regexp_like("text", F.lit(r.regex)), each)  # most texts have no match, and are read once
        return F.when(wanted[r], F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"), each.alias("each")))

    rows = blobs.select("blob", F.explode(F.array(*[parts(r) for r in rules])).alias("f")).where("f is not null")
    rows = rows.select("blob", "f.kind", "f.version", "f.least", F.posexplode_outer("f.each").alias("at", "x"))
    rows = rows.select("blob", "kind", "version", "least", "at", F.col("x")["gap"].alias("gap"), F.col("x")["n"].alias("n"), F.col("x")["said"].alias("said"))
    upto = Window.partitionBy("blob", "kind", "version").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.coalesce("n", F.lit(0))).over(upto).cast("int"))
    # the piece after the last match has none of its own
    span = F.when(F.col("said") >= F.col("least"), F.struct((F.col("end") - F.col("n")).alias("start"), F.col("end").alias("end")))
    return rows.groupBy("blob", "kind", "version").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def scan(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs (doc_id, text) -> doc_id, found: array<struct<start, place, end, kind>> by start, then kind as listed.

    ledger: a folder that keeps (blob, kind, version, spans) from run to run; a new one if None.  Null text
    is the empty blob.  Paths may repeat, and each of their rows gets the findings; a pair that stands twice in
    the ledger counts once.  Very long texts are scanned whole, in time linear in their length and matches.  An
    empty table gives an empty result; other columns aren't read.
    """
    spark = docs.sparkSession
    ledger = ledger or f"{work_folder(spark)}/ledger"
    text = whole(F.col("text"))
    blobs = docs.select(F.sha2(text, 256).alias("blob"), text.alias("text")).distinct()
    try:
        known = spark.read.parquet(ledger)
    except AnalysisException:
        known = None
    wanted = {r: F.lit(True) for r in rules}
    if known is not None:
        scanned = known.groupBy("blob").agg(F.collect_set(F.concat_ws("/", "kind", "version")).alias("scanned"))
        blobs = blobs.join(scanned, "blob", "left")
        wanted = {r: ~F.coalesce(F.array_contains("scanned", f"{r.kind}/{r.version}"), F.lit(False)) for r in rules}
        blobs = blobs.where(F.greatest(*[w.cast("int") for w in wanted.values()]) == 1)
    new = spans(blobs, rules, wanted)
    new.write.mode("append").parquet(ledger)
    place = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(f"{r.kind}/{r.version}"), F.lit(k))])
    findings = spark.read.schema(new.schema).parquet(ledger).withColumn("place", place[F.concat_ws("/", "kind", "version")])
    # two runs at once may both have scanned a pair
    findings = findings.where("place is not null and size(spans) > 0").dropDuplicates(["blob", "kind", "version"])
    each = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("place").alias("place"), s["end"].alias("end"), F.col("kind").alias("kind")))
    findings = findings.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(each))).alias("found"))
    findings = staged(findings, f"{work_folder(spark)}/findings")
    paths = docs.select("doc_id", F.sha2(text, 256).alias("blob"))
    none = F.array().cast(findings.schema["found"].dataType)
    return paths.join(findings, "blob", "left").select("doc_id", "blob", F.coalesce("found", none).alias("found"))


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What the query returns of scan()'s rows."""
    joined = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in rules], F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))
