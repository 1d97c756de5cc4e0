"""Source trees: which paths are read, what language they are in, listings of version control."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.functions import text as T

# Languages, skipped folders, marks of generated files.
LANGUAGES = {
    "c": [".c", ".h"],
    "cpp": [".cc", ".cpp", ".cxx", ".hh", ".hpp"],
    "go": [".go"],
    "ts": [".ts", ".tsx"],
    "js": [".js", ".jsx", ".mjs", ".cjs"],
    "svelte": [".svelte"],
    "swift": [".swift"],
    "java": [".java"],
    "kotlin": [".kt", ".kts"],
}
SKIP_DIRS = [".git", "node_modules", "vendor", "dist", "build", "bin", "gen", "coverage", "testdata", ".svelte-kit", ".next", "target", "Pods", ".reports", "bundle", ".rollup.cache", "__pycache__"]
GENERATED = r"(?m)^(//|#|/\*|\*)[ *]*(Code generated .* DO NOT EDIT|@generated)|^//[#@] sourceMappingURL="
HEAD, TAIL = 2048, 1024


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))


def lang_of(path: Column) -> Column:
    out = F.lit("")
    for name, ext in LANGUAGES.items():
        out = F.when(extension(path).isin(*ext), name).otherwise(out)
    return out


def is_markup(path: Column) -> Column:
    return extension(path).isin(".md", ".mdx", ".markdown")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def skipped(path: Column) -> Column:
    parts = F.split(path, "/", -1)
    return F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: x.isin(*SKIP_DIRS) | (x.startswith(".") & (x != ".")))


def glob_regex(glob: str) -> str:
    """`**/` any folders, `**` anything, `*` and `?` within one name."""
    out, k = [], 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out.append("(?:.*/)?")
            k += 3
        elif glob.startswith("**", k):
            out.append(".*")
            k += 2
        else:
            out.append("[^/]*" if glob[k] == "*" else "[^/]" if glob[k] == "?" else re.escape(glob[k]))
            k += 1
    return "^" + "".join(out) + "$"


def glob_match(path: Column, glob: str) -> Column:
    return T.matches(path, glob_regex(glob)) | T.matches(base_name(path), glob_regex(glob))


def allowed(path: Column, only: list[str] = (), ignore: list[str] = (), skip_tests: bool = False, exclude: list[str] = ()) -> Column:
    name, lang = base_name(path), lang_of(path)
    ok = (lang != "") & ~F.regexp_like(name, F.lit(r"(\.d\.ts|\.pb\.go|\.min\.js|\.bundle\.js)\z"))
    if only:
        ok = ok & lang.isin(*only)
    if ignore:
        ok = ok & ~lang.isin(*ignore)
    if skip_tests:
        ok = ok & ~(name.endswith("_test.go") | F.contains(name, F.lit(".test.")) | F.contains(name, F.lit(".spec.")))
    for glob in exclude:
        ok = ok & ~glob_match(path, glob)
    return ok


def generated(text: Column) -> Column:
    """Marks are looked for in the first 2048 and the last 1024 bytes."""
    data = text.cast("binary")
    n = F.octet_length(data)
    part = lambda start, size: F.decode(F.substring(data, start, size), "ISO-8859-1")
    return T.matches(part(F.lit(1), F.lit(HEAD)), GENERATED) | T.matches(part(F.greatest(F.lit(1), n - TAIL + 1), F.lit(TAIL)), GENERATED)


def parse_log(logs: DataFrame, column: str) -> DataFrame:
    """A log of `hash US subject US body RS` -> file, text: subject, and the body after an empty line."""
    rows = logs.select(F.explode(F.split(column, "\x1e", -1)).alias("r")).select(T.trimmed(F.col("r")).alias("r")).where("r <> ''")
    f = F.split("r", "\x1f", -1)
    rows = rows.where(F.size(f) >= 2).select(F.concat(F.lit("commit "), f[0]).alias("file"), f[1].alias("subject"), T.trimmed(F.coalesce(F.try_element_at(f, F.lit(3)), F.lit(""))).alias("body"))
    return rows.select("file", F.when(F.col("body") == "", F.col("subject")).otherwise(F.concat("subject", F.lit("\n\n"), F.col("body"))).alias("text"))


HUNK = r"(?m)^@@ -[0-9,]+ \+([0-9]+)(?:,([0-9]+))? @@"


def parse_hunks(diffs: DataFrame, column: str) -> DataFrame:
    """A diff without context -> with from_line and to_line of each hunk's new side; pure deletions have none."""
    at, n = T.find_all(F.col(column), HUNK, 1), T.find_all(F.col(column), HUNK, 2)
    rows = diffs.withColumn("h", F.explode(F.arrays_zip(at.alias("at"), n.alias("n"))))
    size = F.when(F.coalesce(F.col("h.n"), F.lit("")) == "", F.lit(1)).otherwise(F.expr("try_cast(h.n as int)"))
    rows = rows.withColumn("from_line", F.col("h.at").cast("int")).withColumn("to_line", F.col("from_line") + size - 1)
    return rows.where(F.col("to_line") >= F.col("from_line")).drop("h")


def parse_changed(shows: DataFrame, column: str) -> DataFrame:
    """The listing of a commit by name and status -> with file, a row for each one changed: not added, not deleted."""
    rows = shows.withColumn("__f", F.explode(F.split(column, "\n", -1))).withColumn("__f", F.split(T.trimmed(F.col("__f")), "\t", -1))
    rows = rows.where((F.size("__f") == 2) & (F.col("__f")[0] == "M")).withColumn("file", F.col("__f")[1])
    return rows.where("file <> ''").drop("__f")
