"""Comment blocks and commits: shape checks, rule findings, items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.functions import text as T
from prosegauge.operators import matching
from prosegauge.plans.ruleset import RuleSet

# Patterns and limits that findings depend on.
MARKER = r"^\s*(///?/?|/\*+|\*+/|\*|<!--|-->|#)\s?"
BANNER = r"^\s*[-=*#_~+]{6,}\s*$"
TODO = r"\b(?:TODO|FIXME|HACK|XXX)\b|\b(?i:todo|fixme|hack)\s*[:(]"
OWNER = r"(?i)\b(TODO|FIXME|HACK|XXX)\b\s*[(\[]|(?i)(https?://|#\d+|[A-Z]+-\d+|@[a-z][\w.-]+)"
CHANGELOG = (
    r"(?i)\b(author|created|modified|last updated|дата|автор)\s*:|"
    r"\b(19|20)\d\d[-/.]\d\d[-/.]\d\d\b|"
    r"(?im)^\s*[-*]?\s*(updated?|changed?|added|removed|renamed|fixed|изменено|добавлено|удалено)\b[^\n]{0,60}\b(v\d+(\.\d+)?|\d+\.\d+|\d{4})\b"
)
HEADING = r"(?m)^\s*#{1,6}\s+\S"
BULLET = r"(?m)^\s*(?:[-*+]|\d+[.)])\s+\S"
STEP = r"(?im)^\s*(?:[-*+]|\d+[.)])?\s*(step|шаг)\s*\d+\s*[:.)]"
CODE_LINE = (
    r"^\s*(?:if|for|while|switch|return|func|function|const|let|var|import|export|class|struct|guard|public|private|protected|async|await|try|catch|else|case|print|console\.)\b|"
    r"[;{}]\s*$|^\s*[\w.\[\]]+\s*(?::=|=|\+=|-=)\s*\S|^\s*[\w.]+\([^()]*\)\s*[;{]?\s*$"
)
DOC_TAG = r"^\s*@\w+"
LONG_TOKEN = r"https?://|\]\("
IDENTIFIER = r"[A-Z][a-z]+|[a-z]+|[A-Z]+|\d+"
NOT_WORD = r"[^\p{L}\p{N}]+"
PROSE = r"(?i)\b(TODO|FIXME|HACK|XXX|BUG|e\.g\.|i\.e\.|напр\.)\b|https?://"
PRAGMA = r"^\s*(?:eslint-|@ts-|prettier-|istanbul |c8 |v8 |go:|nolint|noinspection|type-coverage:|deepcode |codeql\[)"
SPDX = r"SPDX-License-Identifier"
LICENSE = r"(?i)copyright|©|licen[cs]ed under|licen[cs]e,? version|all rights reserved|под лицензией"
COPULA_LEAD = r"^(?:\p{Lu}[\p{L}\p{N}_]*\s+)?(?i:represents?|functions?\s+as|presents?|features?|stands?\s+as)\b"
GENERIC_SUBJECT = r"(?i)^(update|updates|fix|fixes|fixed|changes?|wip|misc|minor|cleanup|refactor|stuff|tmp|temp|test|\.+)\s*$"
AI_TRAILER = r"(?i)co-authored-by:\s*(claude|gpt|copilot|gemini)|generated with \[?claude|\x{1f916} generated"
THIS_COMMIT = r"(?i)this (commit|change|pr|patch) (adds|introduces|implements|refactors|updates|fixes)"
SUBJECT_LIMIT, MAX_LINES, MAX_LINE, MAX_DEPTH = 72, 2, 100, 5
SHAPE, COMMIT = "Comment shape", "Commit shape"
DELETABLE = ["Commented-out code", "Empty comment"]
#: Nothing to rewrite: the block goes as a whole.
GONE = [*DELETABLE, "Separator banner"]
#: A block with this mark is left alone.
KEEP_TAG = r"(?i)prosegauge[:-]keep"


def strip_markers(raw: Column) -> Column:
    right = lambda s: F.regexp_replace(s, r"[ \t]+\z", "")
    one = lambda s: right(F.regexp_replace(right(F.regexp_replace(right(F.regexp_replace(s, T.jdk(MARKER), "")), r"\*/\z", "")), r"-->\z", ""))
    return T.trimmed(F.array_join(F.transform(T.lines(raw), one), "\n"))


def prose_lines(raw: Column) -> Column:
    """Lines of a block that say something, past its marks and tags."""
    bare = lambda x: T.trimmed(F.regexp_replace(T.trimmed(F.regexp_replace(T.trimmed(x), r"\A(?:/\*\*|\*/|///|//|/\*|#)", "")), r"\A\*", ""))
    return F.size(F.filter(F.transform(T.lines(raw), bare), lambda x: (x != "") & ~x.startswith("@")))


def rendered_lines(raw: Column, body: Column, max_line: int = 100) -> Column:
    """Lines that body takes up once it is wrapped and stands where raw is."""
    first = T.lines(raw)[0]
    head = F.regexp_replace(first, r"\A[ \t]+", "")
    mark = F.when(head.startswith("/*"), 3).when(head.startswith("///"), 3).when(head.startswith("#"), 1).otherwise(2)
    room = F.lit(max_line) - (F.length(first) - F.length(head) + mark + 1)
    width = F.when(room > 20, room).otherwise(F.lit(20))

    def wrapped(part: Column) -> Column:
        sizes = F.transform(F.filter(F.split(part, f"[{T.SPACE}]+", -1), lambda w: w != ""), F.length)
        start = F.struct(F.lit(1).alias("n"), F.lit(-1).alias("used"))
        fits = lambda a, w: (a["used"] < 0) | (a["used"] + 1 + w <= width)
        more = lambda a, w: F.struct(F.when(fits(a, w), a["n"]).otherwise(a["n"] + 1).alias("n"), F.when(fits(a, w) & (a["used"] >= 0), a["used"] + 1 + w).otherwise(w).alias("used"))
        return F.aggregate(sizes, start, more, lambda a: a["n"])

    return F.aggregate(F.transform(T.lines(body), wrapped), F.lit(0), lambda a, n: a + n)


def is_doc(raw: Column) -> Column:
    first = T.trimmed(T.lines(raw)[0])
    return first.startswith("/**") | first.startswith("///")


def is_prose(line: Column) -> Column:
    return ~T.blank(line) & ~T.matches(line, DOC_TAG)


def shape(text: Column) -> tuple[Column, Column]:
    """Lines of prose, and the longest of those without a link."""
    prose = F.filter(T.lines(text), is_prose)
    longest = F.array_max(F.transform(F.filter(prose, lambda x: ~T.matches(x, LONG_TOKEN)), F.length))
    return F.size(prose), F.coalesce(longest, F.lit(0))


def ignored(text: Column, start: Column, lines: Column, keep_tag: str = KEEP_TAG) -> Column:
    """License headers, pragmas of tools, and blocks that the author wants kept."""
    header = T.matches(text, SPDX) | ((start <= 5) & (lines >= 3) & T.matches(text, LICENSE))
    return header | T.matches(text, PRAGMA) | T.matches(text, keep_tag)


def significant_words(text: Column) -> Column:
    return F.filter(T.words(F.lower(text)), lambda w: (F.length(w) >= 2) & ~w.isin(T.COMMENT_STOPWORDS))


def identifier_parts(code: Column) -> Column:
    parts = F.flatten(F.transform(F.split(code, T.jdk(NOT_WORD), -1), lambda t: T.find_all(t, IDENTIFIER)))
    return F.transform(parts, F.lower)


def restates(text: Column, lines: Column, following: Column) -> Column:
    """A line of two to eight words, four fifths of which are in the name below."""
    words, parts = significant_words(text), identifier_parts(following)
    n = F.size(words)
    hit = F.size(F.filter(words, lambda w: F.array_contains(parts, w)))
    return (lines == 1) & (following != "") & n.between(2, 8) & (hit / F.greatest(n, F.lit(1)) >= 0.8)


def in_quotes(before: Column) -> Column:
    """Whether what follows `before` on its line stands in quotes."""
    # not by a regex to the end of the text: it would start anew at each character of a line
    line = F.substring_index(before, "\n", -1)
    return (F.regexp_count(line, F.lit('"')) % 2 == 1) | (F.regexp_count(line, F.lit("`")) % 2 == 1) | (F.regexp_count(line, F.lit("«")) > F.regexp_count(line, F.lit("»")))


def newlines(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))


def first_todo(text: Column) -> Column:
    """Lines before the first marker outside quotes; null without one.

    A mark is put before each marker; quotes count within a line, so each line is asked by itself.
    """
    marked = F.regexp_replace(F.replace(text, F.lit(matching.PLACE), F.lit("")), F.lit(T.jdk(TODO)), F.lit(matching.PLACE + "$0"))

    def open_(line: Column) -> Column:
        pieces = F.split(line, matching.PLACE, -1)
        before = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda k: F.array_join(F.slice(pieces, F.lit(1), k), ""))
        return F.when(F.size(pieces) > 1, F.exists(before, lambda b: ~in_quotes(b))).otherwise(F.lit(False))

    at = F.transform(T.lines(marked), lambda x, k: F.when(F.contains(x, F.lit(matching.PLACE)) & open_(x), k))
    return F.when(T.matches(text, TODO), F.array_min(F.filter(at, lambda k: k.isNotNull())))


def comment_findings(blocks: DataFrame, max_lines: int = MAX_LINES, max_line: int = MAX_LINE) -> DataFrame:
    """blocks (file, start, lines, text, next) -> + line, category, rule: one row for each shape finding."""
    text, start, following = F.col("text"), F.col("start"), F.col("next")
    lines = T.lines(text)
    prose = F.size(F.filter(lines, is_prose))

    def first(condition) -> Column:
        return F.array_min(F.filter(F.transform(lines, lambda x, k: F.when(condition(x), k)), lambda k: k.isNotNull()))

    full = F.filter(lines, lambda x: ~T.blank(x))
    code = F.size(F.filter(full, lambda x: T.matches(x, CODE_LINE)))
    looks = (F.octet_length(T.trimmed(text)) >= 15) & ~T.matches(text, PROSE) & (code >= 2) & (code * 2 >= F.size(full))
    change = T.jdk(CHANGELOG)
    checks = [
        ("Long comment", F.when((prose > max_lines) & ~following.startswith("package "), F.lit(0)) if max_lines else F.lit(None)),
        ("Long comment line", first(lambda x: is_prose(x) & ~T.matches(x, LONG_TOKEN) & (F.length(x) > max_line)) if max_line else F.lit(None)),
        ("Separator banner", first(lambda x: T.matches(x, BANNER))),
        ("Commented-out code", F.when(looks, F.lit(0))),
        ("TODO with no owner", F.when(~T.matches(text, OWNER), first_todo(text))),
        ("Changelog in a comment", F.when(F.regexp_like(text, F.lit(change)), newlines(F.split(text, change, 2)[0]))),
        ("Markdown essay in a comment", F.when(T.matches(text, HEADING) | (T.count(text, BULLET) >= 3), F.lit(0))),
        ("Step-by-step instructions", F.when(T.count(text, STEP) >= 2, F.lit(0))),
        ("Comment restates the code", F.when(restates(text, F.col("lines"), following), F.lit(0))),
    ]
    found = F.filter(F.array(*[F.struct(F.lit(n).alias("rule"), c.cast("int").alias("at")) for n, c in checks]), lambda x: x["at"].isNotNull())
    return blocks.withColumn("f", F.explode(found)).withColumn("line", (start + F.col("f.at")).cast("int")).withColumn("category", F.lit(SHAPE)).withColumn("rule", F.col("f.rule")).drop("f")


def commit_findings(commits: DataFrame) -> DataFrame:
    """commits (file, text) -> + rule."""
    text = F.col("text")
    subject = T.trimmed(T.lines(text)[0])
    checks = [
        ("Long commit subject", F.length(subject) > SUBJECT_LIMIT),
        ("Period at the end of the subject", subject.endswith(".")),
        ("Empty commit subject", T.matches(subject, GENERIC_SUBJECT)),
        ("AI trailer in the commit", T.matches(text, AI_TRAILER)),
        ("This commit ...", T.matches(text, THIS_COMMIT)),
        ("Bullet wall in the commit", T.count(text, BULLET) >= 5),
    ]
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks]), lambda x: x.isNotNull())
    return commits.withColumn("rule", F.explode(found)).withColumn("category", F.lit(COMMIT))


def doc_lead(text: Column, doc: Column, following: Column) -> Column:
    t = T.trimmed(text)
    head = F.split(t, f"[{T.SPACE}]+")[0]
    return T.matches(t, COPULA_LEAD) & (doc | ((following != "") & F.contains(following, head)))


def rule_findings(blocks: DataFrame, sets: list[tuple[RuleSet, Column]], genre: str = "code", skip: tuple[str, ...] = ()) -> DataFrame:
    """blocks -> file, start, line, category, rule, lift, hard, fix: a row for each line that a rule is found on.

    sets: rule sets, and of which blocks each is asked.
    """
    out = None
    key = ["file", "start"]
    for rs, where in sets:
        rules = [r for r in rs.rules if not rs.is_muted(r, genre) and r.kind not in skip]
        asked = blocks.where(where).withColumn("words", T.count_words(F.col("text")))
        found = matching.dense_enough(matching.hits(asked, rules, key=[*key, "words", "doc", "next"]), rs)
        found = found.where((F.col("category") != "Copula inflation") | ~doc_lead(F.col("text"), F.col("doc"), F.col("next")))
        found = matching.with_lines(found).select(*key, F.explode("lines").alias("l"), "category", "rule", "lift", "hard", "fix")
        found = found.select(*key, (F.col("start") + F.col("l") - 1).cast("int").alias("line"), "category", "rule", "lift", "hard", "fix")
        out = found if out is None else out.unionByName(found)
    return out


def weight(lift: Column, hard: Column) -> Column:
    w = F.when(lift > 1, F.least(F.lit(10), F.floor(lift + 0.5).cast("int"))).otherwise(F.lit(1))
    return w * F.when(hard, F.lit(3)).otherwise(F.lit(1))


def block_id(file: Column, start: Column, end: Column) -> Column:
    one = (start == end) | (end == 0)
    return F.when(one, F.concat_ws(":", file, start.cast("string"))).otherwise(F.concat(file, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")))


def items(blocks: DataFrame, findings: DataFrame) -> DataFrame:
    """A row for each block with findings: id, hash, score, findings (line, rule, category, hard, lift, fix, sample)."""
    once = findings.dropDuplicates(["file", "start", "rule", "line"])
    found = once.groupBy("file", "start").agg(
        F.sum(weight(F.col("lift"), F.col("hard"))).cast("long").alias("score"),
        F.array_sort(F.collect_list(F.struct("line", "rule", "category", "hard", "lift", "fix"))).alias("findings"),
        F.max("hard").alias("hard"),
    )
    rows = blocks.select(block_id(F.col("file"), F.col("start"), F.col("end")).alias("id"), T.norm_hash(F.col("text")).alias("hash"), "file", "start", "end", "raw", "text")
    sampled = F.transform("findings", lambda f: f.withField("sample", T.excerpt(F.col("text"), f["line"] - F.col("start") + 1)))
    return rows.join(found, ["file", "start"]).withColumn("findings", sampled).drop("text")
