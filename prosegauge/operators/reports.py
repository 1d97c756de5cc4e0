"""Sinks: reports as JSON, lines and markdown; settings; all as columns or written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.functions import text as T
from prosegauge.operators import blocks, scoring


def report_json(scores: DataFrame) -> DataFrame:
    """One JSON object a document."""
    return scores.select("doc_id", F.to_json(F.struct(*[c for c in scores.columns if c != "doc_id"])).alias("json"))


def quiet(source: Column) -> Column:
    """`source score/100 [band] bans: P (+D dashes), markers: x/100 words`; bans by whether their name has "dash"."""
    words = F.greatest(F.col("words"), F.lit(1))
    rate = T.one_digit((F.col("soft") + F.col("copy_paste")) * 100.0 / words)
    return F.format_string("%-40s %3d/100 [%s] bans: %d (+%d dashes), markers: %s/100 words", source, F.col("score"), F.col("band"), F.col("other_bans"), F.col("dash_bans"), rate)


def penalty_lines(scores: DataFrame) -> DataFrame:
    """doc_id, lines: the score's penalties as text, without those of no points."""
    names = {"p_bans": "hard bans (phrases)", "p_copy": "copy-paste artifacts", "p_soft": "markers", "p_dash": "dashes", "p_rhythm": "flat rhythm", "p_nominal": "nominalization", "p_paragraphs": "flat paragraphs", "p_listicle": "listicle"}
    rows = F.array(*[F.when(F.col(c) > 0, F.format_string("%s: -%d", F.lit(n), F.col(c))) for c, n in names.items()])
    return scores.select("doc_id", F.array_join(F.filter(rows, lambda x: x.isNotNull()), "\n").alias("lines"))


def fence(text: Column) -> Column:
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def fix_command(hash_: Column, file: Column, findings: Column) -> Column:
    """The command that mends a block: delete it if all its findings call for that, else put new text there."""
    gone = F.forall(findings, lambda f: f["rule"].isin(*blocks.GONE) | f["category"].isin(*blocks.GONE))
    how = F.when(gone, F.lit("--delete")).otherwise(F.lit('--text "<new text>"'))
    return F.concat(F.lit("```bash\nprosegauge fix --block "), hash_, F.lit(" "), how, F.lit(' --write "'), file, F.lit('"\n```'))


def markdown(items: DataFrame, lang: Column, kind: str = "comment") -> DataFrame:
    """id, md: a block with its findings by rule, in a fence that its text can't close, and the command below.

    How many blocks have the text is counted by hash, partially before the shuffle.
    """
    copies = items.groupBy("hash").agg(F.count("*").alias("copies"))

    def group(rule: Column) -> Column:
        own = F.filter("findings", lambda f: f["rule"] == rule)
        at = F.array_join(F.transform(own, lambda f: f["line"].cast("string")), ", ")
        fix = F.when(own[0]["fix"] == "", F.lit("")).otherwise(F.concat(F.lit(" - "), own[0]["fix"]))
        return F.concat(F.lit("- **"), rule, F.lit("** ("), F.when(own[0]["hard"], F.lit("hard, ")).otherwise(F.lit("")), F.lit("line "), at, F.lit(")"), fix, F.lit("\n"))

    said = F.array_join(F.transform(F.array_distinct(F.transform("findings", lambda f: f["rule"])), group), "")
    head = F.concat(F.lit("## "), F.col("id"), F.lit("\nblock "), F.col("hash"), F.lit(" | `"), lang, F.lit(f"` | {kind} | weight "), F.col("score").cast("string"))
    many = F.when(F.col("copies") > 1, F.concat(F.lit(" | text copies: "), F.col("copies").cast("string"))).otherwise(F.lit(""))
    f = fence(F.col("raw"))
    tail = F.concat(fix_command(F.col("hash"), F.col("file"), F.col("findings")), F.lit("\n\n")) if kind == "comment" else F.lit("")
    md = F.concat(head, many, F.lit("\n\n"), said, F.lit("\n"), f, F.lit("\n"), F.col("raw"), F.lit("\n"), f, F.lit("\n\n"), tail)
    return items.join(copies, "hash").select("id", md.alias("md"))


def findings_json(items: DataFrame) -> DataFrame:
    """id, place, json: a flat list of findings, one object each, in the order of their block."""
    rows = items.select("id", "file", F.posexplode("findings").alias("place", "f"))
    empty = lambda c: F.when(F.col(f"f.{c}") != "", F.col(f"f.{c}"))
    lift = F.when(F.col("f.lift") != 0, F.col("f.lift"))
    fields = [F.col("file"), empty("category").alias("category"), F.col("f.line").alias("line"), F.col("f.rule").alias("rule"), empty("fix").alias("fix"), empty("sample").alias("sample"), lift.alias("lift"), F.col("f.hard").alias("hard")]
    return rows.select("id", "place", F.to_json(F.struct(*fields)).alias("json"))


def todo(items: DataFrame, note: Column) -> DataFrame:
    """id, todo: an open point for a block, with the rules found and its text as a quotation."""
    said = F.concat(F.lit("  - rules: "), F.array_join(F.transform("findings", lambda f: f["rule"]), ", "), F.lit("\n"))
    quoted = F.array_join(F.transform(T.lines(F.regexp_replace("raw", r"\n+\z", "")), lambda x: F.concat(F.lit("  > "), T.trimmed(x), F.lit("\n"))), "")
    head = F.concat(F.lit("\n- [ ] `"), F.col("file"), F.lit(":"), F.col("start").cast("string"), F.lit("` "), T.trimmed(note), F.lit("\n"))
    return items.select("id", F.concat(head, F.when(F.size("findings") > 0, said).otherwise(F.lit("")), quoted).alias("todo"))


def write_items(items: DataFrame, path: str) -> None:
    """JSON lines, one a block."""
    items.write.mode("overwrite").json(path)


def write_table(rows: DataFrame, path: str) -> None:
    """Tab-separated, with a header."""
    rows.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def settings_text(languages: DataFrame, rules: DataFrame, most: int = 10) -> str:
    """Settings for a project: its languages by files, its most frequent rules."""
    langs = languages.orderBy(F.col("files").desc(), "lang").limit(50).collect()
    top = rules.orderBy(F.col("n").desc(), "rule").limit(most).collect()
    head = ["version: 1", "languages:", "  only: [" + ", ".join(r["lang"] for r in langs) + "]", "rules:", "  disable: []", "# most frequent:"]
    return "\n".join([*head, *[f"#   {r['n']:6d}  {r['rule']}" for r in top]]) + "\n"


def patch_settings(text: str, values: dict[str, object]) -> str:
    """Settings with dotted keys set; other lines, comments too, stay."""
    rows = text.split("\n")
    for dotted, value in values.items():
        part, _, key = dotted.rpartition(".")
        said = f"{'  ' if part else ''}{key}: {str(value).lower() if isinstance(value, bool) else value}"
        at = next((k for k, r in enumerate(rows) if r.split("#")[0].rstrip() == f"{part}:"), None) if part else -1
        if at is None:
            rows = [*rows[: len(rows) - (rows[-1] == "")], f"{part}:", said, ""]
            continue
        lead = "  " if part else ""
        end = next((k for k in range(at + 1, len(rows)) if part and rows[k] and not rows[k].startswith((" ", "#"))), len(rows))
        own = next((k for k in range(at + 1, end) if rows[k].startswith(f"{lead}{key}:")), None)
        if own is None:
            rows.insert(at + 1, said)
        else:
            _, hash_, note = rows[own].partition(" #")
            rows[own] = said + hash_ + note
    return "\n".join(rows)


def verdict(scores: DataFrame) -> DataFrame:
    return scores.select("doc_id", scoring.marker_verdict(F.col("soft") + F.col("copy_paste"), F.col("copy_paste"), F.col("words")).alias("verdict"))
