"""Comment blocks out of source files, and edits back into them.

A lexer can't be said in Catalyst, so files go through Arrow batches, one file a row; what comes out is an
ordinary table of blocks.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.functions import text as T
from prosegauge.sources import paths as P

SCHEMA = "file string, start int, end int, lines int, text string, raw string, lang string, next string, depth int, doc boolean, so int, eo int"

_STRING = r'"(?:\\.|[^"\\\n])*"?' + "|" + r"'(?:\\.|[^'\\\n])*'?"
_LEXERS: dict[tuple[bool, bool, bool], re.Pattern] = {}
#: What can stand before a division, but not before a regex literal.
_OPERAND = re.compile(r"[\w$)\]\"'`]\Z")


def _lexer(triple: bool, nested: bool, regex: bool) -> re.Pattern:
    key = (triple, nested, regex)
    if key not in _LEXERS:
        parts = ([r'(?P<triple>""".*?(?:"""|\Z))'] if triple else []) + [r"(?P<line>//[^\n]*)", r"(?P<open>/\*)" if nested else r"(?P<block>/\*.*?(?:\*/|\Z))", f"(?P<string>{_STRING})"]
        parts += [r"(?P<template>`)", r"(?P<slash>/)"] if regex else ([] if triple else [r"(?P<raw>`[^`]*`?)"])
        _LEXERS[key] = re.compile("|".join(parts), re.S)
    return _LEXERS[key]


_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/")


def _nested_end(src: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(src, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(src)


def scan(src: str, triple: bool = False, nested: bool = False, regex: bool = False, start: int = 0, inside: bool = False) -> tuple[list[tuple[int, int]], int]:
    """Comments as (start, end), and where scanning ended: at the brace that closes a template's code, if inside."""
    lexer, out, at, braces = _lexer(triple, nested, regex), [], start, 0
    stop = re.compile(r"[{}]") if inside else None
    while True:
        m = lexer.search(src, at)
        if stop:
            for b in stop.finditer(src, at, m.start() if m else len(src)):
                braces += 1 if b[0] == "{" else -1
                if braces < 0:
                    return out, b.end()
        if not m:
            return out, len(src)
        at = m.end()
        if m.lastgroup in ("line", "block"):
            out.append((m.start(), m.end()))
        elif m.lastgroup == "open":
            at = _nested_end(src, m.start())
            out.append((m.start(), at))
        elif m.lastgroup == "template":
            found, at = _template(src, at)
            out += found
        elif m.lastgroup == "slash":
            before = src[:at - 1][-200:].rstrip()
            lit = None if _OPERAND.search(before) and not re.search(r"\b(?:return|typeof|case|in|of)\Z", before) else _REGEX.match(src, at - 1)
            at = lit.end() if lit else at


def _template(src: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """A template literal from behind its opening mark; code in ${} may hold comments and templates."""
    out, part = [], re.compile(r"\\.|`|\$\{", re.S)
    while m := part.search(src, at):
        at = m.end()
        if m[0] == "`":
            return out, at
        if m[0] == "${":
            found, at = scan(src, regex=True, start=at, inside=True)
            out += found
    return out, len(src)


def scan_markup(src: str) -> list[tuple[int, int]]:
    """Comments of markup, and those in its scripts and styles."""
    out, bodies = [], []
    at = 0
    tag = re.compile(r"<!--.*?-->|<(script|style)\b[^>]*>", re.S | re.I)
    while m := tag.search(src, at):
        at = m.end()
        if not m[1]:
            out.append((m.start(), m.end()))
            continue
        close = re.compile(rf"</{m[1]}\s*>", re.I).search(src, at)
        end = close.start() if close else len(src)
        bodies.append((at, end))
        at = close.end() if close else len(src)
    for a, b in bodies:
        out += [(a + s, a + e) for s, e in scan(src[a:b], regex=True)[0]]
    return sorted(out)


def scan_file(path: str, src: str) -> list[tuple[int, int]]:
    ext = path[path.rfind(".") :] if "." in path else ""
    if ext == ".svelte":
        return scan_markup(src)
    if ext in (".go", ".swift", ".c", ".h", ".cc", ".cpp", ".cxx", ".hh", ".hpp"):
        return scan(src)[0]
    if ext in (".java", ".kt", ".kts"):
        return scan(src, triple=True, nested=ext != ".java")[0]
    return scan(src, regex=True)[0]


def indent(line: str) -> int:
    return sum(8 if c == "\t" else 1 for c in line[: len(line) - len(line.lstrip("\t "))])


def block_depth(lines: list[str], after: int) -> int:
    """Levels of nesting, by indentation, of the function that follows; 0 if none does."""
    rest = [x for x in lines[after:] if x.strip()]
    if not rest or "(" not in rest[0]:
        return 0
    widths = [indent(x) for x in lines if x.strip()]
    steps = Counter(b - a for a, b in zip([0, *widths], widths, strict=False) if b > a)
    unit = max((2, 4, 8), key=lambda s: (steps[s], s == 4, -s))
    unit = unit if steps[unit] else 4
    base = deep = indent(rest[0])
    for line in rest[1:]:
        if indent(line) <= base:
            break
        if not line.strip().startswith(("//", "*")):
            deep = max(deep, indent(line))
    return max(0, (deep - base) // unit - 1)


@dataclass
class Span:
    start: int
    end: int
    so: int
    eo: int
    own: bool


def spans(src: str, found: list[tuple[int, int]]) -> list[Span]:
    """Comments with their lines; neighbours that have their lines to themselves are one."""
    breaks = [m.start() for m in re.finditer("\n", src)]
    line = lambda at: bisect.bisect_left(breaks, at) + 1
    out: list[Span] = []
    for so, eo in sorted(found):
        own = not src[src.rfind("\n", 0, so) + 1 : so].strip(" \t\r")
        s = Span(line(so), line(max(so, eo - 1)), so, eo, own)
        if out and own and out[-1].own and s.start <= out[-1].end + 1:
            out[-1].end, out[-1].eo = max(out[-1].end, s.end), max(out[-1].eo, eo)
        else:
            out.append(s)
    return out


_MARK = re.compile(r"^[ \t\n\f\r]*(///?/?|/\*+|\*+/|\*|<!--|-->|#)[ \t\n\f\r]?")


def stripped(raw: str) -> str:
    out = []
    for line in raw.split("\n"):
        line = _MARK.sub("", line, count=1).rstrip(" \t")
        line = line.removesuffix("*/").rstrip(" \t").removesuffix("-->").rstrip(" \t")
        out.append(line)
    return "\n".join(out).strip()


def extract(path: str, src: str) -> list[tuple]:
    """Rows of SCHEMA."""
    lines, out = src.split("\n"), []
    lang = next((k for k, e in P.LANGUAGES.items() if path.lower().endswith(tuple(e))), "")
    for s in spans(src, scan_file(path, src)):
        raw = src[s.so : s.eo]
        if s.own:
            near = (x.strip() for x in lines[s.end : s.end + 3])
            following = next((x for x in near if x and not x.startswith(("//", "*"))), "")
        else:
            following = src[src.rfind("\n", 0, s.so) + 1 : s.so].strip()
        head = raw.split("\n")[0].strip()
        out.append((path, s.start, s.end, raw.count("\n") + 1, stripped(raw), raw, lang, following, block_depth(lines, s.end), head.startswith(("/**", "///")), s.so, s.eo))
    return out


def extract_blocks(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """files -> blocks (SCHEMA).  Generated files have none; offsets are in characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            rows = [row for p, t in zip(b["path"], b["text"], strict=True) for row in extract(p, t)]
            yield pd.DataFrame(rows, columns=columns)

    rows = files.select(F.col(path).alias("path"), F.col(text).alias("text")).where(F.col("text").isNotNull() & ~P.generated(F.col("text")))
    return rows.mapInPandas(run, SCHEMA)


# --- edits ------------------------------------------------------------------------


def wrap(text: str, width: int) -> list[str]:
    out: list[str] = []
    for word in text.split():
        if out and len(out[-1]) + 1 + len(word) <= width:
            out[-1] += " " + word
        else:
            out.append(word)
    return out or [""]


def render(lead: str, head: str, body: str, max_line: int = 100) -> list[str]:
    """body as a comment of the same kind as head, wrapped, after the indentation `lead`."""
    width = lambda n: max_line - n if max_line - n > 20 else 20
    head = head.lstrip(" \t")
    fences = (("<!--", "-->", "  "), ("/**", "*/", " * "), ("/*", "*/", " * "))
    for opens, closes, inner in fences:
        if head.startswith(opens):
            rows = wrap(body, width(len(lead) + len(inner)))
            if len(rows) == 1 and len(lead) + len(opens) + len(closes) + 2 + len(rows[0]) <= max_line:
                return [f"{lead}{opens} {rows[0]} {closes}"]
            return [lead + opens, *[lead + inner + r for r in rows], lead + (" " if inner == " * " else "") + closes]
    mark = next((m for m in ("///", "#") if head.startswith(m)), "//")
    return [f"{lead}{mark} {r}" for r in wrap(body, width(len(lead) + len(mark) + 1))]


class EditError(ValueError):
    """An edit that can't be made."""


def placeholder(text: str) -> bool:
    t = (text or "").strip()
    return not t.strip(".") or t == "<new text>"


def plan(src: str, so: int, eo: int, raw: str, delete: bool, body: str = "", max_line: int = 100) -> tuple[int, int, str]:
    """(from, to, new): what to put where for one block."""
    if not 0 <= so < eo <= len(src):
        raise EditError(f"block outside file, offsets {so}-{eo}")
    if src[eo - 1] == "\r":  # part of the line break, not of the comment
        eo -= 1
    line_start = src.rfind("\n", 0, so) + 1
    line_end = src.find("\n", eo)
    line_end = len(src) if line_end < 0 else line_end
    before, after = src[line_start:so], src[eo:line_end]
    own = not before.strip()
    if not delete:
        if placeholder(body):
            raise EditError("no text to put there")
        if not own:
            raise EditError("a comment behind code can't be replaced")
        return line_start, eo, ("\r\n" if "\r\n" in src else "\n").join(render(before, raw.split("\n")[0], body, max_line))
    if after.strip():
        return so, eo, ""
    if own:
        return line_start, min(line_end + 1, len(src)), ""
    end = line_end - 1 if src[line_end - 1 : line_end] == "\r" else line_end
    return line_start + len(before.rstrip(" \t")), end, ""


def apply_edits(files: DataFrame, edits: DataFrame, max_line: int = 100) -> DataFrame:
    """files (file, text), edits (file, so, eo, raw, delete, body) -> file, text, edits: files that have edits.

    From the last edit of a file to its first, so offsets stay right.
    """

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for file, text in zip(left["file"], left["text"], strict=True):
            plans = [plan(text, e.so, e.eo, e.raw, e.delete, e.body, max_line) for e in right.itertuples()]
            new = text
            for a, b, put in sorted(plans, reverse=True):
                new = new[:a] + put + new[b:]
            out.append((file, new, len(plans)))
        return pd.DataFrame(out, columns=["file", "text", "edits"])

    touched = files.select("file", "text").join(edits.select("file").distinct(), "file", "left_semi")
    return touched.groupBy("file").cogroup(edits.groupBy("file")).applyInPandas(run, "file string, text string, edits int")


# --- answers of a model -------------------------------------------------------------

_MARKS = ("/**", "*/", "///", "//", "/*", "#", "*")


def clean_answer(text):
    """A column of answers without fence, comment marks and quotes round the whole."""
    t = T.trimmed(text)
    t = F.when(t.startswith("```"), T.trimmed(F.regexp_replace(T.trimmed(F.regexp_replace(t, r"\A[^\n]*\n", "")), r"```\z", ""))).otherwise(t)
    marks = "|".join(re.escape(m) for m in _MARKS)
    rows = F.transform(T.lines(t), lambda x: T.trimmed(F.regexp_replace(T.trimmed(x), rf"\A(?:{marks})", "")))
    t = F.array_join(F.filter(rows, lambda x: x != ""), "\n")
    return F.when((F.length(t) > 1) & F.regexp_like(t, F.lit(r'\A"[^"]*"\z')), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)


def retry_after(message):
    """Seconds to wait after a refusal for too many calls; null for other messages."""
    seconds = F.coalesce(F.nullif(F.regexp_extract(message, r"retry (?:in|after) (\d{1,9})\s*s", 1), F.lit("")).cast("int"), F.lit(0))
    limited = F.contains(message, F.lit("429")) | F.contains(F.lower(message), F.lit("rate limit"))
    return F.when(limited, F.when(seconds > 0, seconds + 1).otherwise(F.lit(15)))
