"""Functions of source files by indentation: depth, lines, branches, parameters.

There is no grammar: a function starts at a line with a signature, and its body is what is indented deeper.
A function within another one belongs to that one.  Branches and parameters are counted by their words and
commas.  A file is one pass over its lines, in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.sources.work import small_batches

# What a signature looks like, and steps of indentation.
SIGNATURE = r"^\s*((public|private|internal|fileprivate|open|static|final|override|func|def)\s)*func\s|^func[ (]"
STEPS, STEP, TAB = (2, 4, 8), 4, 8
NOTE = ("//", "*", "/*")
BRANCH = r"\b(?:if|for|while|case|catch|guard|elif|except)\b|&&|\|\|"
STRING = r'"[^"\n]*"'
PARAMETERS = r"func\s*(?:\([^()]*\)\s*)?\w*\s*\(([^()]*)\)"
#: Files whose functions are handed over at once.
ROWS = 100
SCHEMA = "line int, name string, depth int, sloc int, cc int, params int"

_SIGNATURE, _BRANCH = re.compile(SIGNATURE, re.ASCII), re.compile(BRANCH, re.ASCII)
_STRING, _PARAMETERS = re.compile(STRING), re.compile(PARAMETERS, re.ASCII)
_NAME = re.compile(r"func\s*(?:\([^()]*\)\s*)?(\w*)", re.ASCII)


def indent(line: str) -> int:
    lead = line[: len(line) - len(line.lstrip(" \t"))]
    return len(lead) + (TAB - 1) * lead.count("\t")


def step(lines: list[str]) -> int:
    """The most frequent growth of indentation that is a step; of equal ones the first to appear."""
    grown, before = Counter(), 0
    for x in lines:
        if x.strip():
            at = indent(x)
            if at > before:
                grown[at - before] += 1
            before = at
    return next((s for s, _ in grown.most_common() if s in STEPS), STEP)


def functions_of(text: str) -> Iterator[tuple]:
    """Rows of SCHEMA; lines count from 1, depth 0 is a body without blocks."""
    lines = text.split("\n")
    unit, k = step(lines), 0
    while k < len(lines):
        head = lines[k]
        if not _SIGNATURE.search(head):
            k += 1
            continue
        at, base = k, indent(head)
        deep, sloc, cc, k = base, 0, 1, k + 1
        while k < len(lines):
            bare = lines[k].strip()
            if bare:
                now = indent(lines[k])
                if now <= base and bare[0] not in ")]":
                    break
                if not bare.startswith(NOTE):
                    sloc, deep = sloc + 1, max(deep, now)
                    cc += len(_BRANCH.findall(_STRING.sub('""', lines[k])))
            k += 1
        given, name = _PARAMETERS.search(head), _NAME.search(head)
        params = given.group(1).count(",") + 1 if given and given.group(1).strip() else 0
        yield at + 1, name.group(1) if name else "", max((deep - base) // unit - 1, 0), sloc, cc, params


def functions(files: DataFrame, keys: list[str] = ("path",), text: str = "text") -> DataFrame:
    """files -> keys and SCHEMA, a row for each function.  A null text has none."""
    small_batches(files.sparkSession)
    rows = files.select(*keys, F.col(text).alias("__text")).where("__text is not null")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [(c.split()[0], pa.string() if c.endswith(" string") else pa.int32()) for c in SCHEMA.split(", ")]
        for b in batches:
            own, texts = b.select(list(keys)), b.column("__text")
            for start in range(0, b.num_rows, ROWS):
                found = [(k, *f) for k in range(start, min(start + ROWS, b.num_rows)) for f in functions_of(texts[k].as_py())]
                if found:
                    at, *values = zip(*found)
                    part = own.take(pa.array(at, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(v, t) for v, (_, t) in zip(values, types)]], names=[*keys, *[n for n, _ in types]])
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, f"{out}, {SCHEMA}")


def heaviest(found: DataFrame, by: list[str], most: int = 6) -> DataFrame:
    """Of each group, the functions with the largest cc x sloc."""
    from pyspark.sql.window import Window

    order = Window.partitionBy(*by).orderBy((F.col("cc") * F.col("sloc")).desc(), *[c for c in found.columns if c not in (*by, "cc", "sloc")])
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
