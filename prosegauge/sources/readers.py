"""Sources: texts, source trees, JSON lines, rule and settings files, listings."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.functions import text as T
from prosegauge.operators import metrics
from prosegauge.sources import paths as P

CORPUS = "lang string, label string, text string, model string"
EDITS = "block string, hash string, file string, text string, delete boolean, keep boolean"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """file, text: whole files; markup files without their markup; blank ones left out."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    plain = rows.where(~P.is_markup(F.col("file")))
    marked = metrics.strip_markup(rows.where(P.is_markup(F.col("file"))))
    return plain.unionByName(marked).where(~T.blank(F.col("text")))


def tree(spark: SparkSession, root: str, **how) -> DataFrame:
    """path, text: source files below root that are in a known language and not excluded.

    The path decides before contents are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", "^.*?" + T.quoted(root.rstrip("/").removeprefix("file://")) + "/", "")
    ok = P.allowed(rel, **how) & ~P.skipped(rel)
    rows = files.where(ok).select(rel.alias("path"), F.decode("content", "UTF-8").alias("text"))
    return rows.where(~P.generated(F.col("text")))


def corpus(spark: SparkSession, path: str, lang: str | None = None, limit: int | None = None) -> DataFrame:
    """Labelled texts; lines that aren't JSON are dropped."""
    rows = spark.read.schema(CORPUS).option("mode", "DROPMALFORMED").json(path)
    rows = rows.where(F.col("label").isin("ai", "human") & (F.coalesce("text", F.lit("")) != ""))
    rows = rows.where(F.col("lang") == lang) if lang else rows
    return rows.limit(limit) if limit else rows


def edits(spark: SparkSession, path: str) -> DataFrame:
    """Edit lines; one that isn't JSON is an error."""
    return spark.read.schema(EDITS).option("mode", "FAILFAST").json(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def series(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path, inferSchema=True)


def git_files(root: str) -> list[str]:
    """What version control lists below root, ignored files left out."""
    out = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, check=True).stdout
    return [x for x in out.decode().split("\0") if x]


def git_log(spark: SparkSession, root: str, n: int) -> DataFrame:
    out = subprocess.run(["git", "-C", root, "log", "--no-merges", f"-n{n}", "--format=%h%x1f%s%x1f%b%x1e"], capture_output=True, check=True).stdout
    return P.parse_log(spark.createDataFrame([(out.decode(),)], "log string"), "log")


def git_pairs(spark: SparkSession, root: str, commit: str) -> DataFrame:
    """file, old, new: the files that a commit changed, before it and after it."""
    run = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, check=True).stdout.decode("utf-8", "replace")
    listing = spark.createDataFrame([(run("show", "--name-status", "--pretty=format:", "--no-renames", commit),)], "listing string")
    names = [r["file"] for r in P.parse_changed(listing, "listing").orderBy("file").toLocalIterator()]
    return spark.createDataFrame([(f, run("show", f"{commit}^:{f}"), run("show", f"{commit}:{f}")) for f in names], "file string, old string, new string")


def rcs_head(text: Column) -> Column:
    """The head revision of a version file: its first text, with doubled signs as one.

    Plain replacing and cutting: a regex for it would recurse once for each character of a long text.
    """
    body = F.replace(F.get(F.split(text, "\ntext\n@", 2), F.lit(1)), F.lit("@@"), F.lit("\x01"))
    return F.replace(F.coalesce(F.substring_index(body, "@", 1), F.lit("")), F.lit("\x01"), F.lit("@"))


class SettingsError(ValueError):
    """Settings that can't be meant."""


@dataclass
class Settings:
    """A project's settings.  Unknown keys are errors."""

    version: int = 1
    genre: str = ""
    rules_file: str = ""
    comments: dict = field(default_factory=dict)
    languages: dict = field(default_factory=dict)
    exclude: list = field(default_factory=list)
    baseline: str = ""
    rules: dict = field(default_factory=dict)

    KEYS = {"comments": {"max_lines", "max_line", "commits", "skip_tests"}, "languages": {"only", "ignore"}, "rules": {"only", "disable"}}

    @classmethod
    def parse(cls, y: dict) -> Settings:
        unknown = set(y) - {"version", "genre", "rules_file", "comments", "languages", "exclude", "baseline", "rules"}
        for part, known in cls.KEYS.items():
            unknown |= {f"{part}.{k}" for k in (y.get(part) or {}) if k not in known}
        if unknown:
            raise SettingsError(f"unknown keys: {', '.join(sorted(unknown))}")
        for k in ("max_lines", "max_line", "commits"):
            if (y.get("comments") or {}).get(k, 0) < 0:
                raise SettingsError(f"comments.{k} can't be negative")
        for k in ("only", "ignore"):
            for lang in (y.get("languages") or {}).get(k) or ():
                if lang not in P.LANGUAGES:
                    raise SettingsError(f"no language {lang!r}; there are {', '.join(P.LANGUAGES)}")
        return cls(**{k: v for k, v in y.items() if v is not None})

    @classmethod
    def find(cls, start: str, name: str = ".prosegauge.yaml") -> Settings:
        """The nearest settings file from start upwards."""
        import yaml

        at = Path(start).resolve()
        for folder in [at, *at.parents]:
            if (folder / name).is_file():
                return cls.parse(yaml.safe_load((folder / name).read_text(encoding="utf-8")) or {})
        return cls()
