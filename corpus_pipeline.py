"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of docs.

In every stage an empty table gives an empty one, texts are read whole however long they are, rows that share a
doc_id are rows of their own, and columns may have any names.  A run that is repeated gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.llm import bpe, exact_dedup, langid, mixing, near_copies, queries
from prosegauge.llm.common import documents, fold, staged, work_folder


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without any letter, or without a text, go.  The filters learn from docs.

    Where docs have no labels to learn from, every document with a letter stays.
    """
    filters = langid.train(docs.where(fold(F.col("doc_id"), 4) != 2))
    if filters is None:
        return docs.where(langid.has_letter(F.col("text")))
    out = langid.identified(docs, filters, keep=tuple(docs.columns))
    return out.where("lang_pred != 'und'").select("kept.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id; among rows that share it too, the last in the table."""
    return exact_dedup.exact_groups(docs).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8), the document with the least doc_id.

    Among rows that share it, the one with the least digest of its text.  Rows without an id come last.
    """
    return near_copies.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; null is a source like any other."""
    return mixing.taken_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian unsigned 32-bit), and whether they decode to the text."""
    ranks, pattern = queries.tokenizer()
    rows = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = bpe.encoded(rows, ranks, pattern, keep=("doc_id", "source", "text_sha256"))
    rows = bpe.decoded(rows.withColumn("packed", F.col("ids")), ranks, pattern, "packed")
    return rows.select("doc_id", "source", "n_tokens", "ids", (F.sha2("bytes", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [
    ("language ID", keep_identified),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: Language ID can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark)
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = staged(stage(spark, docs, sf_dir), f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
