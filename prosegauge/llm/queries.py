"""The queries of the ten operators, each over the whole documents table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.llm import bpe, exact_dedup, langid, lm_scoring, mixing, secrets, sharding, simhash, sketching, toxicity
from prosegauge.llm.common import documents, fold, staged, work_folder


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = documents(spark, sf_dir).select("doc_id", "source", mixing.size_of(F.col("text")).alias("size"))
    out = mixing.mixed(staged(sizes, f"{work_folder(spark)}/sizes"), size=F.col("size"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketching.fingerprints(documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir), 16)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return exact_dedup.exact_groups(docs, f"{sf_dir}/documents.parquet").drop("row")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(documents(spark, sf_dir))


def tokenizer(name: str = "byte_bpe_50k.tiktoken") -> tuple[bytes, str]:
    """The rank file's contents, read where the driver is, and the pattern."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), *tokenizer())


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir)))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.scored(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    filters = langid.train(docs.where(fold(F.col("doc_id"), 4) != 2))
    out = langid.identified(docs, filters)
    return out.select("kept.doc_id", (fold(F.col("kept.doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_fingerprints": op2_fingerprints,
    "op3_sharding": op3_sharding,
    "op4_simhash": op4_simhash,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_bpe": op7_bpe,
    "op8_secrets": op8_secrets,
    "op9_toxicity": op9_toxicity,
    "op10_langid": op10_langid,
}

_OP1 = r"""
WITH r AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM documents),
c AS (
  SELECT *, CASE WHEN size < 16 THEN size ELSE length(bin(size)) * 8 + (size >> (length(bin(size)) - 4)::BIGINT) % 8 END AS step, h % 4096 AS salt
  FROM r),
s0 AS (SELECT key, sum(size)::BIGINT AS source_size FROM r GROUP BY key),
s1 AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS cap, row_number() OVER (ORDER BY key) AS place FROM s0),
s2 AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS budget, sum(w) OVER () AS allw,
         sum(cap) OVER up AS capped, sum(w) OVER up AS gone
       FROM s1 WINDOW up AS (ORDER BY cap / w, place ROWS UNBOUNDED PRECEDING)),
s3 AS (SELECT *, (budget - (capped - cap)) / (allw - (gone - w)) AS level FROM s2),
water AS (SELECT min(gone) AS g, arg_min(level, gone) AS level FROM s3 WHERE level * w < cap),
t AS (SELECT key, source_size, CASE WHEN water.g IS NULL THEN cap ELSE least(cap, water.level * w) END AS target FROM s3, water),
p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('17:' || key), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM t),
k AS (SELECT c.*, row_number() OVER (PARTITION BY key ORDER BY step, salt, size, doc_id NULLS FIRST)::DOUBLE AS rank FROM c)
SELECT doc_id, size, source_size, target,
       ((floor(u + rate * rank) - floor(u + rate * (rank - 1)))::BIGINT * size)::BIGINT AS taken
FROM k JOIN p USING (key)
"""

_OP5 = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM t GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text)
"""

_OP8 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k(place, kind, re, grp, least_) AS (VALUES
  (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 20),
  (2, 'hex', '[0-9a-f]+', 0, 24)),
m AS (
  SELECT doc_id, place, kind, least_,
         CASE place WHEN 0 THEN regexp_extract_all(text, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
           WHEN 1 THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+') ELSE regexp_extract_all(text, '[0-9a-f]{24,}') END AS f,
         CASE place WHEN 0 THEN regexp_extract_all(text, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)
           WHEN 1 THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+') ELSE regexp_extract_all(text, '[0-9a-f]{24,}') END AS g,
         CASE place WHEN 0 THEN regexp_split_to_array(text, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
           WHEN 1 THEN regexp_split_to_array(text, 'AKIA[A-Z0-9]+') ELSE regexp_split_to_array(text, '[0-9a-f]{24,}') END AS s
  FROM d, k),
e AS (SELECT doc_id, place, kind, least_, f, g, s, unnest(range(1, len(f) + 1)) AS i FROM m WHERE len(f) > 0),
p AS (SELECT doc_id, place, kind, length(f[i]) AS n,
        (list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i-1], lambda x: length(x))), 0))::BIGINT AS st
      FROM e WHERE length(g[i]) >= least_),
a AS (SELECT doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
        string_agg(kind || ':' || st || ':' || (st + n), ',' ORDER BY st, place) AS spans
      FROM p GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN a USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op1_mixing": _OP1, "op5_exact_dedup": _OP5, "op8_secrets": _OP8}
