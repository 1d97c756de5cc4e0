"""All queries of the engine's own operators, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prosegauge.plans import q_blocks, q_more, q_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = q_text.Q | q_blocks.Q | q_more.Q
ORACLE_SQL: dict[str, str] = q_text.SQL | q_blocks.SQL | q_more.SQL
