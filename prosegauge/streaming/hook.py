"""Findings as files are edited: each session sees a block of a file once, five at a time.

The state of a (session, file) is the hashes it was shown, and never expires.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOST = 5
OUT = "session string, file string, hash string, score long, place int"


def _fresh(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    shown = list(state.get[0]) if state.exists else []
    rows = pd.concat(list(batches))
    rows = rows.sort_values(["score", "start", "hash"], ascending=[False, True, True]).drop_duplicates("hash")
    rows = rows[~rows["hash"].isin(shown)].head(MOST)
    state.update((shown + rows["hash"].tolist(),))
    yield pd.DataFrame({"session": key[0], "file": key[1], "hash": rows["hash"], "score": rows["score"], "place": range(1, len(rows) + 1)})


def unseen(findings: DataFrame) -> DataFrame:
    """A stream of findings (session, file, start, hash, score) -> what each session hasn't seen."""
    rows = findings.withColumn("session", F.coalesce("session", F.lit("default")))
    return rows.groupBy("session", "file").applyInPandasWithState(_fresh, OUT, "shown array<string>", "append", GroupStateTimeout.NoTimeout)


def unseen_batch(findings: DataFrame, most: int = MOST) -> DataFrame:
    """The same for one batch and empty state, as a window."""
    from pyspark.sql.window import Window

    rows = findings.withColumn("session", F.coalesce("session", F.lit("default")))
    once = rows.groupBy("session", "file", "hash").agg(F.max(F.struct("score", (-F.col("start")).alias("s"))).alias("m"))
    order = Window.partitionBy("session", "file").orderBy(F.col("m.score").desc(), F.col("m.s").desc(), "hash")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("session", "file", "hash", F.col("m.score").alias("score"), "place")
