"""One row per key: the latest, the best, the first; and the last few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, which must be total within a key.

    Written as a ranked window, which Spark cuts to one row per key and task before the shuffle, so a hot key costs no
    more than another.
    """
    ranked = df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_place = 1").drop("_place")


def last_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in ``order``."""
    ranked = df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_place") <= n).drop("_place")


def ranked_by(column: str, ranks: dict[str, int], missing: int = 0) -> Column:
    """A value's rank in ``ranks``."""
    out = F.lit(missing)
    for name, rank in ranks.items():
        out = F.when(F.col(column) == name, rank).otherwise(out)
    return out


def priority_dedupe(df: DataFrame, key: Column, priority: Column, seq: str) -> DataFrame:
    """Of rows with one key the one of highest priority; the later row, by ``seq``, wins a tie."""
    rows = df.withColumn("_key", key).withColumn("_priority", priority)
    return best_per_key(rows, ["_key"], [F.desc("_priority"), F.desc(seq)]).drop("_key", "_priority")
