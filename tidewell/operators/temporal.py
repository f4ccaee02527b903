"""Rules that depend on time or order: quotas, expiry, progress, held values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators import segments


def local_day(ts: Column, hours: int = 9) -> Column:
    """The date of a UTC time in a zone ``hours`` ahead."""
    return F.to_date(ts + F.make_dt_interval(F.lit(0), F.lit(hours)))


def daily_quota(uses: DataFrame, key: str, ts: str, seq: str, limit: int = 10) -> DataFrame:
    """``uses`` with ``day`` and ``allowed``: the first ``limit`` uses of a key on a day; refused uses don't count."""
    rows = uses.withColumn("day", local_day(F.col(ts)))
    return segments.running_count(rows, [key, "day"], [ts, seq], "allowed").withColumn("allowed", F.col("allowed") <= limit)


def expired(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows older than ``days`` at ``now``."""
    return df.where(F.col(ts) < now - F.make_dt_interval(F.lit(days)))


def progress(items: DataFrame, batch: str, order: str, failed: Column) -> DataFrame:
    """Per item: how many of its batch are done, how many failed, the share, and the status."""
    w = Window.partitionBy(batch)
    run = w.orderBy(order)
    rows = items.withColumn("completed", F.row_number().over(run)).withColumn("failed", F.sum(failed.cast("int")).over(run))
    rows = rows.withColumn("progress", F.round(F.col("completed") / F.count("*").over(w), 4))
    last = F.col("progress") == 1
    return rows.withColumn("status", F.when(~last, "running").when(F.col("failed") == F.col("completed"), "failed").otherwise("done"))
