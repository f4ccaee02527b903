"""Running values over ordered rows of a key, with the key's rows cut into ranges, so that no task sorts a hot key alone.

Rows are dealt to ranges of (key, order) by sampled bounds. A range's rows are folded to one summary per key, the summaries of earlier ranges are
combined, and what they give is carried into the running value within the range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.sources.tables import settled


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, with underscores behind it until no column has that name."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def cut(df: DataFrame, keys: list[str], order: list[str], segment: str, ranges: int | None = None) -> DataFrame:
    """``df`` with ``segment``: ascending numbers of ranges of (keys, order); rows equal in all of these share a range.

    The rows are written to the checkpoint folder, as the bounds of ranges are sampled and later steps must all see the same.
    ``ranges``: the session's shuffle partitions if not given.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(df.repartitionByRange(n, *keys, *order).withColumn(segment, F.spark_partition_id()))


def carried(rows: DataFrame, keys: list[str], segment: str, fold: Column, combine: Callable[[Column], Column], name: str) -> DataFrame:
    """``rows`` with ``name``: ``combine``, null over no rows, of the summaries ``fold`` of the same keys' earlier segments.

    Only keys with several segments have such rows, and neighbouring ones share at most a segment: there are fewer of these rows
    than segments, so they may be broadcast.
    """
    other = [free_name(rows, f"key{i}") for i in range(len(keys))]
    place = free_name(rows, "place")
    sums = rows.groupBy(*(F.col(k).alias(o) for k, o in zip(keys, other)), F.col(segment).alias(place)).agg(fold.alias(name))
    w = Window.partitionBy(*other).orderBy(place)
    sums = sums.withColumn(name, combine(F.col(name)).over(w.rowsBetween(Window.unboundedPreceding, -1))).where(F.col(name).isNotNull())
    same = F.col(segment) == F.col(place)
    for k, o in zip(keys, other):
        same &= F.col(k).eqNullSafe(F.col(o))
    return rows.join(F.broadcast(sums), same, "left").drop(*other, place)


def hold_last(df: DataFrame, key: str, order: list[str], value: Column, name: str, ranges: int | None = None) -> DataFrame:
    """``df`` with ``name``: the value, or where it is null the key's latest one before it; null if there is none.

    Rows are ordered by ``order``, nulls first; rows equal in it have no set order. A null key is a key of its own. Repeated rows stay, and so do all columns
    but one called ``name``, which is replaced. An empty table gives an empty one.
    """
    own, segment, before = (free_name(df, x) for x in ("own", "segment", "before"))
    rows = cut(df.withColumn(own, value), [key], order, segment, ranges)
    latest = F.max_by(own, F.when(F.col(own).isNotNull(), F.struct(*order)))
    rows = carried(rows, [key], segment, latest, lambda x: F.last(x, ignorenulls=True), before)
    w = Window.partitionBy(segment, key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = F.coalesce(F.last(own, ignorenulls=True).over(w), F.col(before))
    helpers = [x for x in (own, segment, before) if x != name]
    return rows.withColumn(name, held).drop(*helpers)


def running_count(df: DataFrame, keys: list[str], order: list[str], name: str, ranges: int | None = None) -> DataFrame:
    """``df`` with ``name``: the row's number among those of its keys, from 1, ordered as in ``hold_last``, of which the other rules hold too."""
    segment, before = (free_name(df, x) for x in ("segment", "before"))
    rows = carried(cut(df, keys, order, segment, ranges), keys, segment, F.count("*"), F.sum, before)
    number = F.row_number().over(Window.partitionBy(segment, *keys).orderBy(*order)) + F.coalesce(F.col(before), F.lit(0))
    helpers = [x for x in (segment, before) if x != name]
    return rows.withColumn(name, number).drop(*helpers)
