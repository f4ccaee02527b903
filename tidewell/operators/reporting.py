"""Counts, facets, pages and dashboards over review samples, users and events."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per combination of ``keys``; nulls are a value."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def nested_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Per ``outer`` value a map from ``inner`` value to rows, null named ``none``."""
    pairs = df.groupBy(outer, F.coalesce(F.col(inner), F.lit("none")).alias("inner")).agg(F.count("*").alias("n"))
    return pairs.groupBy(outer).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("inner", "n")))).alias("counts"))


def source_filter(source: str | None, groups: dict[str, Iterable[str]]) -> Column | None:
    """A named group of sources, or a comma-separated list of them; none: no filter."""
    if not source:
        return None
    wanted = groups.get(source) or [x.strip() for x in source.split(",") if x.strip()]
    return F.col("source").isin(*wanted)


def matching(df: DataFrame, hidden: str | None = "deleted", contains: str | None = None, text: str = "text", **equal: object) -> DataFrame:
    """Rows that meet every given condition; without a ``status`` rows with the ``hidden`` status are left out.

    ``contains``: literal, case-insensitive part of ``text``. Conditions that are None don't count.
    """
    tests = [F.col(k) == F.lit(v) for k, v in equal.items() if v is not None]
    if equal.get("status") is None and hidden is not None and "status" in df.columns:
        tests.append(~F.col("status").eqNullSafe(F.lit(hidden)))
    if contains:
        tests.append(F.contains(F.lower(F.col(text)), F.lit(contains.lower())))
    return df.where(reduce(and_, tests)) if tests else df


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0, most: int = 200) -> DataFrame:
    """One page in a total order, with the number of all rows beside each: ``total``.

    The count is an aggregate of its own, joined to the page, so that the page stays a top-k and no row of the table is sorted
    beyond it.
    """
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset(max(offset, 0)).limit(max(1, min(limit, most)))
    return rows.join(F.broadcast(total))


def newest(df: DataFrame, when: str, key: str, limit: int, owner: str | None = None) -> DataFrame:
    """The newest ``limit`` rows, of one ``owner`` column's value each if given; ties by ``key``."""
    from pyspark.sql import Window

    if owner is None:
        return df.orderBy(F.col(when).desc(), F.col(key)).limit(limit)
    order = Window.partitionBy(owner).orderBy(F.col(when).desc(), F.col(key))
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def with_counts(parents: DataFrame, key: str, **children: tuple[DataFrame, str]) -> DataFrame:
    """Parents with the number of rows that each child table has for their key; 0 for none.

    Each child is counted before the join, so no join multiplies rows.
    """
    out = parents
    for name, (child, foreign) in children.items():
        own = child.where(F.col(foreign).isNotNull()).groupBy(F.col(foreign).alias(key)).agg(F.count("*").alias(name))
        out = out.join(own, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    return out


def facets(df: DataFrame, kind: str, status: str, default: str) -> DataFrame:
    """Rows by kind, and by status within it, in one pass; ``level`` 1 has the totals of a kind."""
    rows = df.select(F.coalesce(F.col(kind), F.lit(default)).alias("kind"), F.col(status).alias("status"))
    sets = rows.groupingSets([["kind"], ["kind", "status"]], "kind", "status")
    return sets.agg(F.count("*").alias("n"), F.grouping("status").cast("int").alias("level"))


def dashboard(df: DataFrame, status: str, quality: str, names: Iterable[str]) -> DataFrame:
    """One row: all rows, rows per status and the mean quality, null as 0; 0 for no rows."""
    parts = [F.count_if(F.col(status) == x).alias(f"n_{x}") for x in names]
    mean = F.coalesce(F.avg(F.coalesce(F.col(quality), F.lit(0.0))), F.lit(0.0)).alias("mean_quality")
    return df.agg(F.count("*").alias("total"), *parts, mean)


def failed_items(items: Column, ok: str = "ok") -> Column:
    """How many structs of an array have a status other than ``ok``; a null status is a failure."""
    return F.size(F.filter(items, lambda x: ~x["status"].eqNullSafe(F.lit(ok))))


def usage(df: DataFrame, area: str, size: Column, when: Column, now: Column, keep_days: int) -> DataFrame:
    """Per area: rows, bytes, the oldest age in days and how many are past their time."""
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp(when)) / 86400)
    rows = df.select(F.col(area).alias("area"), size.alias("size"), age.alias("age"))
    return rows.groupBy("area").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("age").alias("oldest_days"), F.count_if(F.col("age") > keep_days).alias("expired")
    )


def signature(df: DataFrame, when: str) -> DataFrame:
    """One row that changes when rows come, go or are updated: their number and latest time."""
    return df.agg(F.count("*").alias("n"), F.max(F.unix_timestamp(when)).alias("latest"))


def age_name(seconds: Column) -> Column:
    """A short name of an age: now, minutes, hours, days, or older."""
    minutes = F.floor(seconds / 60)
    return (
        F.when(minutes < 1, F.lit("now"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h")))
        .when(minutes < 10080, F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d")))
        .otherwise(F.lit("older"))
    )
