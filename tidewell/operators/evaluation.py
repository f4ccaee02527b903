"""Metrics: sweeps, percentiles, weighted means, acceptance of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def threshold_sweep(df: DataFrame, score: Column, present: Column, thresholds: list[float], by: str) -> DataFrame:
    """Recall, false rate and precision for each threshold, per ``by`` value and, with null there, overall."""
    rows = df.select(F.col(by), score.alias("s"), present.alias("p"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    hit = F.col("s") >= F.col("threshold")
    sets = rows.groupingSets([["threshold"], ["threshold", by]], "threshold", by)
    tp, fp = F.count_if(hit & F.col("p")), F.count_if(hit & ~F.col("p"))
    part = lambda a, b: F.round(a / F.greatest(b, F.lit(1)), 3)
    return sets.agg(part(tp, F.count_if(F.col("p"))).alias("recall"), part(fp, F.count_if(~F.col("p"))).alias("false_rate"), part(tp, tp + fp).alias("precision"))


def nearest_rank(df: DataFrame, by: str, value: str, q: float) -> DataFrame:
    """``by, value`` at rank ``round(q * (n - 1))``, halves to even, of each group's sorted values.

    Equal values are counted first, so a group is ranked by its distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(by)
    rank = F.bround(q * (F.sum("c").over(w) - 1))
    upto = F.sum("c").over(w.orderBy(value))
    return counts.withColumn("_rank", rank).withColumn("_upto", upto).where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("c") <= F.col("_rank"))).select(by, value)


def ranked_values(df: DataFrame, by: str, value: str, wanted: dict[str, list[Column]], cells: int = 4096) -> DataFrame:
    """``by`` and a column per name in ``wanted``: the mean of the values at the given ranks (from 0; ``n`` counts the group's values).

    Two histograms find them without sorting a group: values fall in ``cells`` equal cells between a group's least and greatest, and only values of the
    cells that hold a wanted rank are counted one by one. So a group with any share of all rows is spread over tasks; counts are summed before the shuffle.
    """
    rows = df.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("v"))
    ends = rows.groupBy(by).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * cells), F.lit(cells - 1))).otherwise(0)
    # A row per group at most: the null-safe join keeps values without a group's name.
    celled = rows.join(ends.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).select(by, "v", place.alias("cell"))
    order = Window.partitionBy(by).orderBy("cell")
    counts = celled.groupBy(by, "cell").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(order) - F.col("c"))
    ranks = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, all_ in wanted.items() for rank in all_)))
    asked = ends.select(F.col(by).alias("_by"), ranks.alias("w")).select("_by", "w.name", "w.rank")
    hit = counts.join(asked, F.col(by).eqNullSafe(F.col("_by")) & (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c"))).select("_by", "cell", "before", "name", "rank")
    within = celled.join(hit.select(F.col("_by").alias("_b"), F.col("cell").alias("_c")).distinct(), F.col(by).eqNullSafe(F.col("_b")) & (F.col("cell") == F.col("_c")), "left_semi")
    single = within.groupBy(by, "cell", "v").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(Window.partitionBy(by, "cell").orderBy("v")))
    single = single.withColumnRenamed("cell", "_c")
    at = single.join(hit, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_c") == F.col("cell")))
    at = at.where((F.col("before") + F.col("upto") > F.col("rank")) & (F.col("before") + F.col("upto") - F.col("c") <= F.col("rank")))
    return at.groupBy(by).agg(*(F.avg(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in wanted))


def latency_report(df: DataFrame, by: str, value: str, status: str) -> DataFrame:
    """Per ``by``: requests, median, 95th percentile by nearest rank (halves to even) and greatest ``value``, and how often each ``status`` came, as JSON."""
    n = F.col("n")
    ranks = {"p50": [F.floor((n - 1) / 2), F.floor(n / 2)], "p95": [F.bround(0.95 * (n - 1))]}
    values = ranked_values(df, by, value, ranks).withColumnRenamed(by, "_v")
    counts = df.groupBy(by, status).agg(F.count("*").alias("c"), F.max(value).alias("m"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(status).alias("s"), "c")))
    out = counts.groupBy(by).agg(F.sum("c").alias("requests"), F.max("m").alias("max"), F.to_json(F.map_from_entries(pairs)).alias("statuses"))
    return out.join(values, F.col(by).eqNullSafe(F.col("_v")), "left").select(by, "requests", "p50", "p95", "max", "statuses")


def weighted_mean(df: DataFrame, value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1))


def accepted(candidate: DataFrame, deployed: DataFrame, most_drop: int = 1) -> DataFrame:
    """One row: the gain over the sets both have, the worst drop, and whether the candidate is taken.

    Both: ``name, correct``. Taken if no set drops by more than ``most_drop`` and the gain is above 0.
    """
    both = candidate.join(deployed.select("name", F.col("correct").alias("before")), "name")
    out = both.agg(F.count("*").alias("sets"), F.sum(F.col("correct") - F.col("before")).alias("gain"), F.max(F.col("before") - F.col("correct")).alias("worst"))
    return out.withColumn("accepted", F.coalesce((F.col("worst") <= most_drop) & (F.col("gain") > 0), F.lit(False)))


def quality_score(ratio: Column, confidence: Column, least_confidence: float) -> Column:
    """Mean of how near an area ratio is to 0.35 and of the confidence against its least; both from 0 to 1; 0 without area."""
    area = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(ratio - 0.35) / 0.65))
    score = 0.5 * area + 0.5 * F.least(F.lit(1.0), confidence / max(least_confidence, 1e-6))
    return F.when(ratio <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
