"""Majority votes over repeated answers, and what they show about stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.latest import best_per_key


def majority(votes: DataFrame, heuristic: DataFrame) -> DataFrame:
    """``prompt_id, answer, n_samples, decided_by``.

    ``votes``: ``prompt_id, pos, answer``; ``heuristic``: ``prompt_id, answer``, which has one vote if there is more than one sample.
    Ties go to the answer with more samples, then to the earliest.
    """
    sizes = votes.groupBy("prompt_id").agg(F.count("*").alias("n_samples"))
    counts = votes.groupBy("prompt_id", "answer").agg(F.count("*").alias("own"), F.min("pos").alias("first"))
    extra = heuristic.join(sizes.where("n_samples > 1"), "prompt_id").select("prompt_id", "answer", F.lit(1).alias("extra"))
    both = counts.join(extra, ["prompt_id", "answer"], "full").na.fill({"own": 0, "extra": 0})
    order = [F.desc(F.col("own") + F.col("extra")), F.desc("own"), F.asc_nulls_last("first"), F.asc("answer")]
    won = best_per_key(both, ["prompt_id"], order).join(sizes, "prompt_id")
    by = F.when(F.col("own") == 0, "heuristic").when(F.col("n_samples") > 1, "vote").otherwise("llm")
    return won.select("prompt_id", "answer", "n_samples", by.alias("decided_by"))


def stability(votes: DataFrame) -> DataFrame:
    """One row: prompts, and the share of them whose answers, null being one, are all alike."""
    per = votes.groupBy("prompt_id").agg((F.count_distinct(F.coalesce("answer", F.lit("\0"))) == 1).alias("same"))
    return per.agg(F.count("*").alias("n"), F.avg(F.col("same").cast("double")).alias("share"))


def always_wrong(votes: DataFrame, right: Column) -> DataFrame:
    """Prompts of which no answer is right."""
    return votes.groupBy("prompt_id").agg(F.every(~F.coalesce(right, F.lit(False))).alias("bad")).where("bad").select("prompt_id")


def confusion(pred: Column, gold: Column) -> Column:
    """How a set of targets differs from the right one: ok, extra, missing, wrong or, without an answer, invalid."""
    over, under = F.size(F.array_except(pred, gold)), F.size(F.array_except(gold, pred))
    kind = F.when((over == 0) & (under == 0), "ok").when(under == 0, "extra").when(over == 0, "missing").otherwise("wrong")
    return F.when(pred.isNull(), "invalid").otherwise(kind)
