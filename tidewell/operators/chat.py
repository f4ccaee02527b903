"""Conversations: what goes to a model, and short follow-up questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import SPACE


# Fixed value: how a question that leans on the one before begins.
FOLLOW_UP = "^(그|저|왜|그럼|더|자세히|그건|그게)"


def trimmed(text):
    return F.regexp_replace(text, rf"^{SPACE}|{SPACE}$", "")


def chat_context(turns: DataFrame, last: int = 12) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) to send: user and assistant turns with text, the ``last`` ones, from the first user turn on.

    Conversations whose last such turn isn't the user's have none.
    """
    rows = turns.where(F.col("role").isin("user", "assistant")).withColumn("text", trimmed(F.col("text"))).where("text <> ''")
    whole = Window.partitionBy("conv_id")
    rows = rows.withColumn("_back", F.row_number().over(whole.orderBy(F.desc("turn")))).where(F.col("_back") <= last)
    rows = rows.withColumn("_first", F.min(F.when(F.col("role") == "user", F.col("turn"))).over(whole))
    rows = rows.withColumn("_last", F.max_by("role", "turn").over(whole))
    return rows.where((F.col("turn") >= F.col("_first")) & (F.col("_last") == "user")).drop("_back", "_first", "_last")


def focused(turns: DataFrame, short: int = 16) -> DataFrame:
    """``conv_id, turn, focus`` of user turns: a text under ``short`` characters comes after the user's text before it."""
    rows = turns.where("role = 'user'").withColumn("text", trimmed(F.col("text")))
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = rows.withColumn("before", F.coalesce(before, F.lit("")))
    both = F.trim(F.concat("before", F.lit(" "), "text"))
    follows = (F.length("text") < short) | F.col("text").rlike(FOLLOW_UP)
    return rows.select("conv_id", "turn", F.when(follows & (F.col("before") != ""), both).otherwise(F.col("text")).alias("focus"))
