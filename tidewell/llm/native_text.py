"""Words as column expressions, without Python in tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words, before lower-casing: all of ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes up to which a table may be broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 16 << 20


def raw_words(text: Column) -> Column:
    """The words of a text in their own case; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), BETWEEN), "")


def lowered(word: Column) -> Column:
    """A word with A-Z in lower case; other letters stay."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.transform(raw_words(text), lowered)


def small(df: DataFrame, size: Column) -> DataFrame:
    """``df``, marked for broadcast if ``size`` summed over its rows shows that it is small enough."""
    total = df.agg(F.sum(size + 32).alias("n")).first()["n"] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df
