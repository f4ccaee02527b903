"""A corpus pipeline of five stages over ``documents``.

Every stage works on all rows of its predecessor and hands on the columns of ``documents``; the last gives
the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontamination, near_dedup, packing, suffix_dedup, toxicity
from tidewell.llm.queries import read, remainder, tokenizer_path
from tidewell.llm.shared import dealt, forget, written

#: Bytes of the least repeated string that the suffix stage removes: under 50 words of 4.8 bytes, blank included (the corpus has 6.5).
REPEAT_BYTES = 240


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject; it learns from the same labels as the query of operator 9."""
    model = toxicity.learn(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where(remainder(3) != 1))
    return toxicity.toxicity(docs, model).where("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of five-word shingle sets with similarity 0.8 or more: the least doc_id, null last.

    Rows are told apart by a number of their own, so rows that share a doc_id but not their text are judged each.
    """
    rows = written(docs.withColumn("tidewell row", F.monotonically_increasing_id()))
    number = F.col("`tidewell row`").alias("row")
    groups = near_dedup.near_duplicates(rows.select(number.alias("doc_id"), "text"), size=5, percent=80).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = rows.select(number, "doc_id").join(dealt(groups), "row").groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.row").alias("tidewell row"))
    return rows.join(dealt(first), "tidewell row", "left_semi").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of ``REPEAT_BYTES`` bytes that start more than once in the corpus; ``n_chars`` follows."""
    left = suffix_dedup.suffix_dedup(docs, REPEAT_BYTES)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs."""
    return decontamination.phrase_matches(docs, read(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their place in sequences of 2048 tokens."""
    return packing.best_fit_packing(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each stage's rows are written and read again as the next one's ``docs``, and deleted when that one is done."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        made = written(stage(spark, docs, sf_dir))
        if k:
            forget(docs)
        docs = made
    return docs


#: The classifier and the packing have no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None
