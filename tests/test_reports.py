"""Ranks by two histograms, and names that don't clash."""

import random
import statistics

from pyspark.sql import functions as F

from tidewell.operators import evaluation
from tidewell.sources import text_files


def test_ranked_values(spark):
    r = random.Random(6)
    groups = {"even": [r.random() for _ in range(200)], "ties": [r.choice([1.0, 2.0, 2.0, 7.5]) for _ in range(301)], "one": [4.0], "same": [3.0] * 50, "wide": [10.0 ** r.randrange(-9, 9) for _ in range(99)], None: [5.0, 1.0]}
    df = spark.createDataFrame([(g, v) for g, values in groups.items() for v in values] + [("even", None), ("none", None)], "g string, v double")
    n = F.col("n")
    got = {row["g"]: (row["p50"], row["p95"]) for row in evaluation.ranked_values(df, "g", "v", {"p50": [F.floor((n - 1) / 2), F.floor(n / 2)], "p95": [F.bround(0.95 * (n - 1))]}, cells=8).collect()}
    assert got == {g: (statistics.median(v), sorted(v)[round(0.95 * (len(v) - 1))]) for g, v in groups.items()}


def test_safe_names(spark):
    files = [("j", 0, "a.png"), ("j", 1, "a.png"), ("j", 2, "a_0001.png"), ("j", 3, "a_0003.png"), ("j", 4, "a.png"), ("j", 5, "noext"), ("j", 6, "noext"), ("j", 12345, "a.png"), ("k", 7, "a.png"), ("k", 8, "b.tar.gz")]
    rows = text_files.safe_names(spark.createDataFrame(files, "job string, index int, name string"), "job", "index", "name").collect()
    names = {(r["job"], r["index"]): r["out_name"] for r in rows}
    assert len(set((j, n) for (j, _), n in names.items())) == len(files) == len(rows)
    assert names["j", 0] == "a_result.png" and names["j", 2] == "a_0001_result.png" and names["j", 4] == "a_0004_result.png" and names["j", 6] == "noext_0006_result"
    assert names["j", 12345] == "a_12345_result.png" and names["k", 7] == "a_result.png" and names["k", 8] == "b.tar_result.gz"
