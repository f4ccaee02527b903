"""Micro-batches merge once: replays, late rows, ties and a killed writer."""

from pathlib import Path

from pyspark.sql import functions as F

from tidewell.streaming.merging import KeyedTable, progress_stream

KINDS = "k string, at long, v string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), KINDS)


def state(table):
    return sorted(map(tuple, table.read().collect()), key=str)


def test_replays_late_rows_ties_and_nulls(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "k", ["at"], buckets=4)
    assert table.read() is None
    table.merge(rows(spark), 0)
    assert table.read() is None
    table.merge(rows(spark, ("a", 5, "x"), ("a", 5, "y"), ("b", 1, "x"), (None, 1, "n"), ("c", None, "x")), 1)
    first = state(table)
    assert first == sorted([("a", 5, "y"), ("b", 1, "x"), (None, 1, "n"), ("c", None, "x")], key=str)
    table.merge(rows(spark, ("a", 9, "other")), 1)
    assert state(table) == first
    table.merge(rows(spark, ("a", 4, "late"), ("b", 2, "new"), ("c", 0, "z"), ("d", 1, None)), 2)
    assert state(table) == sorted([("a", 5, "y"), ("b", 2, "new"), (None, 1, "n"), ("c", 0, "z"), ("d", 1, None)], key=str)


def test_killed_writer_changes_nothing(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "k", ["at"], buckets=1, keep=1)
    table.merge(rows(spark, ("a", 1, "x")), 0)
    table.merge(rows(spark, ("a", 2, "y")), 1)
    (Path(tmp_path) / "t" / "batch=1" / "_SUCCESS").unlink()
    # Kept parts of the batch before are gone with keep=1, so the batch is written again from what was sent.
    table.merge(rows(spark, ("a", 2, "y")), 1)
    assert state(table) == [("a", 2, "y")]
    kept = KeyedTable(spark, f"file://{tmp_path}/u", "k", ["at"], buckets=1)
    kept.merge(rows(spark, ("a", 1, "x"), ("b", 1, "x")), 0)
    kept.merge(rows(spark, ("a", 2, "y")), 1)
    (Path(tmp_path) / "u" / "batch=1" / "_SUCCESS").unlink()
    assert state(kept) == [("a", 1, "x"), ("b", 1, "x")]
    kept.merge(rows(spark, ("a", 2, "y")), 1)
    assert state(kept) == [("a", 2, "y"), ("b", 1, "x")]


def test_untouched_parts_stay_and_old_ones_go(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "k", ["at"], buckets=8)
    table.merge(rows(spark, *((f"k{i}", 0, "x") for i in range(40))), 0)
    for n in range(1, 5):
        table.merge(rows(spark, ("k1", n, "y")), n)
    parts = table.parts()
    assert sorted(len(v) for v in parts.values()) == [1] * 7 + [2]
    assert len(state(table)) == 40 and ("k1", 4, "y") in state(table)


def test_progress_of_a_stream(spark, tmp_path):
    items = [("p", True), ("p", False), ("q", True), ("p", False), ("r", None), ("q", True)]
    for k in range(0, len(items), 2):
        spark.createDataFrame(items[k : k + 2], "job string, bad boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    totals = spark.createDataFrame([("p", 4), ("q", 2)], "job string, total long")
    stream = spark.readStream.schema("job string, bad boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    table = KeyedTable(spark, f"file://{tmp_path}/t", "job", ["completed"], buckets=2)

    def twice(batch, number):
        table.merge(batch, number)
        table.merge(batch.withColumn("completed", F.lit(99).cast("long")), number)

    out = progress_stream(stream, totals, "job", F.col("bad")).writeStream.outputMode("update").foreachBatch(twice)
    out.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
    assert state(table) == [("p", 3, 1, 0.75, "running"), ("q", 2, 2, 1.0, "failed"), ("r", 1, 0, None, "running")]
