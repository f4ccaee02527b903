"""Running values over cut keys equal those of one window over the whole key."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import segments

ROWS = 3000


def events(spark):
    """A third of the rows has one key, some have none; times repeat, values are null in long runs."""
    i = F.col("id")
    key = F.when(i % 3 == 0, "hot").when(i % 101 != 0, F.concat(F.lit("k"), (i % 40).cast("string")))
    value = F.when(F.pmod(F.xxhash64(i), F.lit(50)) == 0, i)
    time = F.when(i % 97 != 0, F.pmod(F.xxhash64(i, F.lit(1)), F.lit(500)))
    return spark.range(ROWS).select("id", key.alias("key"), time.alias("time"), value.alias("value"), F.lit("mine").alias("segment"), F.lit("my own").alias("before"))


def test_held_values_of_a_hot_key(spark):
    df = events(spark)
    w = Window.partitionBy("key").orderBy("time", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("held", F.last("value", ignorenulls=True).over(w))
    got = segments.hold_last(df, "key", ["time", "id"], F.col("value"), "held", ranges=9)
    assert got.columns == want.columns
    assert sorted(got.collect(), key=lambda r: r.id) == sorted(want.collect(), key=lambda r: r.id)


def test_running_numbers_of_a_hot_key(spark):
    df = events(spark)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("key", "segment").orderBy("time", "id")))
    got = segments.running_count(df, ["key", "segment"], ["time", "id"], "n", ranges=9)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_no_segment_holds_much_of_the_hot_key(spark):
    cut = segments.cut(events(spark), ["key"], ["time", "id"], "part", 9)
    sizes = [r["count"] for r in cut.groupBy("part").count().collect()]
    assert len(sizes) == 9 and max(sizes) <= 2 * ROWS / 9
    assert cut.where("key = 'hot'").select("part").distinct().count() >= 3
    # Segments follow the order of a key's rows.
    bounds = cut.where("key = 'hot'").groupBy("part").agg(F.min(F.struct("time", "id")).alias("low"), F.max(F.struct("time", "id")).alias("high")).orderBy("part").collect()
    assert all(a.high < b.low for a, b in zip(bounds, bounds[1:]) if None not in (*a.high, *b.low))


def test_what_is_carried_is_bounded_by_the_segments(spark):
    cut = segments.cut(events(spark), ["key"], ["time", "id"], "part", 9)
    rows = segments.carried(cut, ["key"], "part", F.count("*"), F.sum, "n")
    assert rows.where("n is not null").select("key", "part").distinct().count() <= 8


def test_ties_repeats_and_empty_tables(spark):
    rows = [("a", 1, 5), ("a", 1, 5), ("a", 2, None), (None, 1, None), (None, None, 7)]
    df = spark.createDataFrame(rows, "key string, time int, value int")
    got = segments.hold_last(df, "key", ["time"], F.col("value"), "value", ranges=4)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 1, 5), ("a", 1, 5), ("a", 2, 5), (None, 1, 7), (None, None, 7)], key=str)
    none = df.where("false")
    assert segments.hold_last(none, "key", ["time"], F.col("value"), "held").collect() == []
    numbers = segments.running_count(df, ["key"], ["time"], "n", ranges=4).where("key = 'a'").collect()
    assert sorted(r.n for r in numbers) == [1, 2, 3]
    assert segments.running_count(none, ["key"], ["time"], "n").collect() == []
