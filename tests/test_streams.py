"""Folds over streams give what they give over tables; windows drop what is late."""

import datetime

from pyspark.sql import functions as F

from tidewell.operators import state
from tidewell.streaming.keyed import folded_stream, windowed_counts

HITS = [("a", 0.0), ("a", 1.0), ("a", 2.0), ("b", 2.0), ("a", 60.5), ("a", 61.5), ("b", 3.0), ("b", 63.0)]


def test_limiter_by_hand(spark):
    df = spark.createDataFrame(HITS, "k string, t double")
    got = sorted(tuple(r) for r in state.folded(df, "k", ["t"], ["t"], state.limiter(2, 60.0), "wait double").collect())
    assert got == [("a", 0.0, 0.0), ("a", 1.0, 0.0), ("a", 2.0, 58.0), ("a", 60.5, 0.0), ("a", 61.5, 0.0), ("b", 2.0, 0.0), ("b", 3.0, 0.0), ("b", 63.0, 0.0)]
    off = state.folded(df, "k", ["t"], ["t"], state.limiter(0, 60.0), "wait double")
    assert {r["wait"] for r in off.collect()} == {0.0}


def test_lockout_and_codes_by_hand():
    step, now, out = state.lockout(2, 10.0), None, []
    for t, right in ((0, False), (1, False), (5, True), (11, True), (12, False), (13, True)):
        now, made = step(now, (t, right))
        out.append(made[0])
    assert out == ["failed", "failed", "locked", "ok", "failed", "ok"]
    step, now, out = state.code_check(2, 100.0, 10.0), None, []
    for t, kind in ((0, "right"), (1, "send"), (5, "send"), (6, "wrong"), (7, "wrong"), (8, "right"), (12, "send"), (13, "right"), (14, "right")):
        now, made = step(now, (t, kind))
        out.append(made[0])
    assert out == ["invalid", "sent", "wait", "wrong", "invalid", "invalid", "sent", "ok", "invalid"]


def test_stream_equals_table(spark, tmp_path):
    source, done = tmp_path / "in", tmp_path / "out"
    for k in range(0, len(HITS), 4):
        spark.createDataFrame(HITS[k : k + 4], "k string, t double").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("k string, t double").option("maxFilesPerTrigger", 1).parquet(str(source))
    out = folded_stream(stream, "k", "t", ["t"], state.limiter(2, 60.0), "wait double", 3_600_000)
    q = out.writeStream.format("parquet").option("path", str(done)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    table = state.folded(spark.createDataFrame(HITS, "k string, t double"), "k", ["t"], ["t"], state.limiter(2, 60.0), "wait double")
    assert sorted(map(tuple, spark.read.parquet(str(done)).collect())) == sorted(map(tuple, table.collect()))


def test_windowed_counts(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", t), ("a", t + datetime.timedelta(minutes=1)), ("b", t + datetime.timedelta(minutes=11))], "k string, ts timestamp")
    got = {(r["k"], r["start"].minute, r["n"]) for r in windowed_counts(rows, "ts", "k", "10 minutes", "1 hour").collect()}
    assert got == {("a", 0, 2), ("b", 10, 1)} and rows.where(F.lit(False)).count() == 0
