"""The store keeps one whole state whenever a writer dies; the use of folders is read from file metadata."""

import os

import pytest
from pyspark.sql import functions as F

from tidewell.sources.store import DocumentStore, file_table, folder_usage

SCHEMA = "owner string, id long, at int, text string"


def rows(store):
    return sorted(map(tuple, store.read().collect()), key=str)


def test_writes_replace_by_key_and_keep_the_newest_of_each_owner(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "s"), "id", "at", ["owner"], keep=2)
    assert store.read() is None and store.tidy() == 0
    store.write(spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 2, "y"), ("a", 3, 3, "z"), ("b", 1, None, "n"), ("b", 1, None, "m")], SCHEMA))
    assert rows(store) == [("a", 2, 2, "y"), ("a", 3, 3, "z"), ("b", 1, None, "n")]
    # A written row replaces the stored one even with an older time; null owners and keys are keys as well.
    store.write(spark.createDataFrame([("a", 3, 0, "again"), (None, None, 5, None), (None, None, 6, "kept")], SCHEMA))
    assert rows(store) == sorted([("a", 2, 2, "y"), ("a", 3, 0, "again"), ("b", 1, None, "n"), (None, None, 6, "kept")], key=str)
    store.write(spark.createDataFrame([], SCHEMA))
    assert len(rows(store)) == 4


def test_without_an_owner_the_limit_counts_all_rows(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "s"), "id", "at", keep=200)
    for first in (0, 150):
        store.write(spark.range(first, first + 150).select("id", F.col("id").cast("int").alias("at"), F.lit("t").alias("text")))
    assert sorted(r.id for r in store.read().collect()) == list(range(100, 300))


@pytest.mark.parametrize("step", ["before the pointer", "before the move"])
def test_a_killed_writer_changes_nothing(spark, tmp_path, monkeypatch, step):
    store = DocumentStore(spark, str(tmp_path / "s"), "id", "at")
    first = spark.createDataFrame([(1, 1, "first")], "id long, at int, text string")
    store.write(first)
    held = store.current()

    def killed(name):
        if step == "before the move":
            (tmp_path / "s" / "pointer-dead").write_text(name)
        raise KeyboardInterrupt

    monkeypatch.setattr(store, "_point", killed)
    with pytest.raises(KeyboardInterrupt):
        store.write(spark.createDataFrame([(1, 2, "second")], first.schema))
    again = DocumentStore(spark, str(tmp_path / "s"), "id", "at")
    assert again.current() == held and rows(again) == [(1, 1, "first")]
    again.write(spark.createDataFrame([(2, 2, "third")], first.schema))
    assert rows(again) == [(1, 1, "first"), (2, 2, "third")]
    # The dead writer's state, its pointer if any, and the first state.
    assert again.tidy() == (3 if step == "before the move" else 2)
    assert rows(again) == [(1, 1, "first"), (2, 2, "third")]


def test_a_state_half_written_is_not_read(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "s"), "id", "at")
    store.write(spark.createDataFrame([(1, 1)], "id long, at int"))
    (tmp_path / "s" / "state-half").mkdir()
    for text in ("state-half", "state-none", "", "../s/" + store.current()):
        for old in ("current", ".current.crc"):
            (tmp_path / "s" / old).unlink(missing_ok=True)
        (tmp_path / "s" / "current").write_text(text)
        assert store.read() is None


def test_use_of_folders(spark, tmp_path):
    now = 1_700_000_000
    for name, size, hours in [("batches/b1/in.png", 10, 1), ("batches/b2/in.png", 5, 30.26), ("j1/in.png", 7, 2), ("j 2'/deep/out.png", 1, 48), ("beside.txt", 99, 99)]:
        file = tmp_path / "root" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"x" * size)
        os.utime(file, (now - hours * 3600,) * 2)
    files = file_table(spark, str(tmp_path / "root"))
    assert "content" not in files._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    assert files.count() == 5
    got = folder_usage(files, ["batches", "videos"], "jobs", 24, F.timestamp_seconds(F.lit(now)))
    assert sorted(map(tuple, got.collect())) == [("batches", 2, 15, 30.3, 1), ("jobs", 2, 8, 48.0, 1), ("videos", 0, 0, None, 0)]
