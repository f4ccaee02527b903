"""Files of every kind: names, bad rows, blank lines; template texts against plain loops."""

import json
import zlib
from collections import Counter

from pyspark.sql.types import StringType, StructField, StructType

from tidewell.operators import curation
from tidewell.sources import text_files

SCHEMA = StructType([StructField("prompt", StringType()), StructField("vote", StringType())])


def test_json_folder_skips_what_is_no_object(spark, tmp_path):
    for name, text in (("b.json", '{"prompt": "x", "vote": "like"}'), ("a.json", "{broken"), ("c.json", "[1]"), ("d.json", '{"prompt": null}')):
        (tmp_path / name).write_text(text)
    assert sorted(map(tuple, text_files.json_folder(spark, str(tmp_path), SCHEMA).collect())) == [("b", "x", "like"), ("d", None, None)]


def test_json_lines_count_blank_and_bad_lines(spark, tmp_path):
    (tmp_path / "seed.jsonl").write_text('{"prompt": "a"}\n\nbad\n{"prompt": "b", "vote": "x"}\n')
    got = sorted(map(tuple, text_files.json_lines(spark, str(tmp_path), SCHEMA, "seed").collect()))
    assert got == [("seed_0001", "a", None, "seed"), ("seed_0004", "b", "x", "seed")]


def test_coco_owner_and_lines(spark, tmp_path):
    coco = {"images": [{"id": 1, "file_name": "a.jpg", "width": 4, "height": 3}, {"id": 2, "file_name": "b.jpg", "width": 4, "height": 3}], "categories": [{"id": 9, "name": "dog"}],
            "annotations": [{"image_id": 1, "category_id": 9, "bbox": [0, 0, 1, 1], "area": 1.0, "iscrowd": 0}, {"image_id": 1, "category_id": 9, "bbox": [0, 0, 2, 2], "area": 4.0, "iscrowd": 1}]}
    (tmp_path / "coco.json").write_text(json.dumps(coco))
    got = {r["image_id"]: r["annotations"] and [(a["label"], a["area"]) for a in r["annotations"]] for r in text_files.coco_images(spark, str(tmp_path / "coco.json")).collect()}
    assert got == {1: [("dog", 1.0)], 2: None}
    for name, user in (("one", "u1"), ("two", "u2")):
        (tmp_path / "own" / name).mkdir(parents=True)
        (tmp_path / "own" / name / "owner.json").write_text(json.dumps({"user_id": user}))
    assert [r[0] for r in text_files.owner_folders(spark, str(tmp_path / "own" / "*" / "owner.json"), "u2").collect()] == ["two"]
    text_files.write_json_lines(spark.createDataFrame([(1, None)], "a long, b string"), str(tmp_path / "lines"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "lines")).collect()] == ['{"a":1}']


def test_template_corpus_and_replay(spark):
    rows = spark.range(200).selectExpr("id", "concat('w', id) as word")
    got = {r["id"]: r["text"] for r in curation.template_corpus(rows, {"a {}": 2, "b {}": 1}, "id", "word").collect()}
    assert got == {k: f"{'a' if zlib.crc32(f'{k}/0'.encode()) % 3 < 2 else 'b'} w{k}" for k in range(200)}
    hard, held = rows.where("id % 10 = 0"), rows.where("id % 20 = 0")
    mix = Counter(r["stream"] for r in curation.replay_mix(hard, rows, held, "id", 0.3).collect())
    assert mix == {"hard": 10, "replay": sum(k % 10 != 0 and zlib.crc32(f"{k}/0".encode()) % 1000 < 300 for k in range(200))}
    named = curation.class_prompts(spark.createDataFrame([(1, "dog"), (1, "cat"), (1, "dog")], "image long, label string"), "image", "label", ["keep {}", "drop {}"])
    assert [r["text"].split(" ", 1)[1] for r in named.collect()] == ["cat and dog"]
