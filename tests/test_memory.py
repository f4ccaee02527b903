"""Exchanges join the item they resemble; figures by hand."""

import math

from tidewell.operators import memory

LONG = "An answer with rather more than forty characters in it."
SCHEMA = "store int, n int, question string, answer string, similar array<string>, sources array<string>"


def test_scores_by_hand():
    counts = [memory.Counter(["aa", "bb"]), memory.Counter(["cc", "cc", "dd"]), memory.Counter(["ee"])]
    got = memory.okapi(["cc", "zz"], counts)
    idf = math.log(2.5 / 1.5)
    assert got[0] == got[2] == 0 and math.isclose(got[1], idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2)))
    items = [{"question": "how long is the river", "similar": []}, {"question": "who built the tower", "similar": []}, {"question": "name a cake", "similar": []}]
    items = [memory.indexed(i) for i in items]
    score, at = memory.nearest("who built the tower", items)
    assert at == 1 and math.isclose(score, 1.0)
    assert memory.nearest("zz", items) == (0.0, 2)


def test_exchanges(spark):
    rows = [
        (1, 1, "who built the tower", LONG, ["who made the tower", "short"], ["a"]), (1, 2, "how long is the river", LONG, None, None), (1, 3, " who built the tower ", LONG + " More.", [], ["b", None]),
        (1, 4, "too few", LONG, [], []), (1, 5, None, LONG, [], []), (1, 6, "who built the wall", memory.NO_ANSWER + LONG, [], []), (2, 1, "who built the tower", "short", [], []),
        (2, 2, "how long is the river", LONG, [], []), (2, 3, "how long is that river", LONG, ["x" * 200], []), (None, 1, "a store without name", LONG, [], []), (None, 2, "a store without name", LONG, [], []),
    ]
    done = memory.remembered(spark.createDataFrame(rows, SCHEMA), "store", ["n"])
    got = {(r["store"], r["n"]): (r["item_id"], r["merged"]) for r in done.collect()}
    assert len(got) == len(rows) and got[1, 1] == ("m0001", False) and got[1, 2] == ("m0002", False) and got[1, 3] == ("m0001", True)
    assert {got[1, k] for k in (4, 5, 6)} == {(None, False)} == {got[2, 1]} and got[None, 2] == ("m0001", True) and got[2, 2] == ("m0001", False)
    kept = {(r["store"], r["number"]): r for r in memory.stored(done, "store", ["n"]).collect()}
    assert kept[1, 1]["similar"] == ["who made the tower"] and kept[1, 1]["answer"].endswith("More.") and kept[1, 1]["sources"] == ["b"] and kept[1, 2]["similar"] == []
    assert memory.stored(done.where("false"), "store", ["n"]).count() == 0


def test_a_full_store_drops_its_oldest():
    now = None
    for k in range(203):
        now, made = memory.remember(now, (f"question{k:03d} topic{k * 7:04d}xyz", LONG, [], []))
    assert made[:3] == (203, "m0201", False) and len(now[1]) == 200 and now[1][0]["number"] == 4
