"""Hand-written answers with the hard cases."""

from pyspark.sql import functions as F

from tidewell.operators import answers

KNOWN = {"dog": "dog", "car": "car", "bus": "bus", "glasses": "glasses"}
TEXTS = [
    None, "", "no json", "{broken", '{"target": "Dogs"}', '{"target": ["a red car", "CAR", ""], "effect": "keep", "intensity": 140.9}',
    '{"target": [], "effect": "blur"}', '{"target": ["bus"], "effect": "melt"}', '{"target": ["kite"], "effect": "crop", "intensity": "x", "crop": false}',
    'so ```json\n{"target": ["buses"], "selector": {"position": "TOP", "rank": 1, "count": 51, "attributes": "blue  hat"}} ```',
    '{"target": ["glasses"], "intensity": -3.7, "selector": {"position": "left", "rank": 2, "attributes": ["a", "b", "A", "c", "d", "e", "f"]}}',
]
WANT = [
    None, None, None, None, (["dog"], "remove_bg", 15, False, None, None, None, []), (["car"], "remove_bg", 100, False, None, None, None, []),
    None, None, (["kite"], "crop", 15, True, None, None, None, []), (["bus"], "remove_bg", 15, False, None, None, None, ["blue hat"]),
    (["glasses"], "remove_bg", 0, False, "left", 2, None, ["a", "b", "c", "d", "e"]),
]


def test_parsed(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k long, text string")
    got = {r["k"]: r["answer"] and tuple(r["answer"]) for r in answers.parsed(df, F.col("text"), KNOWN, {"keep": "remove_bg"}).collect()}
    assert [got[k] for k in range(len(TEXTS))] == WANT


def test_scores_without_a_prediction(spark):
    df = answers.parsed(spark.createDataFrame([(1, TEXTS[4], None), (2, None, None)], "k long, text string, x string"), F.col("text"), KNOWN, {})
    gold = answers.parsed(spark.createDataFrame([(1, TEXTS[4]), (2, TEXTS[4])], "k long, text string"), F.col("text"), KNOWN, {}).select("k", F.col("answer").alias("gold"))
    rows = {r["k"]: r for r in answers.scored(df.join(gold, "k"), "answer", "gold").collect()}
    assert rows[1]["exact"] and rows[1]["valid"] and not rows[2]["exact"] and not rows[2]["valid"] and not rows[2]["rank_ok"]
