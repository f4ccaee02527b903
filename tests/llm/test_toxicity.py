import zlib

from tidewell.llm import toxicity
from tidewell.llm.queries import op9_toxicity

SF01 = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    rows = op9_toxicity(spark, SF01).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    hits, alarms, toxic = (sum(map(f, held)) for f in (lambda x: x == (1, 1), lambda x: x == (1, 0), lambda x: x[1] == 1))
    assert hits > 0.8 * toxic and alarms <= 0.01 * len(held)


def learned(spark, rows, **settings):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    return toxicity.learn(docs, labels, **settings)


def test_counterfactual_penalty_lowers_the_change_under_swaps(spark):
    rows = [(f"the muslims are trash {i}", 1) for i in range(20)] + [(f"muslims met us {i}", 1) for i in range(6)]
    rows += [(f"the christians met us {i}", 0) for i in range(40)] + [(f"a plain day {i}", 0) for i in range(40)]

    def gap(model):
        return abs(model.logit(toxicity.counted("muslims met us")) - model.logit(toxicity.counted("christians met us")))

    free, held = (learned(spark, rows, penalty=p, least_z=2.0) for p in (0.0, 10.0))
    assert gap(held) < 0.3 * gap(free)
    assert held.score("you are trash") > held.score("muslims met us")


def test_hard_cases(odd_docs, no_docs, spark):
    for rows in ([], [("a", 1)], [("a", 0), (None, 0)]):
        assert 0 <= learned(spark, rows).score(None) <= 1
    model = learned(spark, [("bad word", 1), ("good word", 0)] * 10, least_z=2.0)
    assert toxicity.toxicity(odd_docs, model).count() == odd_docs.count() and toxicity.toxicity(no_docs, model).count() == 0
    labels = spark.createDataFrame([(4, None), (5, 1), (99, 0)], "doc_id long, toxic int")
    assert 0 <= toxicity.learn(odd_docs, labels).score("x") <= 1
