"""The pipeline stage by stage against brute force."""

from collections import Counter

import corpus_pipeline
import numpy as np
from tidewell.llm import toxicity
from tidewell.llm.queries import read, remainder
from tidewell.llm.shared import written

from .conftest import SF
from .test_decontamination import brute as brute_phrases
from .test_near_dedup import brute as brute_groups
from .test_tokens import check_packing

LEARN = "/root/testdata/sf0.1"  # the smallest folders have too few labels


def without_repeats(text, seen, width):
    data = (text or "").encode()
    hit = np.zeros(len(data) + 1, bool)
    for i in range(len(data) - width + 1):
        if seen[data[i : i + width]] > 1:
            hit[i : i + width] = True
    return bytes(b for b, h in zip(data, hit, strict=False) if not h).decode(errors="ignore")


def test_stages_against_brute_force(spark):
    steps = {name: stage for name, stage in corpus_pipeline.STAGES}
    docs = read(spark, SF, "documents")
    names = docs.columns

    model = toxicity.learn(read(spark, LEARN, "documents"), read(spark, LEARN, "labels").where(remainder(3) != 1))
    want = {r["doc_id"]: r["text"] for r in docs.collect() if model.score(r["text"]) < 0.7}
    now = written(steps["toxicity"](spark, docs, LEARN))
    assert {r["doc_id"]: r["text"] for r in now.collect()} == want and now.columns == names and len(want) < docs.count()

    kept = {r[0] for r in brute_groups(sorted(want.items()), 5) if r[3]}
    want = {i: t for i, t in want.items() if i in kept}
    now = written(steps["near_dedup"](spark, now, SF))
    assert {r["doc_id"]: r["text"] for r in now.collect()} == want and now.columns == names

    width = corpus_pipeline.REPEAT_BYTES
    seen = Counter(d[i : i + width] for t in want.values() for d in [t.encode()] for i in range(len(d) - width + 1))
    want = {i: without_repeats(t, seen, width) for i, t in want.items()}
    now = written(steps["suffix_dedup"](spark, now, SF))
    rows = now.collect()
    assert {r["doc_id"]: r["text"] for r in rows} == want and now.columns == names and all(r["n_chars"] == len(r["text"]) for r in rows)

    items = [(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()]
    clean = {r[0] for r in brute_phrases(want.items(), items) if not r[-1]}
    now = written(steps["decontamination"](spark, now, SF))
    assert {r["doc_id"]: r["text"] for r in now.collect()} == {i: t for i, t in want.items() if i in clean} and now.columns == names

    check_packing(now, steps["packing"](spark, now, SF), 2048)


def test_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        now = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = written(stage(spark, now, SF))
            assert now.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() >= now.count()
    assert odd_docs.where("doc_id = 7").count() == 2 and corpus_pipeline.drop_near_duplicates(spark, odd_docs, SF).where("doc_id = 7").count() == 1


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns[:3] == ["doc_id", "piece", "start"]
