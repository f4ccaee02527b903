import hashlib
import re
from collections import defaultdict

from tidewell.llm.decontamination import phrase_matches, proximity_matches
from tidewell.llm.queries import op4_decontamination

from .conftest import SF


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = split(text)
        hit, ids = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    ids |= found
                    hit |= set(range(i, i + n))
        out.append((doc or 0, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def rows(df):
    return sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["contaminated"]) for r in df.collect())


def test_query_against_brute_force(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = brute([(r["doc_id"], r["text"]) for r in docs], [(r["item_id"], r["text"]) for r in items])
    assert sorted(map(tuple, op4_decontamination(spark, SF).collect())) == want and any(w[-1] for w in want)


def test_hard_cases(spark, odd_docs, no_docs):
    text = odd_docs.where("doc_id = 4").first()["text"]
    own = [(10, text[40:200].upper()), (2, text[100:260]), (3, None), (4, ""), (5, "A"), (5, "a a"), (6, "É" * 900), (7, "nowhere at all"), (8, "a " * 30)]
    items = spark.createDataFrame([(*x, 1) for x in own], "item_id long, text string, n_words int")
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert rows(phrase_matches(odd_docs, items)) == brute(docs, own)
    assert rows(phrase_matches(odd_docs, items.where("false"))) == brute(docs, [])
    assert phrase_matches(no_docs, items).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b y c"), (2, "c b a"), (3, "a " + "z " * 30 + "b c"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, "a b c")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in proximity_matches(docs, items, slop=4).collect()} == {(1, "9"), (2, "9")}


def test_columns_of_any_name_come_back(spark):
    docs = spark.createDataFrame([(1, "one two three", 5, "x", "y", "z")], "doc_id long, text string, d long, k string, own string, hits string")
    items = spark.createDataFrame([("i", "two three")], "item_id string, text string")
    assert [tuple(r) for r in phrase_matches(docs, items).collect()] == [(1, "one two three", 5, "x", "y", "z", 3, 2, 1, ["i"], True)]
