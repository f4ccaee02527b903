import zlib

import numpy as np

from tidewell.llm import language
from tidewell.llm.queries import op6_language

SF01 = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = op6_language(spark, SF01).collect()
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def longest_match_phrases(text, sample):
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in sample:
            k += 1
        at += k
        n += 1
    return n


def test_phrases_against_brute_force():
    samples = {"a": "the cat sat on the mat and the dog ran", "b": "le chat est sur la table et le chien"}
    model = language.Model(samples)
    texts = ["the chat sat et the dog", "zzz qq", "le mat", "t"]
    codes = [language.letters(t, model.place) for t in texts]
    got = language.phrases(codes, model.table, model.roots)
    flat = ["".join(chr(65 + c) for c in x) for x in codes]
    want = [[longest_match_phrases(t, "".join(chr(65 + c) for c in language.letters(samples[x], model.place))) for x in "ab"] for t in flat]
    assert got.tolist() == want


def test_hard_cases(odd_docs, no_docs):
    model = language.Model({"en": "hello there", "fr": "bonjour"})
    rows = {(r["doc_id"], r["lang_pred"]) for r in language.identify(odd_docs, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= rows and language.identify(no_docs, model).count() == 0
    assert language.Model({}).predict(["abc", None])[0] == ["und", "und"]
    assert language.learn(no_docs).names == []
