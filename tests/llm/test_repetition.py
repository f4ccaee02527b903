import re
from collections import Counter

from tidewell.llm.queries import op1_quality_rules
from tidewell.llm.repetition import quality_rules, repetition

from .conftest import SF


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def check(docs, out):
    got = sorted((r["doc_id"] or 0, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out.collect())
    assert got == sorted((r["doc_id"] or 0, *brute(r["text"])) for r in docs.collect())


def test_query_against_brute_force(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"), op1_quality_rules(spark, SF))


def test_hard_cases(odd_docs, no_docs):
    check(odd_docs, quality_rules(odd_docs))
    assert quality_rules(no_docs).count() == 0


def test_verdicts(spark):
    block = " ".join(f"w{i}" for i in range(70))
    other = " ".join(f"v{i}" for i in range(600))
    rows = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame([(1, f"{block} {other} {block}"), (2, other), (3, block + " " + block)], "doc_id long, text string")).collect()}
    assert not rows[1]["base_failed"] and not rows[1]["kept"] and rows[1]["longest_repeat"] == 70
    assert rows[2]["kept"] and rows[3]["base_failed"] and not rows[3]["kept"]
    spans = repetition(spark.createDataFrame([(1, f"{block} {other} {block}")], "doc_id long, text string")).first()["repeat_spans"]
    assert [tuple(s) for s in spans] == [(0, 70), (670, 740)]
