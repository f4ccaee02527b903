"""Small documents with the hard cases: nulls, empties, ties, repeats, long texts, clashing columns."""

import random

import pytest

SF = "/root/testdata/sf0.001"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(1 + k % 7)) for k in (r.randrange(vocabulary) for _ in range(n)))


@pytest.fixture(scope="session")
def odd_docs(spark):
    base = words(300, 1)
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, base), (5, base), (6, base + " tail"), (7, words(5000, 2)), (7, words(5000, 2)),
        (8, "x"), (9, "é" * 900), (10, "é" * 450 + "a" + "é" * 450), (11, base.upper()), (12, "line one\nline one\nline two\n\nline one"),
        (13, words(200, 3) + "\x00  \U0001f600  " + base[:450]), (14, "a " * 700), (15, "ab\r\ncd  ef gh <|endoftext|> it's"),
    ]
    rows = [(i, t, "en", "src", 0, "clash") for i, t in rows] + [(None, base, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
