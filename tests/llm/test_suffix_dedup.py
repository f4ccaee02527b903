import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm.queries import op2_suffix_dedup
from tidewell.llm.suffix_dedup import repeated_windows, rolled, suffix_dedup

from .conftest import SF, words


def brute(rows, width):
    seen = Counter(data[i : i + width] for _, data in rows for i in range(len(data) - width + 1))
    out = []
    for doc, data in rows:
        hit = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - width + 1):
            if seen[data[i : i + width]] > 1:
                hit[i : i + width] = True
        hit = hit[:-1]
        rest = bytes(b for b, h in zip(data, hit, strict=True) if not h)
        out.append((doc, len(data), int(hit.sum()), int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def pairs(df):
    return [(r["doc_id"] or 0, (r["text"] or "").encode()) for r in df.collect()]


def figures(df):
    return sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = figures(op2_suffix_dedup(spark, SF))
    assert got == brute(pairs(docs), 400) and any(r[2] for r in got)


def test_edges_overlaps_and_hot_passages(spark):
    r = random.Random(4)
    passage, other = words(70, 5), words(90, 6)
    texts = [passage[:n] for n in (39, 40, 41, 60)]
    for k in range(40):
        cut = r.randrange(len(passage) - 45)
        texts.append(words(30, 100 + k) + passage[cut : cut + 41 + k] + words(20, 200 + k))
        texts.append(words(5, 300 + k) + " " + other + " " + words(9, 400 + k))
    texts += ["ab" * 300, "é" * 90, words(30, 7) + other[:39], "x" * 39, "x" * 40, "x" * 41]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute([(i, t.encode()) for i, t in enumerate(texts)], 40)
    assert figures(suffix_dedup(docs, 40)) == want
    for token_bytes in (2000, 300, 50):
        assert figures(suffix_dedup(docs, 40, token_bytes=token_bytes)) == want


def test_query_judges_bytes_not_words(spark, tmp_path):
    passages = [words(200, 8)[:399], words(200, 9)[:400]]
    texts = [f"{words(60, 20 + k)}{'<>'[k % 2]}{passages[k // 2]}{'|/'[k % 2]}{words(60, 30 + k)}" for k in range(4)]
    assert all(len(p.split()) > 50 for p in passages)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r[2] for r in figures(op2_suffix_dedup(spark, str(tmp_path)))] == [0, 0, 400, 400]


def test_query_gives_the_text_that_is_left(spark, tmp_path):
    short, long, once = words(200, 8)[:399], words(200, 9)[:400], words(300, 10)
    # é and © end in one byte, with which the repeated string begins.
    texts = [f"<{short}|{long}>", f"[{long}#{short}]", once, None, "", words(300, 11), words(300, 11), "1é" + words(200, 12)[:399], "2©" + words(200, 12)[:399]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(op2_suffix_dedup(spark, str(tmp_path)).collect())
    assert [r["text"] for r in got] == [f"<{short}|>", f"[#{short}]", once, None, "", "", "", "1", "2"]
    for r, cut in zip(got, [b""] * 7 + [b"\xc3", b"\xc2"], strict=True):
        rest = (r["text"] or "").encode() + cut
        assert (r["n_bytes"] - r["n_removed"], r["kept_sha256"]) == (len(rest), hashlib.sha256(rest).hexdigest())


def test_hard_cases(odd_docs, no_docs):
    out = suffix_dedup(odd_docs)
    assert figures(out) == brute(pairs(odd_docs), 400)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and dict(out.dtypes)["n_bytes"] == "bigint"
    assert suffix_dedup(no_docs).count() == 0


def test_columns_of_any_name_come_back(spark):
    docs = spark.createDataFrame([(1, "a" * 900, 5, "x", "y", "z"), (2, "b", 6, "u", "v", "w")], "doc_id long, text string, d long, k string, spans string, `a.b` string")
    got = sorted(tuple(r)[:6] for r in suffix_dedup(docs).collect())
    assert got == [(1, "", 5, "x", "y", "z"), (2, "b", 6, "u", "v", "w")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=7, max_size=40).map(lambda b: bytes(x % 2 for x in b)), st.integers(0, 1)), min_size=1, max_size=6))
def test_local_sort(parts):
    data, groups = [p for p, _ in parts], np.array([g for _, g in parts])
    part, window = repeated_windows(data, groups, np.array([len(p) - 6 for p in data]), 7)
    seen = Counter((g, p[i : i + 7]) for p, g in parts for i in range(len(p) - 6))
    want = [(k, i) for k, (p, g) in enumerate(parts) for i in range(len(p) - 6) if seen[g, p[i : i + 7]] > 1]
    assert list(zip(part.tolist(), window.tolist(), strict=True)) == want


@given(st.binary(max_size=60), st.integers(1, 40))
def test_rolled(data, width):
    got = rolled(np.frombuffer(data, np.uint8), width)
    subs = [data[i : i + width] for i in range(len(data) - width + 1)]
    assert len(got) == len(subs) and all((got[i] == got[j]) == (subs[i] == subs[j]) for i in range(len(subs)) for j in range(i))
