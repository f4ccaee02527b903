"""Rearranged texts against a plain version, and their way back."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.llm import fill_middle


def brute(doc_id, text, rate=100, suffix_first=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return text, "plain", len(lines), None, None
    if h[3] % 100 < suffix_first:
        return f"<S>{s}<P>{p}<M>{m}", "spm", len(lines), len(p), len(m)
    return f"<P>{p}<S>{s}<M>{m}", "psm", len(lines), len(p), len(m)


ODD = ["<P>", "a<S>b\n", "x<\nM>y", "<P\n>", "ends in <", "ends in <P", "P>\nstarts", "\n\n\n", "\r\n é\n\U0001f600 \n", "no end\nof line", "<<M>"]


def test_all_rows(spark, odd_docs):
    docs = odd_docs.unionByName(spark.createDataFrame([(100 + i, t, None, None, None, "c") for i, t in enumerate(ODD * 5)] + [(None, "a\nb", None, None, None, None)] * 2, odd_docs.schema))
    docs = docs.withColumn("n", F.lit("clash"))
    got = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored(F.col("fim_text"), F.col("fim_form"))).collect()
    assert len(got) == docs.count() and {r["fim_form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r["fim_text"], r["fim_form"], r["n"], r["prefix_chars"], r["middle_chars"]) == brute(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["n_words"] or "") for r in got) == sorted((r["doc_id"] or 0, r["text"] or "", r["n_words"] or "") for r in docs.collect())


def test_rates(spark, odd_docs):
    got = fill_middle.fill_in_middle(odd_docs, rate=40, suffix_first=100).collect()
    assert all((r["fim_text"], r["fim_form"], r["n"], r["prefix_chars"], r["middle_chars"]) == brute(r["doc_id"], r["text"], 40, 100) for r in got)
    assert {r["fim_form"] for r in got} == {"plain", "spm"}


def test_empty(no_docs):
    assert fill_middle.fill_in_middle(no_docs).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab<PSM>\né\U0001f600", max_size=30), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), min_size=1, max_size=8))
def test_kernel(rows):
    encoded = [t.encode() for t, _, _ in rows]
    offsets = np.cumsum([0, *map(len, encoded)])
    n, marked, cuts, first, middle = fill_middle.kernel(offsets, np.frombuffer(b"".join(encoded), np.uint8), np.array([r[1:] for r in rows], np.uint32))
    for i, (t, x, y) in enumerate(rows):
        lines = re.findall(r"[^\n]*\n|[^\n]+", t)
        a, b = sorted((x % (len(lines) + 1), y % (len(lines) + 1)))
        assert (n[i], bool(marked[i]), first[i], middle[i]) == (len(lines), bool(re.search("<[PSM]>", t)), len("".join(lines[:a])), len("".join(lines[a:b])))
        assert (cuts[i] - offsets[i]).tolist() == [len("".join(lines[:k]).encode()) for k in (a, b)]
