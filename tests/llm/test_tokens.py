import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewell.llm import packing, tokens
from tidewell.llm.queries import op7_packing, op10_token_files, tokenizer_path

from .conftest import SF

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def library(path):
    t = Tokenizer.from_file(path)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, np.uint32).tobytes())


def ids_of(enc, texts):
    """Each text's ids as a list."""
    ids, starts = enc.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]


LIBRARY = {path: library(path) for path in (BYTE, WORD)}
MARKED = st.text(st.sampled_from("ab É́ᄀİǅ\n\t\r\x1c\x85\xa0\u3000'st.,1²漢<|>\x00"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(MARKED, st.text(st.characters(exclude_categories=["Cs"]), max_size=20)), max_size=4))
def test_segments_give_the_library_ids(texts):
    for path, keeps in ((BYTE, True), (WORD, False)):
        assert ids_of(tokens.encoder(path, keeps), texts) == [LIBRARY[path](t)[:-1] for t in texts]


def test_letters_whose_case_is_odd():
    texts = ["İstanbul Iıİ", "ǅ ŉ ﬁ ẞ Σς", "plain words, then\nlines.\n\nEnd \n x", None, ""]
    for path, keeps in ((BYTE, True), (WORD, False)):
        assert ids_of(tokens.encoder(path, keeps), texts) == [LIBRARY[path](t)[:-1] for t in texts]


def test_reading_is_spread(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('word ', 50) as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1b")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2k")
    try:
        out = tokens.token_binary(docs, BYTE, 64)
        assert out.rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def check_files(docs, out):
    encode = library(BYTE)
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for doc, text in rows:
        ids = encode(text)
        want.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == want


def test_token_files(spark, odd_docs, no_docs):
    check_files(spark.read.parquet(f"{SF}/documents.parquet"), op10_token_files(spark, SF))
    check_files(odd_docs, tokens.token_binary(odd_docs, BYTE, 64))
    assert tokens.token_binary(no_docs, BYTE).count() == 0


def check_packing(docs, out, capacity):
    encode = library(WORD)
    want = []
    for r in docs.collect():
        ids = encode(r["text"])
        want += [(r["doc_id"] or 0, k, at, len(ids[at : at + capacity]), crc(ids[at : at + capacity])) for k, at in enumerate(range(0, len(ids), capacity))]
    got = out.collect()
    assert sorted((r["doc_id"] or 0, *r[1:5]) for r in got) == sorted(want)
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(filled), -(-sum(w[3] for w in want) // capacity)


def test_packing(spark, odd_docs, no_docs):
    used, bound = check_packing(spark.read.parquet(f"{SF}/documents.parquet"), op7_packing(spark, SF), 2048)
    assert used <= 1.02 * bound + 1
    check_packing(odd_docs, packing.best_fit_packing(odd_docs, WORD, 32), 32)
    assert packing.best_fit_packing(no_docs, WORD).count() == 0


def optimum(items, capacity):
    best = len(items)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= items[i]:
                rest = list(rooms)
                rest.remove(room)
                put(i + 1, [*rest, room - items[i]])
        put(i + 1, [*rooms, capacity - items[i]])

    put(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_reduction_keeps_an_optimum(items):
    counts = {x: items.count(x) for x in set(items)}
    p = packing.Plan(counts, 20)
    p.reduce()
    left = [x for x, n in p.left.items() for _ in range(n)]
    assert p.sequences + optimum(sorted(left, reverse=True), 20) == optimum(sorted(items, reverse=True), 20)
    assert sum(n for _, _, n, _, _ in packing.plan(counts, 20).rules) == len(items)
