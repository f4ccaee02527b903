"""Texts that hold an added token of the file get the ids that the library gives by default."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewell.llm import packing, tokens
from tidewell.llm.queries import tokenizer_path

from .test_tokens import ids_of

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def default_ids(path, text):
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path, keeps", [(BYTE, True), (WORD, False)])
def test_added_tokens(path, keeps):
    enc = tokens.Encoder(path, keeps)
    texts = ["one <|endoftext|> two", "a<|startoftext|>b", "<|ENDOFTEXT|> x", "<|endoftext|>", "plain", "<|endof text|>"]
    got = ids_of(enc, texts)
    assert got == [default_ids(path, t) for t in texts]
    assert got[0] == ([505, 220, 50256, 734] if keeps else [637, 49407, 1237])


LIBRARY = {path: Tokenizer.from_file(path) for path in (BYTE, WORD)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", " ", "\n", "a", "É", "<|", "it's", ".", "1"]), max_size=8).map("".join))
def test_mixed_with_other_text(text):
    for path, keeps in ((BYTE, True), (WORD, False)):
        enc = tokens.encoder(path, keeps)
        assert ids_of(enc, [text]) == [LIBRARY[path].encode(text, add_special_tokens=False).ids]


def test_operators(spark):
    docs = spark.createDataFrame([(1, "one <|endoftext|> two"), (2, "three")], "doc_id long, text string")
    starts = {r["doc_id"]: (r["start"], r["n_tokens"]) for r in tokens.token_binary(docs, BYTE, 64).collect()}
    n = len(default_ids(BYTE, "one <|endoftext|> two")) + 1
    assert starts == {1: (0, n), 2: (n, len(default_ids(BYTE, "three")) + 1)}
    lengths = {r["doc_id"]: r["length"] for r in packing.best_fit_packing(docs, WORD).collect()}
    assert lengths == {1: 4, 2: len(default_ids(WORD, "three")) + 1}
