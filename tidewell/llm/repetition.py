"""Quality rules from suffix-array repetition (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.shared import slices, text_bytes

SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "
BATCH_BYTES = 1_500_000

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "longest_repeat long, repeat_spans array<struct<start:int,end:int>>"
)


def repeats(symbols: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring that starts there and also elsewhere.

    ``symbols`` must be made unique per document by the caller. Suffixes are sorted by prefix
    doubling; only suffixes that still share their rank are sorted again, so text without long
    repeats leaves after a few rounds. The rank arrays of all rounds then give each
    neighbouring pair's common prefix by descent from the widest round.
    """
    n = len(symbols)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    order = np.argsort(symbols, kind="stable")
    head = np.concatenate([[True], np.diff(symbols[order]) != 0])
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[n] = -1
    levels, k = [rank.copy()], 1
    alone = head & np.concatenate([head[1:], [True]])
    active = np.sort(order[~alone])
    while len(active):
        key = rank[active] * (n + 2) + rank[np.minimum(active + k, n)] + 1
        turn = np.argsort(key, kind="stable")
        active, key = active[turn], key[turn]
        old = rank[active]
        new_group = np.concatenate([[True], old[1:] != old[:-1]])
        new_head = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.arange(len(active))
        first = np.maximum.accumulate(np.where(new_group, at, 0))
        rank[active] = old + np.maximum.accumulate(np.where(new_head, at, 0)) - first
        k *= 2
        levels.append(rank.copy())
        active = active[~(new_head & np.concatenate([new_head[1:], [True]]))]
    place = np.empty(n, np.int64)
    place[rank[:n]] = np.arange(n)
    a, b = place[:-1], place[1:]
    pairs = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[pairs], b[pairs]
    common = np.zeros(len(a), np.int64)
    for level in reversed(range(len(levels))):
        r = levels[level]
        same = (r[np.minimum(a + common, n)] == r[np.minimum(b + common, n)]) & (b + common < n) & (a + common < n)
        common += same.astype(np.int64) << level
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def measure(texts: list[str | None], min_words: int) -> list[tuple]:
    """The repetition figures of each text, computed for the whole list at once."""
    words = [t.encode().split() if t else [] for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    flat = [w for ws in words for w in ws]
    codes = pd.factorize(np.array(flat, dtype=object))[0].astype(np.int64) if flat else np.zeros(0, np.int64)
    longest = repeats(doc * (len(flat) + 1) + codes)
    hits = np.flatnonzero(longest >= min_words)
    edges = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edges, hits, 1)
    np.add.at(edges, hits + longest[hits], -1)
    covered = np.cumsum(edges)[:-1] > 0
    n_covered = np.bincount(doc[covered], minlength=len(texts))
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, doc[hits], longest[hits])
    first = np.concatenate([[0], np.cumsum(counts)])
    out = []
    for i, text in enumerate(texts):
        text = text or ""
        spans = []
        if n_covered[i]:
            turns = np.flatnonzero(np.diff(np.concatenate([[0], covered[first[i] : first[i + 1]].astype(np.int8), [0]])))
            spans = [{"start": int(s), "end": int(e)} for s, e in zip(turns[::2], turns[1::2], strict=True)]
        lines = [x for x in text.encode().split(b"\n") if x.strip()]
        out.append(
            (
                int(counts[i]),
                len(text) - sum(text.count(c) for c in SPACES),
                sum(text.count(c) for c in SYMBOLS),
                len(lines) - len(set(lines)),
                int(n_covered[i]),
                int(top[i]),
                spans,
            )
        )
    return out


def repetition(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """Repeated substrings within each document, by a word-level suffix array.

    The longest-common-prefix intervals of at least ``min_words`` words are the maximal repeated
    substrings; their occurrences' spans are united. Gives ``doc_id``, ``n_words``, ``word_chars``,
    ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` (words in the union), ``longest_repeat`` (words of
    the longest repeated substring of that length or more, else 0) and ``repeat_spans`` (word offsets, end excluded).
    One narrow stage: no shuffle. Memory follows the longest single text.

    Null or empty text: zeros. Repeated rows: one result each. Empty table: no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_bytes, BATCH_BYTES):
            rows = measure(batch.column("text").to_pylist(), min_words)
            arrays = [batch.column("doc_id"), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(6))]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([r[6] for r in rows], kind)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def quality_rules(
    docs: DataFrame, min_words: int = 8, max_fraction: float = 0.3, max_longest: int = 64, base_words: int = 20, base_percent: int = 30
) -> DataFrame:
    """``repetition`` with verdicts.

    ``base_failed``: fewer than ``base_words`` words, or more than ``base_percent`` percent of them repeat.
    ``kept``: not base_failed, covered fraction at most ``max_fraction`` and longest repeat at most
    ``max_longest`` words. Null and empty texts fail the base rule.
    """
    base = (F.col("n_words") < base_words) | (100 * F.col("n_repeat_words") > base_percent * F.col("n_words"))
    return (
        repetition(docs, min_words)
        .withColumn("base_failed", base)
        .withColumn(
            "kept",
            ~F.col("base_failed") & (F.col("n_repeat_words") <= max_fraction * F.col("n_words")) & (F.col("longest_repeat") <= max_longest),
        )
    )
