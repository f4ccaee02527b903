"""Removal of long repeated substrings by partitioned suffix sorting (operator 2)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidewell.llm.near_dedup import mixed
from tidewell.llm.shared import dealt, forget, slices, text_bytes, written

LEAD = 32
BATCH_BYTES = 1 << 20
#: Bytes of segments that a bucket sorts at a time, unless one leading token has more.
BUCKET_BYTES = 1 << 20
#: Bytes of segments of one leading token that one bucket takes; beyond, the token is made longer.
TOKEN_BYTES = 4 << 20
#: Low bits that hold a place while anchors are chosen; portions of text are shorter than two to that power.
PLACE = np.uint64(24)
#: Parts into which the windows of a segment are cut when its leading token is made longer.
CUTS = 4
STEPS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
#: Bytes that one character of the local multikey sort stands for.
CHARACTER = 80


def rolled(data: np.ndarray, width: int, step: np.uint64 = STEPS[0]) -> np.ndarray:
    """A 64-bit fingerprint of every ``width``-byte substring, built by doubling."""
    part, size, power = data.astype(np.uint64) + np.uint64(1), 1, np.array([step])
    whole, done = None, 0
    while True:
        if width & size:
            if whole is None:
                whole = part
            else:
                m = min(len(whole), len(part) - done)
                whole = whole[: max(m, 0)] * power + part[done : done + max(m, 0)]
            done += size
        size *= 2
        if size > width:
            break
        half = size // 2
        m = max(len(part) - half, 0)
        part, power = part[:m] * power + part[half:], power * power
    return mixed(whole[: max(len(data) - width + 1, 0)])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    m = len(x) - width + 1
    if m <= 0:
        return x[:0]
    blocks = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    after = np.minimum.accumulate(blocks, axis=1).ravel()
    before = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(before[:m], after[width - 1 : width - 1 + m])


def anchors(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows by anchor: the substring of ``LEAD`` bytes that is least, by hash, in the window.

    ``data``: several documents' bytes, ``ends`` each byte's end of document. Equal windows have equal anchors at equal
    places. Returns each run's anchor position, its fingerprint, its first window and its number of windows.
    """
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, np.zeros(0, np.uint64), none, none
    grams = rolled(data, LEAD)
    at = np.arange(len(grams), dtype=np.uint64)
    low = sliding_min((grams >> PLACE << PLACE) | at, width - LEAD + 1)
    owner = (low & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(ends[: len(owner)] - np.arange(len(owner)) >= width)
    if not len(first):
        return none, np.zeros(0, np.uint64), none, none
    own = owner[first]
    heads = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (np.diff(first) != 1)]))
    counts = np.diff(np.concatenate([heads, [len(first)]]))
    return own[heads], grams[own[heads]], first[heads], counts


def documents(batch: pa.RecordBatch, width: int) -> Iterator[tuple[list[int], list[bytes], list[int]]]:
    """Row numbers, bytes and byte offsets of the batch's texts, in portions; a long text comes in overlapping parts."""
    rows, parts, offsets, total = [], [], [], 0
    for i, text in enumerate(batch.column("text").to_pylist()):
        data = (text or "").encode()
        for at in range(0, max(len(data) - width + 1, 0), BATCH_BYTES):
            part = data[at : at + BATCH_BYTES + width - 1]
            rows.append(i)
            parts.append(part)
            offsets.append(at)
            total += len(part)
            if total >= BATCH_BYTES:
                yield rows, parts, offsets
                rows, parts, offsets, total = [], [], [], 0
    if rows:
        yield rows, parts, offsets


def keyed(docs: DataFrame) -> DataFrame:
    """``row`` (the columns but text), ``text`` and ``d, k``: doc_id (0 for null) and a hash of the row's id and text, which together name a row's content."""
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    text = F.col("text").cast("string")
    return docs.select(others.alias("row"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.xxhash64("doc_id", text).alias("k"))


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def anchor_rows(docs: DataFrame, width: int) -> DataFrame:
    """``d, k, g, lo, n, off, same``: each run of windows of each text with its anchor's fingerprint.

    ``off`` is the anchor's place in the run's first window, ``same`` a digest of the run's bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_bytes, BATCH_BYTES):
            d, k = (batch.column(c).to_numpy() for c in ("d", "k"))
            for rows, parts, offsets in documents(batch, width):
                sizes = np.array([len(p) for p in parts])
                stops = np.cumsum(sizes)
                flat = b"".join(parts)
                at, gram, first, count = anchors(np.frombuffer(flat, np.uint8), np.repeat(stops, sizes), width)
                part = np.searchsorted(stops, first, "right")
                row = np.array(rows)[part]
                lo = first - (stops - sizes)[part] + np.array(offsets)[part]
                same = [digest(flat[a:b]) for a, b in zip(first.tolist(), (first + count + (width - 1)).tolist(), strict=True)]
                arrays = [pa.array(x, t) for x, t in zip((d[row], k[row], gram.view(np.int64), lo, count, at - first, same), RUN_TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["d", "k", "g", "lo", "n", "off", "same"])

    return keyed(docs).select("d", "k", "text").mapInArrow(run, "d long, k long, g long, lo long, n int, off int, same binary")


RUN_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def segments(docs: DataFrame, picked: DataFrame, width: int) -> DataFrame:
    """``d, k, g, lo, n, once, longer, same, bytes``: the bytes of the picked runs (g, d, k, lo, n, off, once, longer), a bounded portion of them at a time.

    A run that is ``longer`` is cut into parts, and ``g`` also covers what all windows of a part have in common: the bytes
    around the anchor that the part's first and last possible window share. Windows can only be equal if these are.
    """
    most = width - LEAD
    step = -(-(most + 1) // CUTS)
    runs = picked.groupBy("d", "k").agg(F.collect_list(F.struct("g", "lo", "n", "off", "once", "longer")).alias("runs"))
    rows = keyed(docs).select("d", "k", "text").join(dealt(runs), ["d", "k"])

    def parts(data: bytes, r: dict) -> Iterator[tuple]:
        if not r["longer"]:
            yield r["g"], r["lo"], r["n"]
            return
        at = r["lo"] + r["off"]
        for cut in range(CUTS):
            low, high = cut * step, min((cut + 1) * step - 1, most)
            # Windows of the run whose anchor lies low to high bytes after their start.
            a, b = max(r["lo"], at - high), min(r["lo"] + r["n"] - 1, at - low)
            if a <= b:
                core = data[at - low : at + width - high]
                yield int.from_bytes(digest(b"%d %d " % (r["g"], cut) + core)[:8], "little", signed=True), a, b - a + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_bytes, BATCH_BYTES):
            out, size = [], 0
            for d, k, text, runs in zip(*(batch.column(c).to_pylist() for c in ("d", "k", "text", "runs")), strict=True):
                data = text.encode()
                for r in runs:
                    for g, lo, n in parts(data, r):
                        part = data[lo : lo + n + width - 1]
                        out.append((d, k, g, lo, n, r["once"], r["longer"], digest(part), part))
                        size += len(part)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), SEGMENT_TYPES, strict=True)], SEGMENT_NAMES)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), SEGMENT_TYPES, strict=True)], SEGMENT_NAMES)

    return rows.mapInArrow(run, "d long, k long, g long, lo long, n int, once boolean, longer boolean, same binary, bytes binary")


SEGMENT_NAMES = ["d", "k", "g", "lo", "n", "once", "longer", "same", "bytes"]
SEGMENT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary()]


def segment_bytes(batch: pa.RecordBatch) -> list[int]:
    return pc.binary_length(batch.column("bytes")).to_pylist()


def multikey(keys: list[Callable[[np.ndarray], np.ndarray]], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey sort: one character at a time within the groups of equal characters so far; singletons leave.

    ``keys`` gives a character of the items asked for, so that it is only made of those still together. Returns the numbers of the items that equal another in ``group`` and all keys, and their group numbers.
    """
    items = np.arange(len(group), dtype=np.int32 if len(group) < 2**31 else np.int64)
    for key in [None, *keys]:
        if not len(items):
            break
        if key is None:
            order = np.argsort(group, kind="stable")
            same = group[order][1:] == group[order][:-1]
        else:
            own = key(items)
            order = np.argsort(own, kind="stable")
            order = order[np.argsort(group[order], kind="stable")]
            own = own[order]
            same = (own[1:] == own[:-1]) & (group[order][1:] == group[order][:-1])
        items, head = items[order], np.concatenate([[True], ~same])
        group = np.cumsum(head)
        keep = ~(head & np.concatenate([head[1:], [True]]))
        items, group = items[keep], group[keep]
    return items, group


def repeated_windows(parts: list[bytes], groups: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of each part also occur in another part of its group, as (part, window) numbers.

    The suffixes that start a window are sorted by multikey sort on characters of ``CHARACTER`` bytes, taken as
    fingerprints; suffixes left equal are compared byte by byte.
    """
    sizes = np.array([len(p) for p in parts])
    base = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(parts), np.uint8)
    small = np.int32 if len(data) < 2**31 else np.int64
    part = np.repeat(np.arange(len(parts), dtype=small), counts)
    window = np.arange(len(part), dtype=small) - np.repeat((np.cumsum(counts) - counts).astype(small), counts)
    at = base.astype(small)[part] + window
    keys = []
    for k in range(0, width, CHARACTER):
        step = min(CHARACTER, width - k)
        if step != CHARACTER or not k:
            prints = rolled(data, step)
        keys.append(lambda items, prints=prints, k=k: prints[at[items] + k])
    items, group = multikey(keys, groups[part])
    ok = np.ones(len(items), bool)
    views = np.lib.stride_tricks.sliding_window_view(data, width) if len(items) else None
    if len(items):
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        first = np.repeat(items[heads], np.diff(np.concatenate([heads, [len(items)]])))
        for k in range(0, len(items), 4096):
            ok[k : k + 4096] = (views[at[items[k : k + 4096]]] == views[at[first[k : k + 4096]]]).all(axis=1)
        for g in np.unique(group[~ok]):
            members = np.flatnonzero(group == g)
            texts = [views[at[items[m]]].tobytes() for m in members]
            ok[members] = [texts.count(t) > 1 for t in texts]
    items = np.sort(items[ok])
    return part[items], window[items]


def spans_in_buckets(rows: DataFrame, width: int) -> DataFrame:
    """``d, k, start, end`` of repeated windows of segments (with ``once``: no equal segment elsewhere).

    Suffixes are dealt to buckets by range: Spark samples splitters of the leading token ``g``, and all suffixes with one
    leading token are in one bucket, so that a boundary never parts a suffix from an equal one and a comparison across
    boundaries finds nothing. Buckets are sorted locally, in portions of whole groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0

        def close(rows: list[dict]) -> pa.RecordBatch:
            counts = np.array([r["n"] for r in rows], np.int64)
            _, groups = np.unique(np.array([r["g"] for r in rows], np.int64), return_inverse=True)
            part, window = repeated_windows([r["bytes"] for r in rows], groups, counts, width)
            heads = np.flatnonzero(np.concatenate([[True], (np.diff(part) != 0) | (np.diff(window) != 1)])) if len(part) else []
            stops = np.concatenate([heads[1:], [len(part)]]).astype(np.int64) - 1 if len(part) else []
            out = []
            for a, b in zip(heads, stops, strict=True):
                r = rows[part[a]]
                if r["once"]:
                    out.append((r["d"], r["k"], r["lo"] + int(window[a]), r["lo"] + int(window[b]) + width))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], ["d", "k", "start", "end"])

        for batch in slices(batches, segment_bytes, BATCH_BYTES):
            for r in batch.to_pylist():
                if held and size >= BUCKET_BYTES and r["g"] != held[-1]["g"]:
                    yield close(held)
                    held, size = [], 0
                held.append(r)
                size += len(r["bytes"])
        if held:
            yield close(held)

    placed = rows.repartitionByRange("g").sortWithinPartitions("g")
    return placed.select("d", "k", "g", "lo", "n", "once", "bytes").mapInArrow(run, "d long, k long, start long, end long")


def spans_by_count(rows: DataFrame, width: int) -> DataFrame:
    """As ``spans_in_buckets``, for leading tokens with too many segments for one bucket.

    Each window becomes a row with a 128-bit fingerprint, and fingerprints are counted with map-side sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, segment_bytes, BATCH_BYTES):
            counts = batch.column("n").to_numpy().astype(np.int64)
            parts = batch.column("bytes").to_pylist()
            sizes = np.array([len(p) for p in parts])
            data = np.frombuffer(b"".join(parts), np.uint8)
            row = np.repeat(np.arange(len(parts)), counts)
            window = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            at = (np.cumsum(sizes) - sizes)[row] + window
            prints = [pa.array(rolled(data, width, s)[at].view(np.int64)) for s in STEPS]
            d, k, lo, once = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("d", "k", "lo", "once"))
            yield pa.RecordBatch.from_arrays([*prints, pa.array(d), pa.array(k), pa.array(lo + window), pa.array(once)], ["p", "q", "d", "k", "start", "once"])

    windows = written(rows.select("d", "k", "lo", "n", "once", "bytes").mapInArrow(run, "p long, q long, d long, k long, start long, once boolean"))
    twice = windows.groupBy("p", "q").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    return windows.where("once").join(twice, ["p", "q"], "left_semi").select("d", "k", "start", (F.col("start") + width).alias("end"))


def told_apart(rows: DataFrame, first: list[str], width: int) -> tuple[DataFrame, DataFrame]:
    """Equal segments of ``rows``, and one each of those that must be sorted.

    ``rows`` has g, same, n, once and the columns ``first``, which name a segment. Gives ``g, same`` of segments that occur twice, and
    one row per segment of those leading tokens that have several different ones and one that occurs once: ``once`` (it does, and must be judged) and ``size``, the bytes of all of its token.
    """
    kinds = written(rows.groupBy("g", "same", "n").agg(F.count("*").alias("c"), F.max("once").alias("judge"), F.min(F.struct(*first)).alias("one")))
    groups = kinds.groupBy("g").agg(F.count("*").alias("m"), F.max((F.col("c") == 1) & F.col("judge")).alias("open"), F.sum(F.col("n") + (width - 1)).alias("size")).where("m > 1 and open")
    picked = kinds.join(dealt(written(groups.select("g", "size"))), "g")
    return kinds.where("c > 1").select("g", "same"), picked.select("g", "same", "n", ((F.col("c") == 1) & F.col("judge")).alias("once"), "one.*", "size")


def spans_of(rows: DataFrame, width: int) -> DataFrame:
    return rows.select("d", "k", F.col("lo").alias("start"), (F.col("lo") + F.col("n") + (width - 1)).alias("end"))


def repeated_spans(docs: DataFrame, width: int, token_bytes: int = TOKEN_BYTES) -> DataFrame:
    """``d, k, start, end``: byte spans whose every byte lies in a ``width``-byte string that starts twice.

    Suffixes are thinned without loss first. Every window belongs to its anchor; a window can only repeat if its
    anchor occurs twice, and windows of one anchor of one text travel as one segment. Equal segments
    are all repeated and need no sorting; of the others one each goes to the sort. A leading token with
    more than ``token_bytes`` of different segments is made longer: its segments are cut in ``CUTS`` parts, whose tokens cover most
    of the window, and what is equal leaves again. Windows of a token that is still too frequent then, with nearly all their bytes
    in common, are counted one by one, with map-side sums.
    """
    runs = written(anchor_rows(docs, width))
    # Both sides of each join are written tables, so that adaptive execution can split a token that very many runs have.
    twice = written(runs.groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g"))
    again = written(runs.join(dealt(twice), "g").withColumn("once", F.lit(True)))
    forget(runs)
    forget(twice)
    equal, picked = told_apart(again, ["d", "k", "lo", "off"], width)
    whole = spans_of(again.join(dealt(equal), ["g", "same"]), width)
    # All texts meet their runs once, whatever becomes of a run.
    every = written(segments(docs, picked.withColumn("longer", F.col("size") > token_bytes), width))
    few = spans_in_buckets(every.where("not longer"), width)
    parts = every.where("longer").drop("longer")
    if parts.isEmpty():
        return whole.unionByName(few)
    equal, picked = told_apart(parts.drop("bytes"), ["d", "k", "lo"], width)
    rows = written(parts.drop("once", "n").join(dealt(written(picked)), ["g", "same", "d", "k", "lo"]))
    whole = whole.unionByName(spans_of(parts.drop("bytes").where("once").join(dealt(equal), ["g", "same"]), width))
    cut = spans_in_buckets(rows.where(F.col("size") <= token_bytes), width)
    return whole.unionByName(few).unionByName(cut).unionByName(spans_by_count(rows.where(F.col("size") > token_bytes), width))


def suffix_dedup(docs: DataFrame, width: int = 400, token_bytes: int = TOKEN_BYTES) -> DataFrame:
    """``docs`` without the bytes covered by a ``width``-byte string that also starts elsewhere in any row.

    All occurrences go, also overlapping ones; strings are judged on the input and don't cross rows. ``text`` is what
    is left (a character cut apart is dropped; null stays null) and these columns are added, replacing any of the
    same name: ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256`` (of the remaining
    bytes, before cut characters are dropped). All other columns, whatever their names, come back as they were.
    Repeated rows are each other's repeats. A text of any length is read in portions. Empty table: no rows.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    base = docs.drop(*added)
    spans = repeated_spans(base, width, token_bytes).groupBy("d", "k").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    rows = keyed(base).join(dealt(spans), ["d", "k"], "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_bytes, 8 * BATCH_BYTES):
            texts, figures = [], []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = (text or "").encode()
                left, at, runs = [], 0, 0
                stop = -1
                for c in cuts or ():
                    if c["start"] > stop:
                        runs += 1
                        left.append(data[max(at, 0) : c["start"]])
                    stop = max(stop, c["end"])
                    at = stop
                left.append(data[at:])
                rest = b"".join(left)
                texts.append(None if text is None else text if not cuts else rest.decode(errors="ignore"))
                figures.append((len(data), len(data) - len(rest), runs, hashlib.sha256(rest).hexdigest()))
            new = [pa.array([f[i] for f in figures], pa.string() if i == 3 else pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), *new], ["row", "text", *added])

    figures = [StructField(c, StringType() if c == "kept_sha256" else LongType()) for c in added]
    out = rows.mapInArrow(run, StructType([*rows.schema.fields[:2], *figures]))
    return out.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in base.columns), *added)
