"""Token ids by a public tokenizer, and the Arrow token files (operator 10)."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.shared import file_system, shared_folder, slices, text_bytes, written

CACHED = 500_000
BATCH_BYTES = 6_000_000
#: White space but blanks and line feeds, and U+001C to U+001F, which Python takes for white space and the tokenizers don't.
RARE_SPACE = "\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
OTHER_SPACE = re.compile("[\x1c-\x1f]")
SPACE_IN_RUN = re.compile(r"\s \s|  ")
SPACE_AT_LINE = re.compile(r"\s\n|\n\s|\n\Z")
#: The same of texts without rare white space, as Arrow's expressions know them.
PLAIN_AT_LINE = r"[ \n]\n|\n |\n\z"
MARKS = ",.;:!?"
#: An optional blank and letters whose lower case is beyond doubt; all others go through the library's own normaliser.
LETTERS = re.compile(" ?[A-Za-z]+")
#: How byte-level vocabularies show a blank; ASCII letters are shown as they are.
SHOWN_BLANK = "\u0120"


class Encoder:
    """Ids of texts by a ``tokenizers`` file, with a memory of the segments already encoded.

    Neither tokenizer kind merges across the start of a blank-separated segment, so a text's ids are its
    segments' ids in turn. ``keeps_space``: a byte-level tokenizer, whose segments keep the leading blank.
    Texts in which white space runs make that unsure go to the library whole, as do those that hold one of the file's
    added tokens (``<|endoftext|>``), which the library finds before it splits. Arrow cuts texts and numbers their distinct
    segments; only segments that are new become Python strings one by one. A new segment that ends in a letter
    and a mark is put together from its stem and the mark, as letters and marks never share a token.
    """

    def __init__(self, path: str, keeps_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = sorted((re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        #: Whatever the case: a file may have tokens that are looked for in the lowered text.
        self.added = re.compile("|".join(added) or r"(?!)", re.IGNORECASE)
        unsure = [f"[{RARE_SPACE}]", *(["\0", "  ", "\n \n"] if keeps_space else []), *(f"(?i:{x})" for x in added)]
        self.unsure = "|".join(unsure)
        #: Ids are held in 2 bytes where the vocabulary allows it.
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.keeps_space = keeps_space
        self.basic = dict(zip(MARKS, self.whole(list(MARKS)), strict=True)) | {"": b""}
        self.known: dict[str, bytes] = dict(self.basic)
        self.recent: list[str] = []

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def word(self, segment: str) -> bytes:
        """Ids of a segment of letters: one token of the pre-tokenizer, so the model alone gives them."""
        shown = segment.replace(" ", SHOWN_BLANK) if self.keeps_space else segment.lower()
        return array(self.kind.char, [t.id for t in self.library.model.tokenize(shown)]).tobytes()

    def segments(self, text: str) -> list[str] | None:
        if OTHER_SPACE.search(text) or self.added.search(text):
            return None
        if not self.keeps_space:
            return text.split()
        if "\0" in text or SPACE_IN_RUN.search(text):
            return None
        if not SPACE_AT_LINE.search(text):
            text = text.replace("\n", "\0\n\0")
        return text.replace(" ", "\0 ").split("\0")

    def learn(self, new: set[str]) -> None:
        """Encode the segments that aren't known yet."""
        known, odd = self.known, []
        for x in new:
            stem, mark = (x[:-1], x[-1]) if x[-1:] in MARKS and x[-2:-1].isalpha() else (x, "")
            if not LETTERS.fullmatch(stem):
                odd.append(x)
                continue
            ids = known.get(stem) or self.word(stem)
            known[x] = ids + known[mark] if mark else ids
        known.update(zip(odd, self.whole(odd), strict=True))

    def each(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that Arrow can't cut, text by text."""
        parts = [self.segments(t) for t in texts]
        self.learn({x for p in parts for x in p or () if x not in self.known})
        whole = iter(self.whole([t for t, p in zip(texts, parts, strict=True) if p is None]))
        return [np.frombuffer(next(whole) if p is None else b"".join(map(self.known.__getitem__, p)), self.kind) for p in parts]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and where each text's begin (one place more than there are texts)."""
        if len(self.known) > CACHED:
            self.known = {w: self.known[w] for w in self.recent} | self.basic
        texts = texts.cast(pa.large_string()).fill_null("")
        unsure = pc.match_substring_regex(texts, self.unsure)
        plain = texts.filter(pc.invert(unsure))
        if self.keeps_space:
            plain = pc.if_else(pc.match_substring_regex(plain, PLAIN_AT_LINE), plain, pc.replace_substring(plain, "\n", "\0\n\0"))
            parts = pc.split_pattern(pc.replace_substring(plain, " ", "\0 "), "\0")
        else:
            parts = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
        segments = parts.flatten().dictionary_encode()
        words, codes = segments.dictionary.to_pylist(), segments.indices.to_numpy()
        self.learn({w for w in words if w not in self.known})
        own = [self.known[w] for w in words]
        self.recent = words
        pool = np.frombuffer(b"".join(own), self.kind)
        sizes = np.array([len(x) for x in own], np.int64) // self.kind.itemsize
        places = (np.cumsum(sizes) - sizes)[codes]
        n = sizes[codes]
        stops = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(places - stops[:-1], n) + np.arange(stops[-1])]
        offsets = parts.offsets.to_numpy()
        starts = stops[offsets - offsets[0]]
        odd = np.flatnonzero(unsure.to_numpy(zero_copy_only=False))
        if not len(odd):
            return ids, starts
        rows = np.empty(len(texts), object)
        rows[:] = [None] * len(texts)
        for i, x in zip(odd, self.each(texts.take(pa.array(odd)).to_pylist()), strict=True):
            rows[i] = x
        for i, a, b in zip(np.flatnonzero(~np.isin(np.arange(len(texts)), odd)), starts[:-1], starts[1:], strict=True):
            rows[i] = ids[a:b]
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])


ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, keeps_space: bool) -> Encoder:
    """This worker's encoder for a file: loading it takes longer than a task should."""
    key = path, keeps_space
    if key not in ENCODERS:
        ENCODERS[key] = Encoder(path, keeps_space)
    return ENCODERS[key]


def crc32(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def token_files(docs: DataFrame, tokenizer: str, folder: str, length: int = 2048) -> DataFrame:
    """Write every text's ids into Arrow files of equal-length sequences; returns the manifest.

    Documents are range-partitioned by ``doc_id`` (sampled splitters, so every shard has a like share)
    and sorted in each shard. A shard becomes two Arrow IPC files: ``*.tokens.arrow`` has record batches of
    ``ids fixed_size_list<uint16 or uint32>[length]`` (as the vocabulary needs) and ``mask fixed_size_list<bool>[length]`` (false: padding, in the
    shard's last sequence only), ``*.index.arrow`` has ``doc_id, start, n_tokens`` within the shard. Buffers are
    uncompressed and contiguous, so that a reader maps sequence ``i`` without copying. Each text ends with id 0.

    A file's name holds a fresh number per task attempt and only finished attempts' files reach the manifest
    (``shard, first_doc, n_tokens, n_docs, tokens, index``), so a lost executor costs a rewrite, no more. Null text:
    the end id alone. Equal doc_ids: one entry each, ties in the order of text. Empty table: no files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer, True), TaskContext.get().partitionId()
        fs, root = file_system(folder)
        row = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(enc.kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        name = f"{root}/{shard:06d}-{uuid.uuid4().hex}"
        sink = writer = None
        rest, doc_ids, counts = np.zeros(0, enc.kind), [], []

        def put(ids: np.ndarray, real: int) -> None:
            mask = np.zeros(len(ids), bool)
            mask[:real] = True
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (ids, mask)]
            writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=row))

        for batch in slices(batches, text_bytes, BATCH_BYTES):
            if sink is None:
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(f"{name}.tokens.arrow")
                writer = pa.ipc.new_file(sink, row)
            ids, starts = enc.encode(batch.column("text"))
            doc_ids += batch.column("doc_id").to_pylist()
            counts += (np.diff(starts) + 1).tolist()
            rest = np.concatenate([rest, np.insert(ids, starts[1:], 0)])
            if full := len(rest) // length * length:
                put(rest[:full], full)
                rest = rest[full:]
        if sink is None:
            return
        if len(rest):
            put(np.concatenate([rest, np.zeros(-len(rest) % length, enc.kind)]), len(rest))
        writer.close()
        sink.close()
        starts = np.concatenate([[0], np.cumsum(counts)])
        index = pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(starts[:-1], pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
        with fs.open_output_stream(f"{name}.index.arrow") as out, pa.ipc.new_file(out, index.schema) as w:
            w.write_table(index, max_chunksize=1 << 16)
        yield pa.RecordBatch.from_pydict(
            {"shard": [shard], "first_doc": [doc_ids[0]], "n_tokens": [int(starts[-1])], "n_docs": [len(doc_ids)], "tokens": [f"{name}.tokens.arrow"], "index": [f"{name}.index.arrow"]}
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(dealt.mapInArrow(run, "shard long, first_doc long, n_tokens long, n_docs long, tokens string, index string"))


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str, length: int = 2048) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files of ``token_files``.

    ``start`` counts the tokens of all documents before; shards' offsets are a running sum over the manifest,
    one row per shard. Files are memory-mapped where the file system allows it.
    """
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("first_doc", "shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        for batch in batches:
            for shard in batch.to_pylist():
                local = isinstance(fs, pa.fs.LocalFileSystem)
                with (pa.memory_map(shard["tokens"]) if local else fs.open_input_file(shard["tokens"])) as f, fs.open_input_file(shard["index"]) as g:
                    tokens, index = pa.ipc.open_file(f), pa.ipc.open_file(g)
                    parts = Sequences(tokens, length)
                    for k in range(index.num_record_batches):
                        part = index.get_batch(k)
                        starts, counts = (part.column(c).to_pylist() for c in ("start", "n_tokens"))
                        crc = [crc32(parts.ids(s, n)) for s, n in zip(starts, counts, strict=True)]
                        start = pa.array(np.array(starts, np.int64) + shard["before"], pa.int64())
                        yield pa.RecordBatch.from_arrays([part.column("doc_id"), start, part.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = manifest.select("tokens", "index", before.alias("before"))
    # A number of its own, so that a short list of files isn't gathered into one reading task.
    return placed.repartition(max(1, manifest.count()), "tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


class Sequences:
    """Random access to the ids of one token file; one batch's view is held at a time."""

    def __init__(self, reader: pa.ipc.RecordBatchFileReader, length: int):
        self.reader, self.length, self.at, self.view = reader, length, -1, None
        rows = [reader.get_batch(k).num_rows for k in range(reader.num_record_batches)]
        self.first = np.concatenate([[0], np.cumsum(rows)]) * length

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start`` on: a view of the mapped file unless they span two batches."""
        out = []
        while n:
            k = int(np.searchsorted(self.first, start, "right")) - 1
            if k != self.at:
                self.at, self.view = k, self.reader.get_batch(k).column("ids").flatten().to_numpy(zero_copy_only=True)
            at = start - int(self.first[k])
            got = self.view[at : at + n]
            out.append(got)
            start, n = start + len(got), n - len(got)
        return out[0] if len(out) == 1 else np.concatenate(out)


def token_binary(docs: DataFrame, tokenizer: str, length: int = 2048) -> DataFrame:
    """Write the token files into the shared folder and read every document back from them."""
    folder = shared_folder(docs.sparkSession)
    return read_token_files(docs.sparkSession, token_files(docs, tokenizer, folder, length), folder, length)
