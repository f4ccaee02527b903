"""Fill-in-the-middle rearrangement of whole texts (operator 12)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidewell.llm.shared import slices, text_bytes

BATCH_BYTES = 4 << 20
#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Classes of bytes.
NEWLINE, CHARACTER, OPEN, LETTER, CLOSE = 1, 2, 4, 8, 16
CLASSES = np.zeros(256, np.uint8)
CLASSES[[b for b in range(256) if b & 0xC0 != 0x80]] |= CHARACTER
CLASSES[ord("\n")] |= NEWLINE
CLASSES[ord("<")] |= OPEN
CLASSES[[ord("P"), ord("S"), ord("M")]] |= LETTER
CLASSES[ord(">")] |= CLOSE


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column without nulls, as numpy views of its Arrow buffers."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if offsets else np.zeros(len(texts) + 1, np.int64)
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return offsets - offsets[0], flat


def running(mask: np.ndarray) -> np.ndarray:
    """How often ``mask`` holds before each place, and in all."""
    out = np.zeros(len(mask) + 1, np.int32 if len(mask) < 2**31 else np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def kernel(offsets: np.ndarray, data: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines, cuts and their code points for all documents of a batch at once.

    ``draws`` has two numbers a document; modulo its lines plus one they give the lines before the two cuts. Returns the number of lines, whether a
    marker stands in the text, the byte at the first and second cut, and the code points before the first and between both.
    """
    kind, starts, stops = CLASSES[data], offsets[:-1], offsets[1:]
    # A line begins where a document does, and after each newline.
    begins = np.zeros(len(data), bool)
    begins[1:] = kind[:-1] & NEWLINE != 0
    begins[starts[stops > starts]] = True
    lines = running(begins)
    before = lines[starts]
    n = (lines[stops] - before).astype(np.int64)
    wanted = np.sort(draws % (n + 1)[:, None].astype(draws.dtype), axis=1).astype(np.int64)
    # The running count of lines, set back at each document's start, first passes a cut's number where the next line begins.
    cuts = np.searchsorted(lines[1:], (before[:, None] + wanted + 1).ravel().astype(lines.dtype)).reshape(-1, 2)
    cuts = np.minimum(np.maximum(cuts, starts[:, None]), stops[:, None])
    characters = running(kind & CHARACTER != 0)
    first = characters[cuts[:, 0]] - characters[starts]
    middle = characters[cuts[:, 1]] - characters[cuts[:, 0]]

    marked = np.zeros(len(n), bool)
    at = np.flatnonzero((kind[:-2] & OPEN != 0) & (kind[1:-1] & LETTER != 0) & (kind[2:] & CLOSE != 0)) if len(data) > 2 else np.zeros(0, np.int64)
    owner = np.searchsorted(offsets, at, "right") - 1
    marked[owner[at + 3 <= stops[owner]]] = True
    return n, marked, cuts, first.astype(np.int64), middle.astype(np.int64)


def drawn(doc_ids: list, seed: int) -> np.ndarray:
    """Four 32-bit numbers a document: the first digits of SHA-256 of the seed and the id (null: nothing)."""
    heads = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in doc_ids)
    return np.frombuffer(heads, ">u4").astype(np.uint32).reshape(-1, 4)


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, suffix_first: int = 50) -> DataFrame:
    """``docs`` with each text's lines rearranged for infilling.

    Of all documents ``rate`` per cent are rearranged, of these ``suffix_first`` per cent with the suffix in front; cuts lie between lines and are
    drawn from ``seed`` and doc_id alone. Added, replacing columns of the same name: ``fim_text``, ``fim_form`` (psm, spm or plain), ``n``
    (lines), ``prefix_chars`` and ``middle_chars`` (code points; null if plain). All other columns come back as they were.

    Texts that are empty or hold a marker stay plain; null counts as empty. A null doc_id draws as an empty one; rows of one doc_id draw alike. A text of any
    length is one row of a batch, with some 12 bytes of memory a byte. Empty table: no rows.
    """
    added = ["fim_text", "fim_form", "n", "prefix_chars", "middle_chars"]
    base = docs.drop(*added)
    rows = base.select(F.struct(*(F.col(f"`{c}`") for c in base.columns if c != "text")).alias("row"), F.col("doc_id").cast("string").alias("i"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("text").isNull().alias("none"))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_bytes, BATCH_BYTES):
            offsets, data = buffers(batch.column("text"))
            draws = drawn(batch.column("i").to_pylist(), seed)
            n, marked, cuts, first, middle = kernel(offsets, data, draws[:, :2])
            plain = (offsets[1:] == offsets[:-1]) | marked | (draws[:, 2] % 100 >= rate)
            spm = draws[:, 3] % 100 < suffix_first
            whole, out = memoryview(data), []
            for a, z, x, y, own, swapped in zip(offsets[:-1].tolist(), offsets[1:].tolist(), cuts[:, 0].tolist(), cuts[:, 1].tolist(), plain.tolist(), spm.tolist(), strict=True):
                if own:
                    out.append(bytes(whole[a:z]))
                elif swapped:
                    out.append(b"".join((s, whole[y:z], p, whole[a:x], m, whole[x:y])))
                else:
                    out.append(b"".join((p, whole[a:x], s, whole[y:z], m, whole[x:y])))
            forms = np.where(plain, "plain", np.where(spm, "spm", "psm"))
            counts = [pa.array(n), *(pa.array(x, mask=plain) for x in (first, middle))]
            text = pa.array([None if none else t for t, none in zip(batch.column("text").to_pylist(), batch.column("none").to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), text, pa.array(out, pa.string()), pa.array(forms.tolist(), pa.string()), *counts], ["row", "text", *added])

    schema = StructType([rows.schema["row"], StructField("text", StringType()), *(StructField(c, StringType() if c.startswith("fim") else LongType()) for c in added)])
    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in base.columns), *added)


def restored(text: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` rearranged. Markers in it are its own: texts that held any stay plain."""
    parts = F.split(text, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    piece = lambda psm, spm: F.when(form == "psm", parts[psm]).otherwise(parts[spm])
    return F.when(form == "plain", text).otherwise(F.concat(piece(1, 2), parts[3], piece(2, 1)))
