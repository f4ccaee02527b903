"""WARC records in seekable Zstandard bundles (operator 5)."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.shared import file_system, shared_folder, slices, written

# Fixed values of the seekable format: the skippable frame's magic, the footer's magic, the footer's size.
SKIPPABLE, SEEKABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1, 9
DATE = "1970-01-01T00:00:00Z"
INDEX = "page_id long, bundle string, frame long, frame_start long, frame_bytes long, at long, n long"


def record(page: dict) -> bytes:
    """One WARC record: a response with its payload, or a revisit that names the response."""
    body = (page["html"] or "").encode() if page["refers_to"] is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if page['refers_to'] is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page['page_id']}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((page['url'] or '').split())}",
        f"WARC-Payload-Digest: sha1:{page['digest']}",
        f"X-Payload-Length: {page['size']}",
        f"Content-Length: {len(body)}",
    ]
    if page["refers_to"] is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{page['refers_to']}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and body of every record in the bytes of a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        n = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame at a bundle's end: compressed and plain size of each frame, then the footer."""
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file: pa.NativeFile) -> list[tuple[int, int]]:
    """Compressed and plain size of each frame, from the end of a bundle."""
    size = file.size()
    file.seek(size - FOOTER)
    n, _, magic = struct.unpack("<IBI", file.read(FOOTER))
    if magic != SEEKABLE:
        raise ValueError("the bundle has no seek table")
    file.seek(size - FOOTER - 8 * n)
    return list(struct.iter_unpack("<II", file.read(8 * n)))


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Payload size and SHA-1 of each page, and ``refers_to``: the largest page_id among equal payloads of ``least`` bytes or more.

    Payloads are compared by digest and size. Digests are counted with map-side sums and only digests
    that occur twice are joined back, so a payload that a third of all pages share is one row of the small side.
    """
    sized = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
        F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("digest"),
        F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size"),
    )
    owner = sized.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("owner"), F.count("*").alias("n"))
    return sized.join(owner.where("n > 1").drop("n"), ["digest", "size"], "left").withColumn(
        "refers_to", F.when(F.col("owner") != F.col("page_id"), F.col("owner"))
    ).drop("owner")


def write_bundles(pages: DataFrame, folder: str, least: int = 1000, frame_bytes: int = 1 << 20, level: int = 3) -> DataFrame:
    """Write one bundle per task; returns the index of records, itself a written table.

    A bundle is a run of independent Zstandard frames of about ``frame_bytes`` plain bytes each, then the seek
    table. The index maps ``page_id`` to its bundle, frame, the frame's place in the bundle, and the record's
    offset and size within the frame. A bundle's name holds a fresh number per task attempt, and only
    finished attempts' records reach the index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        path = f"{root}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        out, sizes, place, frame, rows = None, [], 0, [], []
        squeeze = zstandard.ZstdCompressor(level=level, write_checksum=True)

        def close_frame() -> pa.RecordBatch:
            nonlocal place, frame, rows
            plain = b"".join(frame)
            packed = squeeze.compress(plain)
            out.write(packed)
            cols = list(zip(*rows, strict=True))
            k = len(sizes)
            done = pa.RecordBatch.from_pydict(
                {"page_id": pa.array(cols[0], pa.int64()), "bundle": [path] * len(rows), "frame": [k] * len(rows), "frame_start": [place] * len(rows), "frame_bytes": [len(packed)] * len(rows), "at": list(cols[1]), "n": list(cols[2])}
            )
            sizes.append((len(packed), len(plain)))
            place, frame, rows = place + len(packed), [], []
            return done

        for batch in slices(batches, lambda b: b.column("size").to_pylist(), frame_bytes):
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(path, compression=None)
            total = 0
            for page in batch.to_pylist():
                data = record(page)
                rows.append((page["page_id"], total, len(data)))
                frame.append(data)
                total += len(data)
            yield close_frame()
        if out is not None:
            out.write(seek_table(sizes))
            out.close()

    return written(with_revisits(pages, least).mapInArrow(run, INDEX))


def read_bundles(spark: SparkSession, index: DataFrame, folder: str) -> DataFrame:
    """Every record of the bundles that the index names, frame by frame along the seek tables.

    Gives ``page_id, payload_bytes, payload_digest, record_type, refers_to, payload``; a revisit's size and digest
    are those of the full payload, and its payload is null. A response whose payload doesn't match its
    digest raises an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            for path in batch.column("bundle").to_pylist():
                with fs.open_input_file(path) as file:
                    place = 0
                    for packed, size in read_seek_table(file):
                        file.seek(place)
                        data = plain.decompress(file.read(packed), max_output_size=size)
                        place += packed
                        yield pa.RecordBatch.from_pylist([row(*x) for x in parse(data)], schema=RECORDS)

    bundles = index.select("bundle").distinct()
    # A number of its own, so that a short list of bundles isn't gathered into one reading task.
    return bundles.repartition(max(1, bundles.count()), "bundle").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def number(urn: str | None) -> int | None:
    """The page_id in ``<urn:page:N>``."""
    return int(urn[10:-1]) if urn and urn != "<urn:page:None>" else None


def row(head: dict[str, str], body: bytes) -> dict:
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    response = head["WARC-Type"] == "response"
    if response and hashlib.sha1(body, usedforsecurity=False).hexdigest() != digest:
        raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't match its digest")
    return {
        "page_id": number(head["WARC-Record-ID"]), "payload_bytes": int(head["X-Payload-Length"]), "payload_digest": digest,
        "record_type": head["WARC-Type"], "refers_to": number(head.get("WARC-Refers-To")), "payload": body if response else None,
    }


def lookup(spark: SparkSession, index: DataFrame, wanted: DataFrame, folder: str) -> DataFrame:
    """The records of some page_ids, each frame read once by its place in the bundle: no scan of bundles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        for batch in batches:
            for f in batch.to_pylist():
                with fs.open_input_file(f["bundle"]) as file:
                    file.seek(f["frame_start"])
                    data = zstandard.ZstdDecompressor().decompressobj().decompress(file.read(f["frame_bytes"]))
                for r in f["records"]:
                    yield pa.RecordBatch.from_pylist([row(*x) for x in parse(data[r["at"] : r["at"] + r["n"]])], schema=RECORDS)

    frames = index.join(wanted.select(F.col("page_id").cast("long").alias("page_id")).distinct(), "page_id", "left_semi").groupBy("bundle", "frame_start", "frame_bytes")
    return frames.agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("records")).mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    )


def warc_round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC bundles into the shared folder and read the bundles back.

    Null html is an empty payload, null url an empty target. Of repeated page_ids each row becomes a record; equal
    rows with the largest page_id are all responses. Empty table: no bundles, no rows. Other columns are ignored.
    """
    spark, folder = pages.sparkSession, shared_folder(pages.sparkSession)
    return read_bundles(spark, write_bundles(pages, folder, least), folder).drop("payload")
