"""WARC records in seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames of whole records, then a skippable frame with the seek table
(the public seekable format: compressed and decompressed size of each frame, frame count, magic). An index row maps a
record's identifier to its bundle, the frame's place, and its offset and length in the frame. Equal payloads are
stored once: one record is the response, the others are revisit records that refer to it.

Bundles are written through pyarrow's file systems (local, HDFS, S3, GCS by the scheme of the path), each under a
temporary name that is renamed, so that a repeated task replaces its own file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.arrowtext import tidy
from gridloom.llm.repeats import opened
from gridloom.llm.session import scratch, ship, tasks, written

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, bundle string, frame long, frame_offset long, frame_bytes long, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, n_bytes: int, sha1: str) -> bytes:
    """A response record, or a revisit record without payload if refers_to is set."""
    name = lambda x: f"<urn:x-page:{'' if x is None else x}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {url.translate({10: '%0A', 13: '%0D'})}")
    head.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"X-Payload-Length: {n_bytes}"]
    body = b"" if refers_to is not None else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(data: bytes, at: int = 0) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, body) of the records in a frame's data from an offset on."""
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        stop = end + 4 + int(head["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} doesn't end where it says")
        yield at, stop + 4 - at, head, data[end + 4 : stop]
        at = stop + 4


class BundleWriter:
    """Groups records into frames of about frame_bytes (a larger record has a frame of its own)."""

    def __init__(self, path: str, frame_bytes: int, level: int):
        self.fs, self.path = opened(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temporary)
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.limit, self.table, self.at = frame_bytes, [], 0
        self.parts: list[bytes] = []
        self.waiting: list[tuple[int | None, int, int]] = []
        self.size = 0

    def add(self, page_id: int | None, data: bytes) -> list[tuple]:
        """Index rows of the frame that this record closes, if it does."""
        done = self.close_frame() if self.parts and self.size + len(data) > self.limit else []
        self.waiting.append((page_id, self.size, len(data)))
        self.parts.append(data)
        self.size += len(data)
        return done

    def close_frame(self) -> list[tuple]:
        if not self.parts:
            return []
        frame = self.zstd.compress(b"".join(self.parts))
        self.out.write(frame)
        rows = [(p, len(self.table), self.at, len(frame), offset, length) for p, offset, length in self.waiting]
        self.table.append((len(frame), self.size))
        self.at += len(frame)
        self.parts, self.waiting, self.size = [], [], 0
        return rows

    def close(self) -> list[tuple]:
        rows = self.close_frame()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()
        if self.fs.get_file_info(self.path).type != pafs.FileType.NotFound:
            self.fs.delete_file(self.path)  # of a task that ran before; not every file system renames over a file
        self.fs.move(self.temporary, self.path)
        return rows


def seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, from the end of an open bundle."""
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    f.seek(size - 9 - 8 * n)
    sizes = struct.unpack(f"<{2 * n}I", f.read(8 * n))
    out, at = [], 0
    for i in range(n):
        out.append((at, sizes[2 * i], sizes[2 * i + 1]))
        at += sizes[2 * i]
    return out


def lookup(index_row) -> tuple[dict[str, str], bytes]:
    """(headers, body) of one record, reading its frame alone."""
    fs, path = opened(index_row["bundle"])
    with fs.open_input_file(path) as f:
        f.seek(index_row["frame_offset"])
        data = zstandard.ZstdDecompressor().decompress(f.read(index_row["frame_bytes"]))
    _, _, head, body = next(parsed(data, index_row["offset"]))
    return head, body


def _write(root: str, frame_bytes: int, bundle_bytes: int, level: int):
    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, bundle, path = TaskContext.get().partitionId(), 0, None, ""

        def table(rows: list[tuple]) -> pa.RecordBatch:
            whole = [(r[0], path, *r[1:]) for r in rows]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in whole], t) for i, t in enumerate(kinds)], names)

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, refers, n, sha1 = (batch.column(c)[i].as_py() for c in ("page_id", "url", "html", "refers_to", "payload_bytes", "sha1"))
                payload = (html or "").encode()
                sha1 = base64.b32encode(sha1).decode()
                if bundle is None:
                    path = f"{root}/part-{part:06d}-{k:04d}.warc.zst"
                    bundle, k = BundleWriter(path, frame_bytes, level), k + 1
                if rows := bundle.add(page, record(page, url, payload, refers, n, sha1)):
                    yield table(rows)
                if bundle.at > bundle_bytes:
                    yield table(bundle.close())
                    bundle = None
        if bundle is not None:
            yield table(bundle.close())

    return run


def archived(pages: DataFrame, root: str, least_bytes: int = 0, frame_bytes: int = 256 << 10, bundle_bytes: int = 64 << 20, level: int = 3) -> DataFrame:
    """Write a record per row (page_id, url, html) to bundles below root; returns the index, which is on disk then.

    Of the records with equal payloads of at least least_bytes, that with the largest page_id is the response (null
    ids are the smallest; of repeated rows with that id each is a response); the others refer to it. Null html is an
    empty payload. Rows that repeat an id repeat its record identifier. An empty table gives an empty index and no bundle.
    Other columns are ignored, whatever their names; a very long payload is a frame of its own.
    """
    spark = pages.sparkSession
    ship(spark)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.unhex(F.sha1(payload)).alias("sha1"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    many = rows.groupBy("sha1", "payload_bytes").agg(F.max("page_id").alias("winner"), F.count("*").alias("n"))
    many = written(many.where((F.col("n") > 1) & (F.col("payload_bytes") >= least_bytes) & F.col("winner").isNotNull()).select("sha1", "winner"), "warc-copies")
    met = rows.join(many, "sha1", "left")
    other = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    met = met.withColumn("refers_to", F.when(other, F.col("winner"))).withColumn("html", F.when(~other, F.col("html")))
    index = met.select("page_id", "url", "html", "refers_to", "payload_bytes", "sha1").mapInArrow(tidy(_write(root, frame_bytes, bundle_bytes, level)), INDEX)
    return written(index, "warc-index")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zstd = zstandard.ZstdDecompressor()
    number = lambda s: int(s) if (s := s[12:-1]) else None
    for batch in batches:
        for bundle, first, last in zip(*(batch.column(c).to_pylist() for c in ("bundle", "first", "last")), strict=True):
            fs, path = opened(bundle)
            with fs.open_input_file(path) as f:
                table = seek_table(f, f.size())
                for at, size, _ in table[first : last + 1]:
                    f.seek(at)
                    rows = []
                    for _, _, head, body in parsed(zstd.decompress(f.read(size))):
                        sha1 = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = head["WARC-Type"] == "revisit"
                        if not revisit and digest(body) != sha1:
                            raise ValueError(f"{bundle}: the payload of {head['WARC-Record-ID']} is damaged")
                        n = int(head["X-Payload-Length"]) if revisit else len(body)
                        rows.append((number(head["WARC-Record-ID"]), n, sha1, head["WARC-Type"], number(head["WARC-Refers-To"]) if revisit else None))
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in RECORDS.split(", ")])


def read_back(index: DataFrame, frames: int = 32) -> DataFrame:
    """All records of the bundles in an index, read from the bundles; a task takes runs of `frames` frames."""
    run = F.floor(F.col("frame") / frames)
    todo = index.groupBy("bundle", run.alias("run")).agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    return todo.repartition(tasks(index.sparkSession), "bundle", "run").mapInArrow(tidy(_read), RECORDS)


def round_trip(pages: DataFrame, root: str | None = None, **options) -> DataFrame:
    """Write pages to bundles, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read_back(archived(pages, root or scratch(pages.sparkSession, "warc"), **options))
