"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some records, and a seek table in a skippable frame at its
end, as the seekable format of Zstandard lays down. An index table maps a record to its bundle, its frame and the offset within the frame's
content, so one record is read by decompressing one frame. Tasks write bundles to a shared folder, one file name for each
attempt, and the index table names only those of the attempts that ended well: a lost executor leaves at most a stray file.

Equal payloads of at least `smallest` bytes are stored once, in the record of the largest page_id; the others become revisit
records that refer to it. The groups of equal payloads are found on digests alone, with partial aggregation before the shuffle.

The folder must be a URI that pyarrow can open (file, hdfs, s3, gs, abfs).

Defined cases: a null or empty html is an empty payload; a null url is written as an empty one; a page without page_id is
always a response; of repeated rows of the largest page_id each is a response; an empty table gives no rows; columns other
than page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import drop, materialize, scratch_path, ship

SMALLEST = 1000
FRAME_BYTES, BUNDLE_BYTES = 512 * 1024, 64 * 1024 * 1024
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Groups of equal payloads up to this number (about 10 MB) are sent to every task; beyond it they are joined by a shuffle.
SEND_MOST = 100_000
DATE = "2024-01-01T00:00:00Z"


def open_fs(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def record(page: int | None, url: str | None, payload: bytes, size: int, digest: str, refers: int | None) -> bytes:
    """One WARC record; a revisit holds the HTTP head only, with the full payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([] if refers is None else [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers, the payload's full length as its head gives it, and the payload (empty for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields, size, payload


class BundleWriter:
    def __init__(self, out):
        import zstandard

        self.out, self.zstd = out, zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.sizes: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.filled = self.written = 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """The frame and the offset within it."""
        if self.held and self.filled + len(raw) > FRAME_BYTES:
            self.flush()
        at = self.filled
        self.held.append(raw)
        self.filled += len(raw)
        return len(self.sizes), at

    def flush(self) -> None:
        if self.held:
            frame = self.zstd.compress(b"".join(self.held))
            self.out.write(frame)
            self.sizes.append((len(frame), self.filled))
            self.written += len(frame)
            self.held, self.filled = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", c, d) for c, d in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


@lru_cache(maxsize=64)
def seek_table(path: str) -> tuple[tuple[int, int], ...]:
    """(offset, compressed size) of each frame, read from the end of the bundle."""
    fs, p = open_fs(path)
    with fs.open_input_file(p) as f:
        end = f.size()
        f.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"no seek table: {path}")
        f.seek(end - 9 - 8 * n)
        out, at = [], 0
        for k in range(n):
            c, _ = struct.unpack("<II", f.read(8))
            out.append((at, c))
            at += c
    return tuple(out)


def read_frame(path: str, frame: int) -> bytes:
    import zstandard

    at, size = seek_table(path)[frame]
    fs, p = open_fs(path)
    with fs.open_input_file(p) as f:
        f.seek(at)
        return zstandard.ZstdDecompressor().decompress(f.read(size))


def write_archive(spark: SparkSession, pages: DataFrame, folder: str, smallest: int = SMALLEST) -> DataFrame:
    """Writes the bundles and returns the index: page_id, bundle, frame, offset, length."""
    ship(spark)
    raw = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("payload"))
    p = p.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    groups = p.where((F.col("size") >= smallest) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = materialize(groups, "equal")
    n_groups, n_rows = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n_groups <= SEND_MOST:
        p = p.join(F.broadcast(groups.drop("n")), "digest", "left")
    else:  # the payloads of a page that many others repeat stay where they are
        most = max(1000, n_rows // 1000)
        hot = F.broadcast(groups.where(F.col("n") > most).drop("n"))  # at most a thousand
        p = p.join(hot, "digest").unionByName(p.join(hot.select("digest"), "digest", "left_anti").join(groups.where(F.col("n") <= most).drop("n"), "digest", "left"))
    p = p.withColumn("refers", F.when((F.col("size") >= smallest) & (F.col("page_id") != F.col("first")), F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        ctx, k, out, bundle = TaskContext.get(), 0, None, ""
        fs.create_dir(top, recursive=True)
        for b in batches:
            rows = []
            for page, url, payload, digest, size, refers in zip(*(b.column(c) for c in ("page_id", "url", "payload", "digest", "size", "refers")), strict=True):
                if out is None:
                    name = f"part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}-{k}.warc.zst"
                    bundle, out, k = f"{folder}/{name}", BundleWriter(fs.open_output_stream(f"{top}/{name}", compression=None)), k + 1
                raw = record(page.as_py(), url.as_py(), payload.as_py(), size.as_py(), digest.as_py(), refers.as_py())
                frame, at = out.add(raw)
                rows.append((page.as_py(), bundle, frame, at, len(raw)))
                if out.written >= BUNDLE_BYTES:
                    out.close()
                    out = None
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["page_id", "bundle", "frame", "offset", "length"])
        if out is not None:
            out.close()

    index = p.select("page_id", "url", "payload", "digest", "size", "refers").mapInArrow(run, "page_id long, bundle string, frame int, offset int, length int")
    index = materialize(index, "warc-index")
    drop(groups)
    return index


def read_archive(index: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the index, read from its bundle; size and digest of a response are those of the payload read. page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload)."""
    frames = index.groupBy("bundle", "frame").agg(F.collect_list(F.struct("offset", "length")).alias("at"))  # the records of one frame
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bundle, frame, places in zip(b.column("bundle").to_pylist(), b.column("frame").to_pylist(), b.column("at").to_pylist(), strict=True):
                content, rows = read_frame(bundle, frame), []
                for x in places:
                    h, size, payload = parse(content[x["offset"] : x["offset"] + x["length"]])
                    page, refers = h["WARC-Record-ID"][10:-1], h.get("WARC-Refers-To", "")[10:-1]
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not refers:  # what was read counts, not what the head says
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    rows.append((int(page) if page else None, h["WARC-Target-URI"], size, digest, h["WARC-Type"], int(refers) if refers else None, payload)[: 6 + payloads])
                cols = list(zip(*rows, strict=True))
                types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + payloads])

    return frames.mapInArrow(run, schema)


def archive_and_read(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes the pages as bundles in the shared folder and reads every record back."""
    return read_archive(write_archive(spark, pages, scratch_path(spark, "warc")))
