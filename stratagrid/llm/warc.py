"""Operator 2: WARC archives in seekable Zstandard bundles.

Records are gathered into frames that decompress on their own; behind a bundle's last frame a seek table, itself a
skippable frame, holds the frames' sizes (the public seekable format). An index maps each record's id to its bundle, frame
and offset in the frame, so that one record costs the reading of one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, need, new_path, utf8, written

#: Bytes of records in a frame and in a bundle, about, before compression.
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 128 << 20, 3
#: Of the seekable format: the skippable frame that holds the table, and the last four bytes (fixed values).
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:stratagrid:page:"
#: Tasks among which a group of pages with one payload is dealt, at least; else as many as a shuffle has partitions.
SALTS = 64
INDEX = "record_id string, bundle string, frame int, offset int, length int"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(ident: object, url: str | None, payload: bytes, refers_to: object, revisit: bool) -> bytes:
    """One WARC record. A revisit holds the HTTP header alone, with the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{'null' if ident is None else ident}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict[str, object]:
    """A record's headers by lower-case name, and its payload; a response's payload must have the digest that it names."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record starts here")
    out: dict[str, object] = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[:int(str(out["content-length"]))]
    http, _, payload = block.partition(b"\r\n\r\n")
    out["payload_bytes"] = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if out["warc-type"] == "response":
        if len(payload) != out["payload_bytes"] or f"sha1:{digest_of(payload)}" != out["warc-payload-digest"]:
            raise ValueError(f"record {out['warc-record-id']} is damaged")
        out["payload"] = payload
    return out


class Writer:
    """Bundles in ``folder`` (a URI). ``add`` yields index rows once their bundle is whole."""

    def __init__(self, folder: str, name: str):
        import zstandard
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(folder)
        self.folder, self.name, self.number, self.out = folder, name, 0, None
        self.squeeze = zstandard.ZstdCompressor(level=LEVEL).compress

    def add(self, ident: str, data: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.bundle = f"{self.name}-{self.number}.warc.zst"
            self.out, self.frames, self.rows, self.raw = self.fs.open_output_stream(f"{self.path}/{self.bundle}", compression=None), [], [], 0
            self.held: list[bytes] = []
            self.size = 0
        if self.held and self.size + len(data) > FRAME_BYTES:
            self._frame()
        self.rows.append((ident, f"{self.folder}/{self.bundle}", len(self.frames), self.size, len(data)))
        self.held.append(data)
        self.size += len(data)
        self.raw += len(data)
        if self.raw >= BUNDLE_BYTES:
            yield from self.close()

    def _frame(self) -> None:
        packed = self.squeeze(b"".join(self.held))
        self.out.write(packed)
        self.frames.append((len(packed), self.size))
        self.held, self.size = [], 0

    def close(self) -> Iterator[tuple]:
        if self.out is None:
            return
        self._frame()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        rows, self.out = self.rows, None
        self.number += 1
        yield from rows


class Reader:
    """Frames of one bundle, found by its seek table."""

    def __init__(self, bundle: str):
        import zstandard
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(bundle)
        self.file = files.open_input_file(path)
        end = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{bundle} has no seek table")
        sizes = struct.unpack(f"<{2 * n}I", self.file.read_at(8 * n, end - 9 - 8 * n))
        self.packed, self.raw, self.starts = sizes[::2], sizes[1::2], [0]
        for x in self.packed:
            self.starts.append(self.starts[-1] + x)
        self.unpack = zstandard.ZstdDecompressor().decompress

    def frame(self, k: int) -> bytes:
        return self.unpack(self.file.read_at(self.packed[k], self.starts[k]), max_output_size=self.raw[k])


def write(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record per row into bundles under ``folder``, which all machines must share; the index, as a written table.

    Of rows with equal payloads (null: empty), those with the largest ``page`` are responses, all others revisits of it. A null
    ``page`` is less than any other; if all are null, all are responses. Repeated rows each make a record; these have one
    record id, and one salt if all three columns are equal. Blanks and control characters of a URL are percent-encoded in the
    record, and ``read`` returns it so; a null URL has no header. No rows make no files and an empty index. Each task writes
    files of its own; the index names only those of tasks that ended well, so what lost executors leave behind is never read.
    Other columns are not archived.
    """
    need(pages, page, url, html)
    spark = pages.sparkSession
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    salts = max(SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    digest, keeper, salt, shared = fresh(pages, "sg_digest", "sg_keeper", "sg_salt", "sg_shared")
    rows = pages.select(page, url, html).withColumns({digest: F.sha1(F.coalesce(F.col(html), F.lit("")).cast("binary")), salt: F.pmod(F.xxhash64(page, url), F.lit(salts))})
    groups = rows.groupBy(digest).agg(F.max(page).alias(keeper), F.count(F.lit(1)).alias(shared)).where(F.col(shared) > 1).drop(shared)
    # salts deal a large group over many tasks: the group's row is copied to the salts that its pages have
    spread = rows.select(digest, salt).distinct().join(groups, digest)
    joined = rows.join(spread, [digest, salt], "left").select(page, url, html, keeper)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        writer = Writer(folder, f"part-{task.partitionId():05d}-{uuid.uuid4().hex[:12]}")
        columns = ["record_id", "bundle", "frame", "offset", "length"]
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                done = []
                for ident, u, payload, kept in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                    revisit = kept is not None and kept != ident
                    done += writer.add(f"{URN}{'null' if ident is None else ident}", record(ident, u, payload or b"", kept, revisit))
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=columns)
        if done := list(writer.close()):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=columns)

    return written(joined.mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records that ``index`` names: page_id (long), url (percent-encoded as ``write`` says), payload_bytes, payload_digest, record_type, refers_to (long), payload (responses).

    Rows of one frame go to one task, which reads the frame once, and a bundle's frames in turn. ``index`` may be any part of what ``write`` returned, to read
    single records. A damaged record is an error.
    """
    # an index row is small and its frame is not, so partitions aren't to be put together by their bytes
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frames = index.repartition(parts, "bundle", "frame").groupBy("bundle", "frame").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("at")).sortWithinPartitions("bundle", "frame")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][:6 + payload]
    names = [x.split()[0] for x in schema.split(", ")]
    number = lambda x: None if x is None or (n := str(x)[1 + len(URN):-1]) == "null" else int(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, of = None, None
        for batch in batches:
            for bundle, frame, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if of != bundle:
                    reader, of = Reader(bundle), bundle
                data, out = reader.frame(frame), []
                for x in at:
                    r = parse(data[x["offset"]:x["offset"] + x["length"]])
                    out.append((number(r["warc-record-id"]), r.get("warc-target-uri"), r["payload_bytes"], str(r["warc-payload-digest"])[5:], r["warc-type"], number(r.get("warc-refers-to")), r.get("payload"))[:len(names)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return frames.mapInArrow(run, schema)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for bundles in the folder that all machines share."""
    path = new_path(spark, "warc")
    return path if "://" in path else f"file://{path}"
