"""WARC archives in seekable Zstandard files.

Records are grouped into independent Zstandard frames of about ``FRAME_BYTES`` of records, so that one
frame can be read without the others. A skippable frame at the end of the file holds the seek table of
the Zstandard seekable format (compressed and decompressed size of each frame, then the number of frames
and the magic 0x8F92EAB1). The index maps each record's identifier to its file, its frame and its offset
in the decompressed frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenemill.llm.common import bounded_batches, materialise, workspace
from scenemill.llm.files import create, new_file, open_file

FRAME_BYTES = 1 << 20
LEVEL = 3

#: Payloads from this many bytes on are written once; later copies become revisit records.
REVISIT_BYTES = 1000

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_FOOTER = struct.Struct("<IBI")
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "scenemill:page")
_DATE = "1970-01-01T00:00:00Z"  # the tables carry no time of capture


def record_id(page_id: int | None, sha1: str, copy: int) -> str:
    """The identifier of the copy-th record (from 1) of a page with a payload."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{sha1}/{copy}')}>"


def _header_value(text: str) -> str:
    return " ".join(text.split())


def make_record(page_id: int | None, copy: int, url: str | None, payload: bytes, sha1: str, revisit: bool, refers_to: int | None) -> bytes:
    """One record; a revisit keeps the HTTP header, with the payload's length, and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, sha1, copy)}", f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}", "Content-Type: application/http; msgtype=response",
    ]
    if url is not None and _header_value(url):
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, sha1, 1)}"]
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page: {refers_to}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes | memoryview, at: int = 0) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """The record at ``at``: its headers, its HTTP headers, its payload, and where the next begins."""
    data = bytes(data) if isinstance(data, memoryview) else data
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    headers = dict(x.split(": ", 1) for x in lines)
    block = end + 4
    stop = block + int(headers["Content-Length"])
    http_end = data.index(b"\r\n\r\n", block)
    http = dict(x.split(": ", 1) for x in data[block:http_end].decode().split("\r\n")[1:])
    return headers, http, data[http_end + 4 : stop], stop + 4


class Writer:
    """Writes one archive; holds at most one frame of records."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.stream, self.frame_bytes = stream, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held: list[bytes] = []
        self.size = 0
        self.frames: list[tuple[int, int]] = []

    def add(self, record: bytes) -> tuple[int, int]:
        """Append a record; its frame and its offset in the decompressed frame."""
        if self.size and self.size + len(record) > self.frame_bytes:
            self._flush()
        at = (len(self.frames), self.size)
        self.held.append(record)
        self.size += len(record)
        return at

    def _flush(self) -> None:
        data = self.compressor.compress(b"".join(self.held))
        self.stream.write(data)
        self.frames.append((len(data), self.size))
        self.held, self.size = [], 0

    def close(self) -> int:
        """Write the seek table; the number of frames."""
        if self.size:
            self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + _FOOTER.pack(len(self.frames), 0, _SEEKABLE)
        self.stream.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.stream.close()
        return len(self.frames)


class Archive:
    """Reads single frames or records of an archive by its seek table."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(max(0, size - _FOOTER.size))
        footer = file.read(_FOOTER.size)
        if len(footer) < _FOOTER.size or _FOOTER.unpack(footer)[2] != _SEEKABLE:
            raise ValueError("no seek table")
        n, flags, _ = _FOOTER.unpack(footer)
        if flags:
            raise ValueError("seek tables with checksums aren't written here")
        file.seek(size - _FOOTER.size - 8 * n - 8)
        table = file.read(8 + 8 * n)
        if struct.unpack_from("<II", table) != (_SKIPPABLE, 8 * n + _FOOTER.size):
            raise ValueError("the seek table is damaged")
        sizes = np.frombuffer(table, "<u4", 2 * n, 8).reshape(n, 2).astype(np.int64)
        self.sizes, self.starts = sizes, np.cumsum(sizes[:, 0]) - sizes[:, 0]
        self.decompressor = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.sizes)

    def frame(self, k: int) -> bytes:
        self.file.seek(int(self.starts[k]))
        return self.decompressor.decompress(self.file.read(int(self.sizes[k, 0])), max_output_size=int(self.sizes[k, 1]))

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], dict[str, str], bytes]:
        return parse_record(self.frame(frame), offset)[:3]

    def records(self) -> Iterator[tuple[int, int, dict[str, str], dict[str, str], bytes]]:
        for k in range(len(self)):
            data, at = self.frame(k), 0
            while at < len(data):
                *record, after = parse_record(data, at)
                yield k, at, *record
                at = after


_INDEX = "record_id string, path string, frame int, offset long"


def _archive_writer(folder: str, frame_bytes: int, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, name = TaskContext.get().partitionId(), None, ""
        index: list[dict] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("id", "copy", "url", "payload", "sha1", "revisit", "refers_to")]
            for id_, copy, url, payload, sha1, revisit, refers_to in zip(*columns):
                if writer is None:
                    name = new_file(folder, part, ".warc.zst")
                    writer = Writer(create(name), frame_bytes, level)
                frame, offset = writer.add(make_record(id_, copy, url, payload, sha1, revisit, refers_to))
                index.append({"record_id": record_id(id_, sha1, copy), "path": name, "frame": frame, "offset": offset})
        if writer is not None:
            writer.close()
            for lo in range(0, len(index), 10000):
                yield pa.RecordBatch.from_pylist(index[lo : lo + 10000], pa.schema([("record_id", pa.string()), ("path", pa.string()), ("frame", pa.int32()), ("offset", pa.int64())]))

    return write


def write_archives(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    revisit_bytes: int = REVISIT_BYTES,
    folder: str | None = None,
    frame_bytes: int = FRAME_BYTES,
    level: int = LEVEL,
) -> DataFrame:
    """Write one record per row and return the index: ``record_id, path, frame, offset``.

    A file holds what one task reads. Of rows with equal payloads of at least ``revisit_bytes`` bytes the
    one with the largest id is a response and the others revisit it; of rows that repeat an id and a
    payload, the first is. The index names only files of tasks that ended well.
    """
    bounded_batches(pages.sparkSession)
    folder = folder or workspace(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    large = F.octet_length("payload") >= revisit_bytes
    # Only digests meet here; payloads are joined with the few rows that revisit.
    digests = materialise(rows.select("id", "sha1", large.alias("large")), "warc-digests")
    groups = digests.where("large").groupBy("sha1").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = materialise(groups, "warc-groups")
    revisits = digests.where("large").join(groups, "sha1").where("not (id <=> refers_to)")
    revisits = revisits.select(F.col("id").alias("__id"), F.col("sha1").alias("__sha1"), "refers_to").distinct()
    revisits = materialise(revisits, "warc-revisits")
    on = F.col("id").eqNullSafe(F.col("__id")) & (F.col("sha1") == F.col("__sha1"))
    joined = rows.join(revisits, on, "left").withColumn("revisit", F.col("__sha1").isNotNull()).withColumn("copy", F.lit(1))
    again = digests.groupBy("id", "sha1").agg(F.count("*").alias("n")).where("n > 1").select("id", "sha1")
    again = materialise(again, "warc-repeated")
    if not again.isEmpty():  # rows that repeat an id and a payload: the first may be a response, the others revisit it
        same = joined.id.eqNullSafe(again.id) & (joined.sha1 == again.sha1)
        nth = F.row_number().over(Window.partitionBy("id", "sha1").orderBy("url"))
        some = joined.join(again, same, "left_semi").withColumn("copy", nth)
        later = (F.col("copy") > 1) & ~F.col("revisit") & large
        some = some.withColumn("refers_to", F.when(later, F.col("id")).otherwise(F.col("refers_to")))
        some = some.withColumn("revisit", F.col("revisit") | later)
        joined = joined.join(again, same, "left_anti").unionByName(some)
    plan = joined.select("id", "copy", "url", "payload", "sha1", "revisit", "refers_to")
    return materialise(plan.mapInArrow(_archive_writer(folder, frame_bytes, level), _INDEX), "warc-index")


_PAGE = pa.schema(
    [
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("record_id", pa.string()), ("path", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("url", pa.string()),
    ]
)


def _archive_reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with open_file(path) as file:
                found: list[dict] = []
                for frame, offset, headers, http, payload in Archive(file).records():
                    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    kind = headers["WARC-Type"]
                    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(http["Content-Length"])):
                        raise ValueError(f"{path}: the record at frame {frame}, offset {offset} is damaged")
                    number = lambda key, h=headers: int(h[key]) if key in h else None
                    found.append(
                        {
                            "page_id": number("X-Page-ID"), "payload_bytes": int(http["Content-Length"]), "payload_digest": digest, "record_type": kind,
                            "refers_to": number("X-Refers-To-Page"), "record_id": headers["WARC-Record-ID"], "path": path, "frame": frame,
                            "offset": offset, "url": headers.get("WARC-Target-URI"),
                        }
                    )
                    if len(found) == 5000:
                        yield pa.RecordBatch.from_pylist(found, _PAGE)
                        found = []
                yield pa.RecordBatch.from_pylist(found, _PAGE)


def read_archives(paths: DataFrame) -> DataFrame:
    """One row per record of the archives in ``paths(path)``, a task per file; digests are verified."""
    files = max(1, paths.count())
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, path string, frame int, offset long, url string"
    return paths.select("path").repartition(files).mapInArrow(_archive_reader, schema)


def read_record(path: str, frame: int, offset: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """One record by its place in the index: reads and decompresses one frame."""
    with open_file(path) as file:
        return Archive(file).record(frame, offset)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a table of pages and read it back, one row per input row.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``, then the record's identifier and
    place. Null html is an empty payload; null urls and ids are left out of the headers; repeated rows are
    written each; an empty table writes no file and gives an empty result. Extra columns are ignored.
    """
    index = write_archives(pages, id_col, url_col, html_col)
    found = read_archives(index.select("path").distinct())
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "path", "frame", "offset")
