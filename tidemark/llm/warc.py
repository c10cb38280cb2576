r"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames of about ``frame_kb``; an archive ends in a skippable frame with
the seek table of the Zstandard seekable format (compressed and plain size of each frame). The index maps each
page to its archive, frame, and the offset of its record inside the frame, so one record costs one footer
and one frame.

Of pages with equal payloads of at least ``least`` bytes the one with the smallest page_id is written as a response
and the others as revisits of it; smaller payloads are all responses. Archives lie in the shared folder, which
pyarrow's file systems must be able to open; their names carry the task attempt, so a repeated task never touches
the files that the index of another attempt names.

Null html is an empty payload, a null url an empty one. Pages without an id are responses unless another page of equal
payload has one. Repeated rows of the first page are responses each. An empty table writes no archive.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import encoded, load, materialize, shared_dir

INDEX = "page_id long, archive string, frame int, frame_at long, frame_size long, record_at long, record_size long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}' if page_id is not None else f'payload:{digest}')}>"


def record_of(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC 1.1 record: a response with the payload, or a revisit without it."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "revisit" if refers_to is not None else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": quote(url, safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http;msgtype=response",
    }
    if page_id is not None:
        head["X-Page-ID"] = str(page_id)
    if refers_to is not None:
        head |= {"WARC-Refers-To": record_id(refers_to, digest), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page": str(refers_to)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_records(data: bytes):
    """The records of a frame: (offset, size, headers, HTTP headers, body)."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        http, _, body = block.partition(b"\r\n\r\n")
        yield at, end + 8 + size - at, head, http.decode(), body
        at = end + 8 + size


class Bundle:
    """An archive that is being written: frames, then their seek table."""

    def __init__(self, stream, level: int = 3):
        self.stream, self.frames, self.at = stream, [], 0
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)

    def add(self, plain: bytes) -> tuple[int, int, int]:
        """Write a frame; its number, offset and size."""
        frame = self.zstd.compress(plain)
        self.stream.write(frame)
        self.frames.append((len(frame), len(plain)))
        self.at += len(frame)
        return len(self.frames) - 1, self.at - len(frame), len(frame)

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.stream.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.stream.close()


def seek_table(source) -> list[tuple[int, int]]:
    """(offset, compressed size) of each frame, from the footer of an open archive."""
    size = source.size()
    count, _, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
    if magic != _SEEKABLE:
        raise ValueError("not a seekable archive")
    table, out, at = source.read_at(8 * count, size - 9 - 8 * count), [], 0
    for compressed, _ in struct.iter_unpack("<II", table):
        out.append((at, compressed))
        at += compressed
    return out


def _write(folder: str, frame_kb: int, archive_mb: int):
    def write(batches):
        task = TaskContext.get()
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        bundle, name, number = None, "", 0
        pending: list[tuple] = []
        waiting = 0

        def flush():
            nonlocal bundle, name, number, waiting
            if bundle is None:
                name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.zst"
                bundle, number = Bundle(fs.open_output_stream(f"{root}/{name}", compression=None)), number + 1
            frame, at, size = bundle.add(b"".join(r for _, r in pending))
            rows, offset = [], 0
            for page, record in pending:
                rows.append((page, f"{folder}/{name}", frame, at, size, offset, len(record)))
                offset += len(record)
            pending.clear()
            waiting = 0
            if bundle.at > archive_mb << 20:
                bundle.close()
                bundle = None
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["page_id", "archive", "frame", "frame_at", "frame_size", "record_at", "record_size"])

        for batch in batches:
            ids, urls, first = (batch[c].to_pylist() for c in ("page_id", "url", "first"))
            for page, url, payload, other in zip(ids, urls, encoded(batch["html"]), first):
                record = record_of(page, url or "", payload, other if other is not None and other != page else None)
                pending.append((page, record))
                waiting += len(record)
                if waiting > frame_kb << 10:
                    yield flush()
        if pending:
            yield flush()
        if bundle is not None:
            bundle.close()

    return write


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 100, frame_kb: int = 256, archive_mb: int = 64) -> DataFrame:
    """Write pages(page_id, url, html) and return the index, one row per record."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    html = F.coalesce("html", F.lit(""))
    plain = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.when(F.octet_length(html) >= least, F.sha2(F.encode(html, "UTF-8"), 256)).alias("digest"))
    repeated = plain.where("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    written = plain.join(repeated, "digest", "left").select("page_id", "url", "html", "first").mapInArrow(_write(folder, frame_kb, archive_mb), INDEX)
    return materialize(written, "warc-index")


def _described(data: bytes):
    for at, size, head, http, body in parse_records(data):
        revisit = head["WARC-Type"] == "revisit"
        length = int(http.rsplit("Content-Length: ", 1)[1].split("\r\n")[0]) if revisit else len(body)
        digest = head["WARC-Payload-Digest"].partition(":")[2] if revisit else hashlib.sha256(body).hexdigest()
        page, other = head.get("X-Page-ID"), head.get("X-Refers-To-Page")
        yield (None if page is None else int(page), head["WARC-Target-URI"], head["WARC-Type"], None if other is None else int(other), length, digest)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 6
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"])


def _read(batches):
    zstd = zstandard.ZstdDecompressor()
    for batch in batches:
        for name in batch["archive"].to_pylist():
            fs, path = pyarrow.fs.FileSystem.from_uri(name)
            with fs.open_input_file(path) as source:
                for at, size in seek_table(source):
                    yield _batch(list(_described(zstd.decompress(source.read_at(size, at)))))


def read_archives(index: DataFrame) -> DataFrame:
    """Every record of the archives that an index names, frame by frame."""
    return index.select("archive").distinct().mapInArrow(_read, RECORD)


def _fetch(batches):
    zstd = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for x in batch.to_pylist():
            fs, path = pyarrow.fs.FileSystem.from_uri(x["archive"])
            with fs.open_input_file(path) as source:
                at, size = seek_table(source)[x["frame"]]
                data = zstd.decompress(source.read_at(size, at))
            rows += _described(data[x["record_at"] : x["record_at"] + x["record_size"]])
        yield _batch(rows)


def fetch_records(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of wanted(page_id): one footer and one frame are read for each."""
    return index.join(wanted.select("page_id").distinct(), "page_id", "left_semi").mapInArrow(_fetch, RECORD)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(load(spark, sf_dir, "pages"))
    return read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
