"""WARC files: writing with revisit records, and a reader that salvages what follows damage.

Every record is written as a gzip member of its own; the reader also takes members of several records and
plain files. It checks each record (gzip checksum, header, length, block and payload digests); after a failed
check it searches for the next gzip member or version line that starts a valid record, and logs the bytes
between as a quarantined gap. Places inside a member count its plain bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pubmetrics.llm.store import made_folder, put, shared_folder, stored

VERSION = b"WARC/1.1\r\n"
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
FILES = "path string, n_records long, n_bytes long"
RECORDS = (
    "file string, at long, inside long, type string, record_id string, uri string, payload_digest string, payload_bytes long, "
    "refers_to string, payload binary, gap_start long, gap_bytes long, reason string"
)
SCHEMA = pa.schema(
    [(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (f.split() for f in RECORDS.split(", "))]
)


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None) -> str:
    """The same for the same page in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page/{page}')}>"


def header_value(text: str | None) -> str:
    """A value on one line: controls and line ends percent-coded."""
    return re.sub(r"[\x00-\x1f\x7f\x85  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text or "")


def record(page: int | None, uri: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One gzip member: a response, or a revisit whose block has the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", header_value(uri)),
        ("WARC-Page-ID", "" if page is None else str(page)),
        ("WARC-Payload-Digest", f"sha1:{sha1(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields[4:4] = [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers_to)), ("WARC-Refers-To-Page-ID", str(refers_to))]
    head = VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"
    pressed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pressed.compress(head + block + b"\r\n\r\n") + pressed.flush()


MEMBER_PIECE = 1 << 13


@dataclass
class Found:
    """A record, or (``reason`` set) a gap of bytes left out; in a gzip member, ``at`` is the member's place, and
    ``inside`` and ``size`` count its plain bytes."""

    at: int
    size: int
    fields: dict[str, str]
    block: bytes
    reason: str = ""
    inside: int = 0


def member(data: bytes, start: int) -> tuple[bytes, int]:
    """Plain bytes of the gzip member at a place, and its size; ValueError names the failed check."""
    unpack, plain, at, view = zlib.decompressobj(31), [], start, memoryview(data)
    try:
        # In small pieces: what is left of a piece after the member's end is copied.
        while at < len(data) and not unpack.eof:
            plain.append(unpack.decompress(view[at : at + MEMBER_PIECE]))
            at = min(at + MEMBER_PIECE, len(data))
    except zlib.error as e:
        raise ValueError("gzip") from e
    if not unpack.eof:
        raise ValueError("truncated")
    return b"".join(plain), at - len(unpack.unused_data) - start


def read_record(plain: bytes, at: int) -> Found:
    """The checked record at a place of plain bytes; ValueError names the failed check."""
    start = at
    if not re.match(rb"WARC/1\.[01]\r\n", plain[at : at + 10]):
        raise ValueError("version")
    end = plain.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("header")
    fields = {}
    for line in plain[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header")
        fields[name.decode("latin-1").lower()] = value.decode("utf-8", "replace").strip()
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        raise ValueError("header")
    stop = end + 4 + int(fields["content-length"])
    block = plain[end + 4 : stop]
    if plain[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("length")
    if fields.get("warc-block-digest", "").startswith("sha1:") and fields["warc-block-digest"][5:] != sha1(block):
        raise ValueError("block digest")
    if fields["warc-type"] == "response" and fields.get("warc-payload-digest", "").startswith("sha1:"):
        if fields["warc-payload-digest"][5:] != sha1(payload_of(block)[1]):
            raise ValueError("payload digest")
    return Found(start, stop + 4 - start, fields, block)


def payload_of(block: bytes) -> tuple[int, bytes]:
    """The HTTP header's payload length and the payload itself."""
    head, _, body = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?i)^content-length:[ \t]*(\d+)", head, re.MULTILINE)
    return int(size[1]) if size else len(body), body


def salvage(data: bytes, packed: bool = True) -> Iterator[Found]:
    """All valid records of a file in order, and each gap between them with the first failed check.

    ``packed``: gzip members are unpacked, and a member in which no record is valid is a gap as a whole.
    """
    at, bad, reason = 0, -1, ""
    while at < len(data):
        try:
            if packed and data[at : at + 3] == b"\x1f\x8b\x08":
                plain, size = member(data, at)
                inside, head = salvage(plain, False), []
                while not head or head[-1].reason:  # a gap at most, then a record
                    head.append(next(inside, None))
                    if head[-1] is None:
                        raise ValueError(head[0].reason if head[0] else "version")
                found = (Found(at, f.size, f.fields, f.block, f.reason, f.at) for f in chain(head, inside))
            else:
                one = read_record(data, at)
                found, size = [one], one.size
        except ValueError as e:
            if bad < 0:
                bad, reason = at, str(e)
            following = START.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if bad >= 0:
            yield Found(bad, at - bad, {}, b"", reason)
            bad = -1
        yield from found
        at += size
    if bad >= 0:
        yield Found(bad, len(data) - bad, {}, b"", reason)


def with_revisits(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Rows key, uri, payload and refers_to: null for a response, else the key of the response it repeats.

    Of rows with equal payloads of ``least_bytes`` bytes or more, the one with the largest key is the
    response. A null payload is empty; null keys are smallest; rows that repeat a whole key and payload
    are responses of the same id each.
    """
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(uri).alias("uri"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "size": F.octet_length("payload")})
    # The largest key of each digest is combined within tasks; the join back can be split where one digest is hot.
    first = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("key").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    rows = rows.join(first, ["digest", "size"], "left")
    return rows.select("key", "uri", "payload", F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write(rows: DataFrame, folder: str, file_bytes: int = 1 << 26) -> DataFrame:
    """Write records of (key, uri, payload, refers_to) to .warc.gz files; a row per file.

    A task goes on in a new file after ``file_bytes`` compressed bytes, from rows in order of key, uri and payload, so a
    repeated task cuts its files alike and leaves no other. Files get their names when complete. Without rows the
    folder is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, files, held, size = TaskContext.get(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal files, held, size
            name = f"part-{context.partitionId():06d}-{files:04d}.warc.gz"
            path = put(folder, name, b"".join(held), str(context.taskAttemptId()))
            row = {"path": path, "n_records": len(held), "n_bytes": size}
            files, held, size = files + 1, [], 0
            return pa.RecordBatch.from_pylist([row], pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

        for batch in batches:
            for key, uri, payload, refers_to in zip(*(batch.column(c) for c in ("key", "uri", "payload", "refers_to"))):
                refers = refers_to.as_py()
                held.append(record(key.as_py(), uri.as_py(), payload.as_py(), refers, refers is not None))
                size += len(held[-1])
                if size >= file_bytes:
                    yield flush()
        if held:
            yield flush()

    made_folder(rows.sparkSession, folder)
    rows = rows.select("key", "uri", "payload", "refers_to").sortWithinPartitions("key", "uri", "payload")
    return stored(rows.mapInArrow(run, FILES), "warc-files")


def read(spark, folder: str, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps (``reason`` not null) of all files of a folder.

    Files are *.warc.gz and plain *.warc, of less than 2 GB each, as a file's bytes are one value. A file is read by one task, record by record. ``inside`` is a place in the
    plain bytes of the gzip member at ``at``. ``payloads=False`` leaves payload bytes out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows, size = [], 0
                for f in salvage(content.as_py()):
                    row = dict.fromkeys(SCHEMA.names)
                    row |= {"file": path.as_py(), "at": f.at, "inside": f.inside}
                    if f.reason:
                        row |= {"gap_start": f.at, "gap_bytes": f.size, "reason": f.reason}
                    else:
                        length, body = payload_of(f.block)
                        response = f.fields["warc-type"] == "response"
                        row |= {
                            "type": f.fields["warc-type"],
                            "record_id": f.fields.get("warc-page-id") or None,
                            "uri": f.fields.get("warc-target-uri"),
                            "payload_digest": f.fields.get("warc-payload-digest", "").removeprefix("sha1:"),
                            "payload_bytes": len(body) if response else length,
                            "refers_to": f.fields.get("warc-refers-to-page-id"),
                            "payload": body if payloads and response else None,
                        }
                        size += len(f.block)
                    rows.append(row)
                    if size > 1 << 23 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(folder)
    return files.select("path", "content").mapInArrow(run, RECORDS)


def new_folder(spark) -> str:
    return shared_folder(spark, "warc")
