"""Web archives: an index of offset, length, address and digest per record, and reads by coalesced byte ranges.

Each writing task puts its records, one gzip member each, into archive files of its own in the shared
folder and returns the index rows. Spark commits the index as one table, so records of a failed or
repeated attempt are never pointed to. Reading starts from selected index rows: sorted by archive and
offset, close neighbours are fetched in one range.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import small_side
from orderloom.sources.stage import StageTables

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 512 << 20
RANGE_BYTES, RANGE_GAP = 8 << 20, 64 << 10
TASK_BYTES = 16 << 20  # stored bytes that a reading task fetches
WRITTEN_AT = "2000-01-01T00:00:00Z"  # one date for all records, so that a rerun writes the same bytes
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

INDEX = (
    "page_id long, url string, archive string, offset long, length long, payload_digest string, "
    "payload_bytes long, record_type string, refers_to long"
)
READ = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def open_store(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder given as a plain path or as an address (file, hdfs, s3, gs)."""
    return pafs.FileSystem.from_uri(address(folder))


def address(folder: str) -> str:
    """Spark's name of a folder as Arrow knows it: Hadoop's s3a and s3n are s3."""
    return re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", folder))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record; with ``refers_to`` a revisit without a block, else a response."""
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {WRITTEN_AT}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    block = b""
    if refers_to is None:
        block = _HTTP + payload
        head.append("Content-Type: application/http;msgtype=response")
    else:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-Id: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record and its payload; a payload that differs from its digest is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    number = lambda name: int(fields[name]) if name in fields else None
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": number("Page-Id"), "record_type": kind, "refers_to": number("Refers-To-Page-Id"), "payload_digest": digest,
        "payload_bytes": None if payload is None else len(payload), "payload": payload,
    }


def write(pages: DataFrame, stage: StageTables, name: str = "warc") -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) and return the stored index.

    A null html has an empty payload, a null url no address line, a null page_id no id line. Of rows with
    equal payloads of at least ``MIN_REVISIT_BYTES`` bytes the smallest page_id is the response and the
    others revisit it; rows that share that id and payload are all responses. Other columns are not read.
    An empty table gives an empty index.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        html.cast("binary").alias("payload"), F.sha2(html, 256).alias("digest"),
    )
    copies = stage.keep(
        f"{name}-copies",
        rows.filter(F.octet_length("payload") >= MIN_REVISIT_BYTES).groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 AND first_id IS NOT NULL")
        .select("digest", "first_id"),
    )
    marked = rows.join(small_side(copies), "digest", "left").select(
        "page_id", "url", "payload", "digest",
        F.when(F.col("page_id").eqNullSafe(F.col("first_id")), None).otherwise(F.col("first_id")).alias("refers_to"),
    )
    folder, limit = f"{stage.folder}/{name}-archives", ARCHIVE_BYTES

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task = f"{context.partitionId():05d}-{context.taskAttemptId()}"
        fs, base = open_store(folder)
        fs.create_dir(base, recursive=True)
        out, archive, offset, n = None, "", 0, 0
        for batch in batches:
            index = []
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or offset >= limit:
                    if out is not None:
                        out.close()
                    archive, offset, n = f"{task}-{n:03d}.warc.gz", 0, n + 1
                    out = fs.open_output_stream(f"{base}/{archive}", compression=None)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                raw = packer.compress(record(page_id, url, payload, digest, refers_to)) + packer.flush()
                out.write(raw)
                index.append({
                    "page_id": page_id, "url": url, "archive": archive, "offset": offset, "length": len(raw), "payload_digest": digest,
                    "payload_bytes": len(payload), "record_type": "response" if refers_to is None else "revisit", "refers_to": refers_to,
                })
                offset += len(raw)
            if index:
                yield pa.RecordBatch.from_pylist(index, INDEX_ARROW)
        if out is not None:
            out.close()

    return stage.keep(f"{name}-index", marked.mapInArrow(store, INDEX))


INDEX_ARROW = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
])
READ_ARROW = pa.schema([
    ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("payload", pa.binary()),
])


def ranges(places: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """Coalesce sorted (offset, length) places into (start, end, positions), bridging small gaps."""
    start = end = 0
    held: list[int] = []
    for i, (offset, length) in enumerate(places):
        if held and (offset - end > RANGE_GAP or offset + length - start > RANGE_BYTES):
            yield start, end, held
            held = []
        if not held:
            start = offset
        end = max(end, offset + length) if held else offset + length
        held.append(i)
    if held:
        yield start, end, held


def read(index: DataFrame, stage: StageTables, name: str = "warc", payloads: bool = True) -> DataFrame:
    """The records that the rows of ``index`` point to; every payload is checked against its digest.

    Ranges of sorted places are dealt out evenly, so one large archive is read by many tasks. Without
    ``payloads`` that column is null. Repeated index rows give repeated records, null ids and addresses come back null, other columns of
    the index are not read, and an empty index gives no records.
    """
    folder = f"{stage.folder}/{name}-archives"

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(folder)
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            at = 0
            while at < len(rows):
                archive, upto = rows[at][0], at
                while upto < len(rows) and rows[upto][0] == archive:
                    upto += 1
                with fs.open_input_file(f"{base}/{archive}") as file:
                    for start, end, held in ranges([r[1:] for r in rows[at:upto]]):
                        raw, found = memoryview(file.read_at(end - start, start)), []
                        for i in held:
                            offset, length = rows[at + i][1:]
                            one = parse(zlib.decompress(raw[offset - start : offset - start + length], 31))
                            found.append(one if payloads else one | {"payload": None})
                        yield pa.RecordBatch.from_pylist(found, READ_ARROW)
                at = upto

    places = index.select("archive", "offset", "length")
    # the rows of the index are small, what they point to is not: tasks are cut by the bytes they will read
    total = places.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    dealt = places.repartitionByRange(max(1, -(-total // TASK_BYTES)), "archive", "offset")
    return dealt.sortWithinPartitions("archive", "offset").mapInArrow(fetch, READ)


def resolve(records: DataFrame) -> DataFrame:
    """One row per record of ``records`` (stored); a revisit gets the payload's size from the response it refers to.

    Only record columns are read; records with null ids keep their rows; an empty table stays empty.
    """
    responses = records.filter("record_type = 'response'")
    sizes = responses.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.first("payload_bytes").alias("payload_bytes"))
    revisits = records.filter("record_type = 'revisit'").drop("payload_bytes").join(sizes, ["refers_to", "payload_digest"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(*columns).union(revisits.select(*columns))
