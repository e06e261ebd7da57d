"""WARC archives: a writer, and a reader whose tasks share out byte ranges.

Every record is a gzip member of its own. A reading task looks for the gzip
magic in its byte range, decodes the start of each candidate to see whether a
WARC header is there, and owns the records that start inside its range.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillframe.llm.files import shared_file
from quillframe.scratch import written

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
#: A writing task begins another file beyond this size.
FILE_BYTES = 1 << 30
#: Bytes of an archive that one reading task owns.
SPLIT_BYTES = 64 << 20
#: Reading tasks at most; beyond it a task reads several ranges.
MOST_TASKS = 100_000
READ_BYTES = 1 << 20
BATCH_BYTES = 16 << 20
#: Equal payloads of fewer bytes are stored again instead of referred to.
REVISIT_BYTES = 1000
#: Records carry this date: results must not depend on the clock.
RECORD_DATE = "1970-01-01T00:00:00Z"

_URN = "<urn:page:{}>"
MANIFEST = "path string, bytes long, records long"
_MANIFEST_ARROW = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
RECORDS = (
    "record_id string, record_type string, target_uri string, payload_bytes long, "
    "payload_digest string, refers_to string, payload binary, problem string"
)
_RECORDS_ARROW = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()),
    ("payload", pa.binary()), ("problem", pa.string()),
])


def with_record_types(pages: DataFrame, id_column: str, payload: str,
                      least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Adds payload (binary, null: empty), digest, record_type and refers_to.

    Of equal payloads of at least ``least_bytes`` those with the largest id are
    responses, the others revisits of it. A null id counts as smallest.
    """
    rows = pages.withColumn("_payload", F.coalesce(F.col(payload).cast("binary"), F.lit(b""))).withColumn(
        "_digest", F.sha1("_payload"))
    repeated = (
        rows.where(F.length("_payload") >= least_bytes)
        .groupBy("_digest")
        .agg(F.max(id_column).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1").drop("_n")
    )
    revisits = F.col("_first").isNotNull() & ~F.col(id_column).eqNullSafe(F.col("_first"))
    return rows.join(repeated, "_digest", "left").select(
        F.col(id_column).cast("string").alias("record_id"),
        *[F.col(c) for c in pages.columns if c == "url"],
        F.when(revisits, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.col("_digest").alias("payload_digest"),
        F.when(revisits, F.col("_first").cast("string")).alias("refers_to"),
        F.length("_payload").cast("long").alias("payload_bytes"),
        # a revisit holds no payload: don't carry it to the writer
        F.when(~revisits, F.col("_payload")).alias("payload"),
    )


def _member(row: dict) -> bytes:
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['payload_bytes']}\r\n\r\n"
    ).encode()
    block = http + (row["payload"] or b"")
    head = [
        VERSION.decode(), f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {_URN.format(row['record_id'] if row['record_id'] is not None else '')}",
        f"WARC-Date: {RECORD_DATE}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if row.get("url") is not None:
        head.append("WARC-Target-URI: " + row["url"].replace("\r", "%0D").replace("\n", "%0A"))
    if row["record_type"] == "revisit":
        head.append(f"WARC-Refers-To: {_URN.format(row['refers_to'])}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def write_archive(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes records as ``.warc.gz`` files; returns the manifest of the files.

    The manifest is itself written by Spark, so it names the files of attempts
    that were committed; those of lost or repeated attempts are in no manifest
    and never read.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = shared_file(folder)
        store.create_dir(root, recursive=True)
        out, name, size, count = None, "", 0, 0
        done = []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                member = _member(row)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    done.append((f"{folder}/{name}", size, count))
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, count))
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t.type) for x, t in zip(zip(*done), _MANIFEST_ARROW)], schema=_MANIFEST_ARROW)

    return written(records.mapInArrow(write, MANIFEST), "warc-manifest")


class _Window:
    """Bytes of a file from a place on, read in pieces."""

    def __init__(self, file, at: int, size: int):
        self.file, self.at, self.size, self.held = file, at, size, b""
        file.seek(at)

    def more(self) -> bool:
        piece = self.file.read(READ_BYTES)
        self.held += piece
        return bool(piece)

    def drop(self, n: int) -> None:
        self.held, self.at = self.held[n:], self.at + n


def _is_record(window: _Window, at: int) -> bool:
    """Whether a gzip member at ``at`` of the window decodes to a WARC header."""
    while len(window.held) < at + 512 and window.more():
        pass
    try:
        return zlib.decompressobj(31).decompress(window.held[at:at + 512], 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _next_record(window: _Window, end: int) -> bool:
    """Drops bytes up to the next record that starts before ``end``."""
    while window.at < end:
        at = window.held.find(MAGIC)
        if at < 0:
            window.drop(max(0, len(window.held) - len(MAGIC) + 1))
            if not window.more():
                return False
        elif window.at + at >= end:
            return False
        elif _is_record(window, at):
            window.drop(at)
            return True
        else:
            window.drop(at + 1)
    return False


def _decoded(window: _Window) -> bytes:
    """The member at the window's start; leaves the window behind it."""
    unpacker, parts = zlib.decompressobj(31), []
    while True:
        if not window.held and not window.more():
            raise zlib.error("cut short")
        parts.append(unpacker.decompress(window.held))
        window.at += len(window.held) - len(unpacker.unused_data)
        window.held = unpacker.unused_data
        if unpacker.eof:
            return b"".join(parts)


def _parsed(record: bytes, payloads: bool) -> dict:
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(
        (k.strip().lower(), v.strip())
        for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:]))
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    plain = lambda x: x[len("<urn:page:"):-1] or None if x else None
    stated = fields.get("warc-payload-digest", "sha1:").removeprefix("sha1:")
    digest, problem = base64.b32decode(stated).hex(), None
    size = len(payload)
    if fields["warc-type"] == "revisit":
        sizes = [line.partition(b":")[2] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        size, payload = int(sizes[0]), None
    elif (found := hashlib.sha1(payload).hexdigest()) != digest:
        digest, problem = found, "payload differs from its digest"
    return {
        "record_id": plain(fields.get("warc-record-id")), "record_type": fields["warc-type"],
        "target_uri": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest,
        "refers_to": plain(fields.get("warc-refers-to")), "payload": payload if payloads else None, "problem": problem,
    }


def records_of_range(file, start: int, end: int, payloads: bool = True) -> Iterator[dict]:
    """The records that start in ``[start, end)`` of an open archive.

    A member that can't be decoded is one row with only ``problem``; reading
    goes on at the next record.
    """
    window = _Window(file, start, end)
    while _next_record(window, end):
        at = window.at
        while window.at < end:
            try:
                record = _parsed(_decoded(window), payloads)
            except (zlib.error, KeyError, ValueError, IndexError) as error:
                yield dict.fromkeys(_RECORDS_ARROW.names) | {"problem": f"at byte {at}: {error}"}
                file.seek(at + 1)
                window.at, window.held = at + 1, b""
                break
            yield record
            at = window.at
            if not _is_record(window, 0):
                break


def read_archive(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """The records of the manifest's files, each read by the task that owns its start.

    ``payload_bytes`` and ``payload_digest`` are of the full payload, for
    revisits too; ``payload`` is null for revisits, and everywhere without
    ``payloads``. An empty manifest gives no rows.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split in batch.to_pylist():
                store, path = shared_file(split["path"])
                held, size = [], 0
                with store.open_input_file(path) as file:
                    for record in records_of_range(file, split["start"], split["end"], payloads):
                        held.append(record)
                        size += 200 + (len(record["payload"] or b""))
                        if size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema=_RECORDS_ARROW)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=_RECORDS_ARROW)

    splits = manifest.where("bytes > 0").select(
        "path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"),
    ).withColumn("end", F.col("start") + split_bytes)
    # Ranges are small rows, which would be put into one task: ask for a number of tasks.
    return splits.repartition(min(max(1, splits.count()), MOST_TASKS), "path", "start").mapInArrow(read, RECORDS)
