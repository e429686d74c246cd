"""WARC archives: writing crawls, and normalising monolithic gzip streams to one member per record.

`write_archives` writes rows as archives that are one gzip stream each, as some crawlers leave them. `normalise`
inflates such a stream once, front to back, rewrites every record as its own gzip member and writes a sidecar index
`<archive>.idx` with one JSON line per record (offset, length, type, id, target, digest). `read_records` reads members at
the offsets of the sidecar alone.

Of rows with equal payloads of at least `min_bytes` the one with the largest id is the response and the others are
revisits of it, without payload; smaller payloads are always responses. Files are named by a fresh id per task
attempt and only those in a finished task's rows count, so a lost or repeated task leaves at most files nobody reads.

Defined cases: a null payload is empty; a null id or url is written as `null`/`about:blank`, and a null id cannot be referred to
unless all ids of its payload are null. Rows with the same id and payload are all responses if that id is the largest.
Characters of a url that a header cannot hold are percent-encoded. A damaged or cut-off archive gives its records up to the
fault and the fault in `error`. Empty tables give no archives. Only the named columns are read. A record's block is copied in
pieces, so a task holds one piece, or one payload when it makes or reads records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metframe.llm.common import column_names, open_folder, slices
from metframe.session import materialize, stage_folder

PIECE = 1 << 20
_GZIP = 31
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL_SAFE = "".join(chr(c) for c in range(33, 127))


def with_roles(df: DataFrame, record_id: str, url: str, payload: str, min_bytes: int = 1000) -> DataFrame:
    """record_id, url, payload (UTF-8), payload_bytes, payload_digest, record_type and refers_to of every row.

    Only digests cross the network to find equal payloads; the digests that occur more than once are stored, so that
    Spark sees their size and ships them to the payloads where they are few.
    """
    column_names(df, record_id, url, payload)
    body = F.coalesce(F.encode(F.col(f"`{payload}`"), "UTF-8"), F.lit(b"").cast("binary"))
    rows = df.select(F.col(f"`{record_id}`").alias("record_id"), F.col(f"`{url}`").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    shared = (
        rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
        .agg(F.count("*").alias("n"), F.max("record_id").alias("response_id")).where("n > 1").drop("n")
    )
    shared = materialize(shared, "warc-shared")
    revisit = F.col("response_id").isNotNull() & ~F.col("response_id").eqNullSafe(F.col("record_id"))
    revisit &= F.col("payload_bytes") >= min_bytes
    return rows.join(shared, "payload_digest", "left").select(
        "record_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("response_id")).alias("refers_to"),
    )


def record_bytes(
    record_id: object, url: str | None, payload: bytes, size: int, digest: str, kind: str, refers_to: object, date: str
) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head, with the length of the payload it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(record_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url, safe=_URL_SAFE) if url else 'about:blank'}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _urn(record_id: object) -> str:
    return f"<urn:record:{'null' if record_id is None else quote(str(record_id), safe='')}>"


def write_archives(
    rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = 256 << 20, level: int = 1
) -> DataFrame:
    """Write rows of `with_roles` as monolithic gzip archives in a shared folder; one row (archive, records) for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_folder(folder)
        files.create_dir(base, recursive=True)
        out = None
        for batch in slices(batches, 256):
            for row in batch.to_pylist():
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, deflate = files.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, _GZIP)
                data = record_bytes(
                    row["record_id"], row["url"], row["payload"], row["payload_bytes"], row["payload_digest"],
                    row["record_type"], row["refers_to"], date,
                )
                out.write(deflate.compress(data))
                records, size = records + 1, size + len(data)
                if size >= archive_bytes:
                    out.write(deflate.flush())
                    out.close()
                    out = None
                    yield _manifest(f"{folder}/{name}", records)
        if out is not None:
            out.write(deflate.flush())
            out.close()
            yield _manifest(f"{folder}/{name}", records)

    return rows.mapInArrow(run, "archive string, records long")


def _manifest(archive: str, records: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"archive": [archive], "records": pa.array([records], pa.int64())})


class Inflated:
    """The inflated bytes of a gzip stream of one or more members, read once and in pieces."""

    def __init__(self, raw: BinaryIO) -> None:
        self._raw, self._inflate, self._buffer = raw, zlib.decompressobj(_GZIP), bytearray()

    def _more(self) -> bool:
        while True:
            data = self._inflate.unconsumed_tail or self._inflate.unused_data
            if self._inflate.eof:
                data = data or self._raw.read(PIECE)
                if not data.strip(b"\0"):
                    return False
                self._inflate = zlib.decompressobj(_GZIP)
            data = data or self._raw.read(PIECE)
            if not data:
                raise EOFError("the gzip stream is cut off")
            found = self._inflate.decompress(data, PIECE)
            if found:
                self._buffer += found
                return True

    def head(self) -> bytes | None:
        """Bytes up to and with the next empty line; None at the end."""
        while (end := self._buffer.find(b"\r\n\r\n")) < 0:
            if len(self._buffer) > PIECE:
                raise ValueError("a record's head is longer than 1 MiB")
            if not self._more():
                if self._buffer.strip():
                    raise EOFError("the last record is cut off")
                return None
        return self._take(end + 4)

    def pieces(self, count: int) -> Iterator[bytes]:
        """The next `count` bytes."""
        while count:
            if not self._buffer and not self._more():
                raise EOFError("a record's block is cut off")
            data = self._take(min(count, len(self._buffer)))
            count -= len(data)
            yield data

    def _take(self, count: int) -> bytes:
        data = bytes(self._buffer[:count])
        del self._buffer[:count]
        return data


def fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:]) if value}


def normalise_stream(raw: BinaryIO, out: BinaryIO, index: BinaryIO, level: int = 6) -> tuple[int, str | None]:
    """Rewrite one archive; how many whole records it has, and what ended it early."""
    stream, offset, records = Inflated(raw), 0, 0
    try:
        while (head := stream.head()) is not None:
            head = head.lstrip(b"\r\n")
            if not head.startswith(b"WARC/"):
                raise ValueError("no record begins where one should")
            known = fields(head)
            deflate = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
            length = out.write(deflate.compress(head)) or 0
            for piece in stream.pieces(int(known["content-length"])):
                length += out.write(deflate.compress(piece)) or 0
            ended = b"".join(stream.pieces(4))
            if ended != b"\r\n\r\n":
                raise ValueError("a record is not ended by two line breaks")
            length += out.write(deflate.compress(ended) + deflate.flush())
            line = {
                "offset": offset, "length": length, "type": known.get("warc-type"), "id": known.get("warc-record-id"),
                "target": known.get("warc-target-uri"), "digest": known.get("warc-payload-digest"),
            }
            index.write(json.dumps(line).encode() + b"\n")
            offset, records = offset + length, records + 1
    except (EOFError, ValueError, KeyError, zlib.error) as fault:
        return records, f"{type(fault).__name__}: {fault}"
    return records, None


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """archive, normalised, index, records and error of every archive named in column `archive`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_folder(folder)
        files.create_dir(base, recursive=True)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                source, path = open_folder(archive)
                name = f"{uuid.uuid4().hex}.warc.gz"
                with (
                    source.open_input_stream(path, compression=None) as raw,
                    files.open_output_stream(f"{base}/{name}", compression=None) as out,
                    files.open_output_stream(f"{base}/{name}.idx", compression=None) as index,
                ):
                    records, error = normalise_stream(raw, out, index, level)
                yield pa.RecordBatch.from_pydict({
                    "archive": [archive], "normalised": [f"{folder}/{name}"], "index": [f"{folder}/{name}.idx"],
                    "records": pa.array([records], pa.int64()), "error": pa.array([error], pa.string()),
                })

    return _one_task_each(archives.select("archive")).mapInArrow(
        run, "archive string, normalised string, index string, records long, error string"
    )


def _one_task_each(names: DataFrame) -> DataFrame:
    """File names dealt out, so that files are worked on side by side; the names are few and small."""
    slots = 4 * names.sparkSession.sparkContext.defaultParallelism
    return names.repartition(slots)


_RECORD_TYPES = pa.schema([
    ("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()),
])


def read_records(normalised: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of normalised archives, read at the offsets of the sidecar index.

    Length and digest are counted from the stored payload of a response, and taken from the head of a revisit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                source, at = open_folder(path)
                with source.open_input_file(at) as data, source.open_input_stream(open_folder(index)[1], compression=None) as lines:
                    rows = []
                    for entry in _lines(lines):
                        data.seek(entry["offset"])
                        rows.append(_record(zlib.decompress(data.read(entry["length"]), _GZIP), payloads))
                        if len(rows) >= (64 if payloads else 2048):
                            yield _records(rows)
                            rows = []
                    if rows:
                        yield _records(rows)

    names = _one_task_each(normalised.select("normalised", "index"))
    out = names.mapInArrow(
        run, "record_id string, url string, record_type string, payload_bytes long, payload_digest string, "
        "refers_to string, payload binary",
    )
    return out if payloads else out.drop("payload")


def _lines(stream: BinaryIO) -> Iterator[dict]:
    rest = b""
    while piece := stream.read(PIECE):
        *whole, rest = (rest + piece).split(b"\n")
        yield from map(json.loads, whole)


def _record(data: bytes, payloads: bool) -> tuple:
    head, _, block = data.partition(b"\r\n\r\n")
    known = fields(head)
    http, _, rest = block[: int(known["content-length"])].partition(b"\r\n\r\n")
    names = (known["warc-record-id"], known.get("warc-target-uri"), known["warc-type"])
    if known["warc-type"] == "revisit":
        digest = base64.b32decode(known["warc-payload-digest"].removeprefix("sha1:")).hex()
        return (_name(names[0]), *names[1:], int(fields(http)["content-length"]), digest, _name(known["warc-refers-to"]), None)
    return (_name(names[0]), *names[1:], len(rest), hashlib.sha1(rest).hexdigest(), None, rest if payloads else None)


def _name(urn: str) -> str | None:
    from urllib.parse import unquote

    name = unquote(urn.removeprefix("<urn:record:").removesuffix(">"))
    return None if name == "null" else name


def _records(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RECORD_TYPES.types)], schema=_RECORD_TYPES)


def archive_folder(spark: SparkSession) -> str:
    """A new folder in the shared one for the archives of a job."""
    return f"{stage_folder(spark)}/warc-{uuid.uuid4().hex}"
