"""WARC archives: writing, the normaliser of monolithic gzip files, and reading by index.

A monolithic archive is one gzip stream over all its records, which nothing can seek in. The normaliser inflates it once, as a stream,
rewrites every record as a gzip member of its own and writes a sidecar index of where each member lies. Readers then
fetch single members. The functions on file objects do the work; the functions on frames run them on the executors, over archives
of bounded size that are files of a shared store. A task holds one record at a time. Its files carry the number of the attempt, and
only those of attempts that ended well are named in the frames, so that a lost executor costs a retry and never half a file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace, small_batches

#: Payload bytes after which a writing task begins another archive.
ARCHIVE_BYTES = 16 << 20
#: Fixed value: what WARC-Date says where a page has no date.
DATE = "2024-01-01T00:00:00Z"
LEVEL, GZIP = 4, 31
CHUNK = 1 << 16
#: Rows of an Arrow batch: payloads may be large.
ROWS = 128


def _clean(value: str) -> str:
    """A header value without line breaks."""
    return "".join(c if c not in "\r\n" else "%0D" if c == "\r" else "%0A" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or (refers_to given) a revisit with the HTTP headers alone.

    ``size`` and ``digest`` (SHA-1 in hex) are those of the full payload, which a revisit need not be given.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


class _Inflated:
    """A gzip file as a stream of plain bytes, whatever number of members it has; a chunk at a time is held."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.z, self.held, self.rest = raw, zlib.decompressobj(GZIP), bytearray(), b""

    def more(self) -> bool:
        """Inflate another chunk; False at the end."""
        data = self.rest or self.raw.read(CHUNK)
        if not data:
            return False
        self.rest = b""
        self.held += self.z.decompress(data)
        if self.z.eof:
            self.rest, self.z = self.z.unused_data, zlib.decompressobj(GZIP)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before and with ``mark``; None at the end of the file."""
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self.more():
                if self.held.strip():
                    raise ValueError("the archive ends within a record's head")
                return None
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def records(raw: BinaryIO) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, head bytes, block) of every record of a gzip archive, monolithic or not."""
    stream = _Inflated(raw)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        fields = _headers(head)
        block = stream.take(int(fields.get("content-length", 0)))
        stream.take(4)
        yield fields, head, block


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
    return z.compress(data) + z.flush()


def _hex_digest(fields: dict[str, str]) -> str | None:
    value = fields.get("warc-payload-digest", "").partition(":")[2]
    return base64.b32decode(value).hex() if len(value) == 32 else value.lower() or None


def normalise(raw: BinaryIO, out: BinaryIO) -> Iterator[dict]:
    """Rewrite an archive as a member for each record; yields the index rows: offset, length, record_id, type, digest."""
    at = 0
    for fields, head, block in records(raw):
        data = member(head + block + b"\r\n\r\n")
        out.write(data)
        yield {"offset": at, "length": len(data), "record_id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "digest": _hex_digest(fields)}
        at += len(data)


def read_member(archive: BinaryIO, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """(headers, block) of the record whose member lies there; nothing else of the archive is read."""
    archive.seek(offset)
    data = zlib.decompress(archive.read(length), GZIP)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _headers(head)
    return fields, rest[: int(fields["content-length"])]


def page_of(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


# on frames --------------------------------------------------------------------------------------------------------------


def store_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI, as executors open them: shared mounts, HDFS and object stores."""
    if uri.startswith("file:") or ":" not in uri:
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri("s3://" + uri.partition("://")[2] if uri.startswith(("s3a://", "s3n://")) else uri)


def _attempt(stem: str, end: str) -> str:
    return f"{stem}-{TaskContext.get().taskAttemptId()}{end}"


def _write(batches: Iterator[pa.RecordBatch], location: str, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    fs, root = store_of(location)
    part, number, size, n, out, z, uri = TaskContext.get().partitionId(), 0, 0, 0, None, None, ""

    def done() -> pa.RecordBatch:
        out.write(z.flush())
        out.close()
        return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], names=["archive", "n_records"])

    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "n", "digest", "refers_to")), strict=True):
            page_id, url, html, length, digest, refers_to = (x.as_py() for x in row)
            if out is None:
                name = _attempt(f"pages-{part:06d}-{number:06d}", ".warc.gz")
                fs.create_dir(root, recursive=True)
                z, uri, size, n = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), f"{location}/{name}", 0, 0
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), length, digest, refers_to)
            out.write(z.compress(data))
            size, n = size + len(data), n + 1
            if size >= archive_bytes:
                yield done()
                out, number = None, number + 1
    if out is not None:
        yield done()


def write_archives(pages: DataFrame, location: str, min_bytes: int = 1000, archive_bytes: int = ARCHIVE_BYTES, ws: Workspace | None = None) -> DataFrame:
    """(archive, n_records): monolithic archives, written to the folder ``location`` when the frame is computed.

    There is a record for each row of ``pages`` (page_id, url, html). Payloads are equal that have equal lengths and SHA-256 digests.
    Groups of equal payloads meet as keys alone, without their bytes; rows then find their answer by id and digest, which no group shares.
    With a workspace the revisits are written first, so that Spark knows their size before it decides how pages are joined to them.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("same"), F.octet_length(body).cast("long").alias("n"))
    keys = rows.where(F.col("n") >= min_bytes).select("page_id", "same", "n")
    # equal payloads of some size: the largest page_id answers for all
    answers = keys.groupBy("same", "n").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("c")).where("c > 1 and refers_to is not null").drop("c")
    revisits = keys.join(answers, ["same", "n"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("id"), F.col("same").alias("of"), "refers_to").distinct()
    revisits = ws.table(revisits, "revisits") if ws else revisits
    joined = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("same") == F.col("of")), "left")
    joined = joined.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "n", F.sha1(body).alias("digest"), "refers_to")
    return joined.mapInArrow(lambda it: _write(it, location, archive_bytes), "archive string, n_records long")


def _normalise(batches: Iterator[pa.RecordBatch], location: str) -> Iterator[pa.RecordBatch]:
    fs, root = store_of(location)
    for batch in batches:
        for uri in batch.column("archive").to_pylist():
            source, path = store_of(uri)
            name = _attempt(uri.rpartition("/")[2].removesuffix(".warc.gz"), ".warc.gz")
            fs.create_dir(root, recursive=True)
            with source.open_input_file(path) as raw, fs.open_output_stream(f"{root}/{name}", compression=None) as out, fs.open_output_stream(f"{root}/{name}.idx", compression=None) as index:
                for entry in normalise(raw, out):
                    index.write(json.dumps(entry).encode() + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([f"{location}/{name}"]), pa.array([f"{location}/{name}.idx"])], names=["archive", "sidecar"])


def _spread(named: DataFrame) -> DataFrame:
    """A row of file names a task, as far as there are rows."""
    return named.repartition(max(1, min(named.count(), 100_000)), "archive")


def normalise_archives(archives: DataFrame, location: str) -> DataFrame:
    """(archive, sidecar) of rows with the URI of an ``archive``, monolithic or not; both files are written to the folder ``location``.

    A sidecar has a JSON line for every record: offset, length, record_id, type, digest.
    """
    return _spread(archives.select("archive")).mapInArrow(lambda it: _normalise(it, location), "archive string, sidecar string")


READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("intact", pa.bool_())])


def _records_at(archive: str, sidecar: str) -> Iterator[tuple]:
    (fs, path), (side, at) = store_of(archive), store_of(sidecar)
    with fs.open_input_file(path) as data, side.open_input_stream(at, compression=None) as index:
        for line in _lines(index):
            entry = json.loads(line)
            fields, block = read_member(data, entry["offset"], entry["length"])
            http, _, payload = block.partition(b"\r\n\r\n")
            size, digest, intact = int(_headers(http)["content-length"]), _hex_digest(fields), True
            if fields["warc-type"] == "response":
                own = hashlib.sha1(payload).hexdigest()
                intact = own == digest and len(payload) == size
                size, digest = len(payload), own
            yield page_of(fields.get("warc-record-id")), size, digest, fields["warc-type"], page_of(fields.get("warc-refers-to")), archive, entry["offset"], intact


def _lines(stream: BinaryIO) -> Iterator[bytes]:
    held = b""
    while chunk := stream.read(CHUNK):
        *full, held = (held + chunk).split(b"\n")
        yield from full
    if held:
        yield held


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), READ, strict=True)], schema=READ)

    rows: list[tuple] = []
    for batch in batches:
        for archive, sidecar in zip(batch.column("archive").to_pylist(), batch.column("sidecar").to_pylist(), strict=True):
            for row in _records_at(archive, sidecar):
                rows.append(row)
                if len(rows) == 4096:
                    yield batch_of(rows)
                    rows = []
    if rows:
        yield batch_of(rows)


def read_archives(normalised: DataFrame) -> DataFrame:
    """A row for every record, fetched by its offset: page_id, payload_bytes, payload_digest, record_type, refers_to, archive, offset, intact."""
    return _spread(normalised.select("archive", "sidecar")).mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, intact boolean")


def round_trip(pages: DataFrame, min_bytes: int = 1000, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise these, and read every record back through the sidecars.

    A row for each row of ``pages``. Null html is an empty payload, a null url leaves its header out, a null page_id is
    carried as null and is never preferred as the response. Of records with equal payloads of at least ``min_bytes`` the one
    with the largest page_id is the response and the others revisit it; rows that repeat that page_id and payload are
    responses too, and where all page_ids are null all are responses. A revisit's size and digest are those of the full payload, from
    its headers. An empty table gives no rows; other columns are not read. The archives are in the shared folder while this runs and
    go when it has been read back; ``write_archives`` and ``normalise_archives`` alone leave theirs where they are told to.
    """
    with Workspace(pages.sparkSession) as ws, small_batches(pages.sparkSession, ROWS):
        archives = ws.table(write_archives(pages, ws.path("monolithic-files"), min_bytes, archive_bytes, ws), "monolithic")
        normalised = ws.table(normalise_archives(archives, ws.path("normalised-files")), "normalised")
        return ws.result(read_archives(normalised))
