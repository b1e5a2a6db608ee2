"""WARC archives: written as one gzip stream each, normalised to one member per record, read back.

1. ``write`` stores records in archives that are a single gzip stream, as many
   crawlers leave them. Nothing in such a file can be read without all that is before.
2. ``normalise`` inflates each stream once, front to back, rewrites every record as a
   gzip member of its own and writes a sidecar index of record, offset and length.
3. ``read`` goes by the index: each record is inflated on its own.

Files are written by tasks into the shared folder, under a temporary name first and
then moved: a task that runs again after a lost executor replaces its own files with
equal ones. Only lists of paths pass through Spark between the steps. Records are the
unit of memory; archives are streamed.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.llm.tables import kept, new_folder, whole_text

ARCHIVE_BYTES = 64_000_000  # of records, before compression
RECORD = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"
_CHUNK = 1 << 20
_LEVEL = 3
_DATE = "2000-01-01T00:00:00Z"  # the same in every run, so that files are
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAX_TASKS = 10_000


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or URI (file, hdfs, s3, gs, ...) and the path in it."""
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record; a revisit has the HTTP header of the page but not its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head += [f"WARC-Record-ID: <urn:page:{_line(page_id)}>"] if page_id is not None else ["WARC-Record-ID: <urn:page>"]
    head += [f"WARC-Target-URI: {_line(url)}"] if url is not None else []
    head += [f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{_line(refers_to)}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _line(value: str) -> str:
    """Header values can't hold line ends; those are written as in a URI."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A").replace(">", "%3E")


def _unline(value: str) -> str:
    return value.replace("%3E", ">").replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse(data: bytes) -> tuple:
    """The row of one record; payload size and digest are of the payload where the record has it."""
    head, _, block = data.partition(b"\r\n\r\n")
    found = headers(head)
    block = block[: int(found["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = found["warc-type"] == "revisit"
    size = int(headers(http)["content-length"]) if revisit else len(payload)
    digest = found["warc-payload-digest"].removeprefix("sha1:") if revisit else base32_sha1(payload)
    page, origin = found["warc-record-id"], found.get("warc-refers-to")
    return (
        _unline(page[len("<urn:page:") : -1]) if page != "<urn:page>" else None,
        size,
        digest,
        found["warc-type"],
        _unline(origin[len("<urn:page:") : -1]) if origin else None,
    )


def records_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a gzip stream (one member or many) given in chunks, each inflated once."""
    held, need = bytearray(), -1
    for piece in _inflated(chunks):
        held += piece
        start = 0
        while True:
            if need < 0:
                cut = held.find(b"\r\n\r\n", start)
                if cut < 0:
                    break
                need = cut + 4 - start + int(headers(bytes(held[start:cut]))["content-length"]) + 4
            if len(held) - start < need:
                break
            yield bytes(held[start : start + need])
            start, need = start + need, -1
        del held[:start]
    if held:
        raise ValueError("the archive ends within a record")


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    stream = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            if stream.eof:
                stream = zlib.decompressobj(31)
            yield stream.decompress(chunk)
            chunk = stream.unused_data
    if not stream.eof:
        raise ValueError("the gzip stream is cut off")


def _chunks(system: fs.FileSystem, path: str) -> Iterator[bytes]:
    with system.open_input_stream(path, compression=None) as file:
        while chunk := file.read(_CHUNK):
            yield chunk


class _NewFile:
    """Written under a name of this attempt, then moved to its place."""

    def __init__(self, system: fs.FileSystem, path: str) -> None:
        self.system, self.path = system, path
        self.draft = f"{path}.{TaskContext.get().taskAttemptId()}.part"
        self.file = system.open_output_stream(self.draft, compression=None)

    def done(self) -> None:
        self.file.close()
        self.system.move(self.draft, self.path)


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``page_id, url, html, refers_to`` (strings) as archives; returns their ``path`` and ``records``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = store(folder)
        system.create_dir(base, recursive=True)
        part, made = TaskContext.get().partitionId(), 0
        out = packer = None
        size = n = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")]
            for page_id, url, html, refers_to in zip(*columns):
                if out is None:
                    out = _NewFile(system, f"{base}/part-{part:06d}-{made:05d}.warc.gz")
                    packer, size, n = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31), 0, 0
                data = record(page_id, url, html, refers_to)
                out.file.write(packer.compress(data))
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    yield _closed(out, packer, n)
                    out, made = None, made + 1
        if out is not None:
            yield _closed(out, packer, n)

    def _closed(out: _NewFile, packer, n: int) -> pa.RecordBatch:
        out.file.write(packer.flush())
        out.done()
        return pa.RecordBatch.from_arrays([pa.array([out.path.rpartition("/")[2]]), pa.array([n], pa.int64())], ["path", "records"])

    return kept(pages.mapInArrow(run, "path string, records bigint"), "archives")


def _spread(files: DataFrame) -> DataFrame:
    """One task for each file, up to a limit; the list itself is a small table."""
    return files.repartition(max(1, min(files.count(), _MAX_TASKS)))


def normalise(files: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite each archive of ``files`` in ``target`` with a member per record and an index beside it.

    Index lines: offset, length, type and id of a record, tab-separated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (system, base), (_, to) = store(source), store(target)
        system.create_dir(to, recursive=True)
        for batch in batches:
            counts = []
            for name in batch.column("path").to_pylist():
                out, index = _NewFile(system, f"{to}/{name}"), _NewFile(system, f"{to}/{name}.idx")
                offset = n = 0
                for data in records_of(_chunks(system, f"{base}/{name}")):
                    packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
                    member = packer.compress(data) + packer.flush()
                    out.file.write(member)
                    found = headers(data[: data.find(b"\r\n\r\n")])
                    index.file.write(f"{offset}\t{len(member)}\t{found['warc-type']}\t{found['warc-record-id']}\n".encode())
                    offset, n = offset + len(member), n + 1
                index.done()
                out.done()
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(counts, pa.int64())], ["path", "records"])

    return kept(_spread(files.select("path")).mapInArrow(run, "path string, records bigint"), "normalised")


def read(files: DataFrame, folder: str) -> DataFrame:
    """The rows of all records, each found by its index entry and inflated on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = store(folder)
        names = [x.strip().split(" ")[0] for x in RECORD.split(",")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with system.open_input_stream(f"{base}/{name}.idx") as file:
                    entries = [x.split("\t") for x in file.read().decode().split("\n") if x]
                with system.open_input_file(f"{base}/{name}") as file:
                    for at in range(0, len(entries), 1000):
                        rows = []
                        for offset, length, *_ in entries[at : at + 1000]:
                            file.seek(int(offset))
                            rows.append(parse(zlib.decompress(file.read(int(length)), 31)))
                        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                        yield pa.RecordBatch.from_arrays(columns, names)

    return _spread(files.select("path")).mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the pages, normalise the archives, read them back: one row per page.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``. Of equal payloads
    of at least ``least_bytes`` bytes the smallest ``page_id`` is the response, the
    others revisit it; null html is an empty payload. Rows that repeat both the smallest
    id and the payload are all responses. Null ids revisit unless no equal payload has
    an id. Null urls leave their header out. Other columns are ignored; no pages: no rows.
    """
    spark = pages.sparkSession
    payload = whole_text("html").cast("binary")
    marks = pages.select("page_id", F.sha2(payload, 256).alias("mark"), F.octet_length(payload).alias("bytes"))
    first = kept(
        marks.filter(F.col("bytes") >= least_bytes)
        .groupBy("mark")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 and first is not null")
        .select("mark", "first"),
        "repeated-payloads",
    )
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("html"), F.sha2(payload, 256).alias("mark"))
    again = ~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull()
    rows = rows.join(first, "mark", "left").select(
        F.col("page_id").cast("string").alias("page_id"),
        "url",
        "html",
        F.when(again, F.col("first")).cast("string").alias("refers_to"),
    )
    streams, members = new_folder(spark, "streams"), new_folder(spark, "members")
    read_back = read(normalise(write(rows, streams, archive_bytes), streams, members), members)
    kind = pages.schema["page_id"].dataType
    return read_back.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
