"""WARC archives: writing pages as records, one gzip member each, and a sequential reader.

The reader takes archives in chunks, inflates member after member incrementally, cuts the record by its Content-Length, and
verifies block and payload digests. Archives are files in a folder that all machines share; the list of them is a table,
so files of failed or repeated tasks are never read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeline.llm.common import map_arrow, materialise, scratch_path, shuffle_parts, slices, small

#: Smaller payloads are always stored whole.
REVISIT_FROM = 100
ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 18
LEVEL = 6
WHEN = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BrokenRecord(ValueError):
    """A member that is no whole, well-framed record with matching digests."""


def _uri(url: str | None, page: str) -> str:
    return re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page}"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One gzip member. A revisit has the head of the response only."""
    page = "null" if page_id is None else str(page_id)
    digest = hashlib.sha256(payload).hexdigest()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Date: {WHEN}",
        f"WARC-Target-URI: {_uri(url, page)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[2:2] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'null' if refers_to is None else refers_to}>"]
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n") + deflate.flush()


def members(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """The contents of the gzip members of a stream, read and inflated a chunk at a time."""
    inflate, out, waiting, begun = zlib.decompressobj(31), bytearray(), b"", False
    while True:
        data = waiting or stream.read(chunk)
        if not data:
            if begun:
                raise BrokenRecord("the archive ends within a member")
            return
        waiting, begun = b"", True
        try:
            out += inflate.decompress(data)
        except zlib.error as e:
            raise BrokenRecord(f"a member cannot be inflated: {e}") from e
        if inflate.eof:
            waiting = inflate.unused_data
            yield bytes(out)
            inflate, out, begun = zlib.decompressobj(31), bytearray(), False


def parse(raw: bytes) -> dict:
    """The fields of one record; raises BrokenRecord where framing or a digest is wrong."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith("WARC/1."):
        raise BrokenRecord("no WARC head")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    try:
        size = int(fields["content-length"])
    except (KeyError, ValueError) as e:
        raise BrokenRecord("no content length") from e
    block = rest[:size]
    if len(block) < size or rest[size:] != b"\r\n\r\n":
        raise BrokenRecord("the block is not of the stated length")
    if fields.get("warc-block-digest", "") != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise BrokenRecord("the block does not match its digest")
    http, mark, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?mi)^content-length: *([0-9]+)", http)
    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if not mark or not length:
        raise BrokenRecord("no HTTP head")
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(length[1])):
        raise BrokenRecord("the payload does not match its digest or length")
    page, refers = (re.fullmatch(r"<urn:page:(-?[0-9]+)>", fields.get(f, "")) for f in ("warc-record-id", "warc-refers-to"))
    return {
        "page_id": int(page[1]) if page else None,
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "payload_digest": digest,
        "payload_bytes": int(length[1]),
        "refers_to": int(refers[1]) if refers else None,
        "payload": payload if kind == "response" else None,
    }


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size, count, made = None, "", 0, 0, []
        target, root = fs.FileSystem.from_uri(folder)

        def close():
            out.close()
            made.append((path, count, size))

        for batch in slices(batches, "html"):
            for page, url, html, refers, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "revisit")), strict=True):
                if out is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    target.create_dir(root, recursive=True)
                    out, path, size, count = target.open_output_stream(f"{root}/{name}", compression=None), f"{folder}/{name}", 0, 0
                raw = record(page, url, (html or "").encode(), refers, revisit)
                out.write(raw)
                size, count = size + len(raw), count + 1
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        columns = list(zip(*made, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record for every row of pages(page_id, url, html) and return the list of archives (path, records, bytes).

    Of equal payloads of at least REVISIT_FROM bytes the row with the smallest page_id is a response, all rows with another
    id revisit it; smaller payloads are all responses. Null html is an empty payload; a null page_id stays null, and is a
    response only where no equal payload has an id. Rows repeated in full are written each. Other columns do not matter.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    rows = rows.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
    large = F.coalesce(F.octet_length("html"), F.lit(0)) >= REVISIT_FROM
    firsts = rows.filter(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    firsts = materialise(firsts.select("digest", "first"), "payloads")
    marked = rows.join(small(firsts), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = marked.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    return materialise(map_arrow(marked, _write(folder), "path string, records long, bytes long"), "archives")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    for batch in batches:
        for path in batch.column("path").to_pylist():
            source, name = fs.FileSystem.from_uri(path)
            held, size = [], 0
            with source.open_input_stream(name, compression=None) as stream:
                for k, raw in enumerate(members(stream)):
                    try:
                        held.append(parse(raw))
                    except BrokenRecord as e:
                        raise BrokenRecord(f"{path}, record {k}: {e}") from e
                    size += len(raw)
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of the listed archives (a table with their path), in any order: page_id, url, record_type,
    payload_digest, payload_bytes, refers_to and payload (null for revisits). A broken archive stops the job."""
    paths = archives.select("path").repartition(shuffle_parts(archives.sparkSession), "path")
    return map_arrow(paths, _read, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")
