"""Web archives: written, normalised to one gzip member per record, read by index.

An archive compressed as one stream can be read from its start only. The
normaliser inflates such a file once, piece by piece, writes every record as a
gzip member of its own and, beside the archive, a line per member with offset,
length, type and record id. Members are then read at their offsets. Archives lie
in the shared folder and are opened through pyarrow's file systems, so executors
need no local files; a task that runs twice writes other files, and only those of
the attempt that counts are listed in the resulting table.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexfold.llm.common import shared_dir, written

READ_BYTES = 1 << 18
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(place: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or an absolute path."""
    return fs.FileSystem.from_uri(place)


def warc_record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, payload: bytes) -> bytes:
    """One record; the block of a revisit holds the HTTP head alone."""
    block = HTTP + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parsed(head: bytes) -> dict[str, str]:
    """Header fields of a record, names in lower case."""
    fields = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in fields if name.strip()}


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, whole record) of every record in a stream of bytes; one record is held."""
    held = bytearray()
    pieces = iter(pieces)
    while True:
        while (at := held.find(b"\r\n\r\n")) < 0:
            piece = next(pieces, None)
            if piece is None:
                if held.strip():
                    raise ValueError("the archive ends inside a record's head")
                return
            held += piece
        fields = parsed(bytes(held[:at]))
        end = at + 4 + int(fields["content-length"]) + 4
        while len(held) < end:
            piece = next(pieces, None)
            if piece is None:
                raise ValueError("the archive ends inside a record")
            held += piece
        yield fields, bytes(held[:end])
        del held[:end]


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, piece by piece."""
    stream = zlib.decompressobj(31)
    while chunk := source.read(READ_BYTES):
        while chunk:
            piece = stream.decompress(chunk, 4 * READ_BYTES)
            if piece:
                yield piece
            if stream.eof:
                chunk, stream = stream.unused_data, zlib.decompressobj(31)
            else:
                chunk = stream.unconsumed_tail
    if rest := stream.flush():
        yield rest


def deflated(data: bytes, level: int) -> bytes:
    """``data`` as one gzip member without a time stamp."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, place: str, archive_bytes: int = 64 << 20, level: int = 1) -> DataFrame:
    """(archive, records): archives of one gzip stream each, with all rows of ``pages``
    (page_id, url, html, record_type, refers_to, digest)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(place)
        out, n, size = None, 0, 0
        for batch in batches:
            texts = batch.column("html").cast(pa.large_binary())
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "record_type", "refers_to", "digest")]
            for row, (page, url, kind, refers, digest) in enumerate(zip(*columns)):
                if out is None:
                    name = f"{base}/{uuid.uuid4().hex}.mono.warc.gz"
                    out, packer, n, size = store.open_output_stream(name, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                data = warc_record(page, url, kind, refers, digest, texts[row].as_py() or b"")
                out.write(packer.compress(data))
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.write(packer.flush())
                    out.close()
                    yield pa.RecordBatch.from_pydict({"archive": [name], "records": [n]})
                    out = None
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": [n]})

    store, base = opened(place)
    store.create_dir(base, recursive=True)
    return written(pages.select("page_id", "url", "html", "record_type", "refers_to", "digest").mapInArrow(write, "archive string, records long"))


def normalise(archives: DataFrame, place: str, level: int = 4) -> DataFrame:
    """(archive, index, records): every archive rewritten with a member per record, and its
    sidecar of lines "offset length type record-id"."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(place)
        for batch in batches:
            for source in batch.column("archive").to_pylist():
                name = f"{base}/{uuid.uuid4().hex}"
                offset, n = 0, 0
                with (
                    store.open_input_stream(source, compression=None) as whole,
                    store.open_output_stream(name + ".warc.gz", compression=None) as out,
                    store.open_output_stream(name + ".idx", compression=None) as index,
                ):
                    for fields, record in records(inflated(whole)):
                        member = deflated(record, level)
                        out.write(member)
                        index.write(f"{offset} {len(member)} {fields['warc-type']} {fields['warc-record-id']}\n".encode())
                        offset, n = offset + len(member), n + 1
                yield pa.RecordBatch.from_pydict({"archive": [name + ".warc.gz"], "index": [name + ".idx"], "records": [n]})

    files = 2 * max(archives.count(), 1)
    return written(archives.select("archive").repartition(files, "archive").mapInArrow(rewrite, "archive string, index string, records long"))


def read_indexed(normalised: DataFrame, place: str, with_payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, refers_to, digest, payload_bytes, payload): the records at
    the offsets of the sidecars; of revisits, payload and payload_bytes are null."""
    shape = "page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long, payload binary"

    def number(urn: str | None) -> int | None:
        return int(urn.removeprefix("<urn:page:").removesuffix(">")) if urn and urn != "<urn:page:>" else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opened(place)
        types = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                           ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for archive, index in zip(batch.column("archive").to_pylist(), batch.column("index").to_pylist()):
                with store.open_input_stream(index, compression=None) as lines, store.open_input_file(archive) as members:
                    rows, held = [], 0
                    for line in lines.read().decode().splitlines():
                        offset, length, kind, _ = line.split(" ", 3)
                        record = zlib.decompress(members.read_at(int(length), int(offset)), 31)
                        head, _, rest = record.partition(b"\r\n\r\n")
                        fields = parsed(head)
                        payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")[2]
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"the payload of {fields['warc-record-id']} differs from its digest")
                        url = fields.get("warc-target-uri")
                        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%") if url is not None else None
                        own = kind == "response"
                        rows.append({
                            "page_id": number(fields["warc-record-id"]), "url": url, "record_type": kind, "refers_to": number(fields.get("warc-refers-to")),
                            "digest": digest, "payload_bytes": len(payload) if own else None, "payload": payload if own and with_payload else None,
                        })
                        held += len(payload)
                        if len(rows) >= 10_000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, types)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, types)

    files = 2 * max(normalised.count(), 1)
    return normalised.select("archive", "index").repartition(files, "archive").mapInArrow(read, shape)


def revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """``pages`` (page_id, url, html) with digest, record_type and refers_to.

    Of rows with equal payloads of at least ``least_bytes``, that with the largest
    page_id is the response, repeated rows of it too; the others revisit it. A null html
    is an empty payload; a null page_id revisits, unless all of its copies have none.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(body).alias("digest"), F.octet_length(body).alias("n"))
    latest = pages.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("latest"), F.count("*").alias("copies"))
    latest = written(latest.where("copies > 1 and latest is not null").select("digest", "latest"))
    again = F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    return pages.join(latest, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("latest")).alias("refers_to")
    )


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all ``pages``, as
    read back from normalised archives.

    Length and digest of a revisit are those of the payload it refers to, found by the
    response's id. Every row gives one row, repeated ones too; an empty table none.
    """
    place = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    normalised = normalise(write_archives(revisits(pages), place), place)
    found = written(read_indexed(normalised, place, with_payload=False).drop("payload", "url"))
    full = found.where("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), "digest", F.col("payload_bytes").alias("full_bytes")
    )
    again = found.where("record_type = 'revisit'").join(full.dropDuplicates(["refers_to", "digest"]), ["refers_to", "digest"])
    columns = ["page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"]
    return found.where("record_type = 'response'").select(columns).unionByName(again.withColumn("payload_bytes", F.col("full_bytes")).select(columns))
