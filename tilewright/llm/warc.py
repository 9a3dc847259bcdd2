"""WARC archives of pages: written as whole-file gzip streams, normalised, and read back.

``write_archives`` makes files that are one gzip stream each, as crawlers often leave them: to
reach a record, everything before it must be inflated. ``normalise`` inflates such a file
once, rewrites every record as a gzip member of its own and puts an index of offsets next to
the file. ``read_archives`` then reads single members by that index.

Tasks hold one record at a time. Files lie in a folder that all executors share, under names
no other attempt of a task uses; only files named in a written table count, so a lost
executor leaves at most files that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import columns_of, whole_text
from tilewright.session import shared_folder, shuffle_slots, write_table

#: Fixed values of the format (WARC 1.1).
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payload bytes from which equal payloads are revisits, and bytes of records in one file.
REVISIT_BYTES = 1000
FILE_BYTES = 32_000_000
CHUNK = 1 << 20


def head(first: bytes, fields: list[tuple[str, object]]) -> bytes:
    """A start line and named fields, up to the empty line; fields that are None are left out."""
    lines = [f"{k}: {v}".encode() for k, v in fields if v is not None]
    return b"\r\n".join([first, *lines]) + b"\r\n\r\n"


def fields_of(data: bytes) -> dict[str, str]:
    pairs = (line.split(b":", 1) for line in data.split(b"\r\n")[1:] if b":" in line)
    return {k.strip().lower().decode(): v.strip().decode() for k, v in pairs}


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str) -> bytes:
    """One record. A revisit has the same HTTP head, with the payload's length, but no payload."""
    safe = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode()).decode() if url is not None else None
    block = head(b"HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))])
    if kind == "response":
        block += payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = lambda n: f"<urn:page:{'' if n is None else n}>"
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", safe),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", REVISIT if kind == "revisit" else None),
        ("WARC-Refers-To", name(refers_to) if kind == "revisit" else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return head(VERSION, fields) + block + b"\r\n\r\n"


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Content of a gzip file, of one member or many."""
    unzip = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            if data := unzip.decompress(chunk, 4 * CHUNK):
                yield data
            if unzip.eof:
                chunk, unzip = unzip.unused_data, zlib.decompressobj(31)
            else:
                chunk = unzip.unconsumed_tail


def records(parts: Iterator[bytes]) -> Iterator[tuple[bytes, bytes, bytes]]:
    """Whole bytes, head and block of each record of an inflated stream."""
    held = bytearray()
    parts = iter(parts)

    def fill(n: int) -> bool:
        while len(held) < n:
            part = next(parts, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill(len(held) + 1):
                if bytes(held).strip():
                    raise ValueError("the archive ends inside a record head")
                return
        first = bytes(held[:end])
        length = int(fields_of(first)["content-length"])
        size = end + 4 + length + 4
        if not fill(size):
            raise ValueError("the archive ends inside a record")
        whole = bytes(held[:size])
        del held[:size]
        yield whole, first, whole[end + 4 : end + 4 + length]


def parsed(first: bytes, block: bytes) -> dict:
    """What a record says of its page; a response's payload must match its digest and length."""
    fields = fields_of(first)
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda v: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", v or "")) else None
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
    size = int(fields_of(http)["content-length"])
    if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    return {
        "page_id": number(fields["warc-record-id"]),
        "payload_bytes": size,
        "payload_digest": digest.hex(),
        "record_type": fields["warc-type"],
        "refers_to": number(fields.get("warc-refers-to")),
        "payload": payload if fields["warc-type"] == "response" else None,
    }


def opened(place: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, or of a plain path."""
    return fs.FileSystem.from_uri(place if ":/" in place else f"file://{place}")


def read_chunks(place: str) -> Iterator[bytes]:
    system, path = opened(place)
    with system.open_input_stream(path, compression=None) as source:
        while chunk := source.read(CHUNK):
            yield chunk


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows to archive: page_id, url, payload, kind, refers_to.

    Of equal payloads of at least REVISIT_BYTES bytes, the one with the largest id is the
    response and the others revisit it. Payloads are told apart by SHA-1 and length.
    """
    columns_of(pages, id_col, url_col, html_col)
    payload = whole_text(html_col).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.withColumns({"size": F.length("payload"), "digest": F.unhex(F.sha1("payload"))})
    groups = keyed.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size")
    groups = groups.agg(F.max("page_id").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1 and lead is not null")
    groups = write_table(groups.drop("n"), "payloads")
    again = F.col("lead").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("lead"))
    return keyed.join(groups, ["digest", "size"], "left").select(
        "page_id",
        "url",
        "payload",
        F.when(again, "revisit").otherwise("response").alias("kind"),
        F.when(again, F.col("lead")).alias("refers_to"),
    )


def write_archives(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write captures into files of one gzip stream each; returns the written table of their paths."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        name, sink, zipped, size, paths = None, None, None, 0, []

        def close() -> None:
            sink.write(zipped.flush())
            sink.close()
            paths.append(f"{folder}/{name}")

        for batch in batches:
            for page_id, url, payload, kind, refers in zip(*batch.columns):
                if sink is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    sink, zipped, size = system.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(6, wbits=31), 0
                data = record(page_id.as_py(), url.as_py(), payload.as_buffer().to_pybytes(), kind.as_py(), refers.as_py(), date)
                sink.write(zipped.compress(data))
                size += len(data)
                if size >= file_bytes:
                    close()
                    sink = None
        if sink is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    return write_table(rows.mapInArrow(write, "path string"), "archives")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each file of ``archives`` (column path) with a gzip member per record and a sidecar index.

    The index has a line of JSON per record: offset, length, id. Returns the written table
    of path, index and records.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system.create_dir(base, recursive=True)
                name, at, n = uuid.uuid4().hex, 0, 0
                with (
                    system.open_output_stream(f"{base}/{name}.warc.gz", compression=None) as sink,
                    system.open_output_stream(f"{base}/{name}.idx", compression=None) as index,
                ):
                    for whole, first, _ in records(inflated(read_chunks(path))):
                        zipped = zlib.compressobj(6, wbits=31)
                        member = zipped.compress(whole) + zipped.flush()
                        sink.write(member)
                        entry = {"offset": at, "length": len(member), "id": fields_of(first)["warc-record-id"]}
                        index.write(json.dumps(entry).encode() + b"\n")
                        at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{folder}/{name}{end}"]) for end in (".warc.gz", ".idx")] + [pa.array([n], pa.int64())],
                    names=["path", "index", "records"],
                )

    dealt = archives.repartition(shuffle_slots(archives.sparkSession), "path")
    return write_table(dealt.mapInArrow(rewrite, "path string, index string, records long"), "normalised")


def read_member(place: str, offset: int, length: int) -> dict:
    """One record of a normalised file, without touching the others."""
    system, path = opened(place)
    with system.open_input_file(path) as source:
        whole = zlib.decompress(source.read_at(length, offset), 31)
    return parsed(*next(records(iter([whole])))[1:])


def read_archives(normalised: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked for."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]
    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds)], names=names)

        for batch in batches:
            for place, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                entries = b"".join(read_chunks(index)).splitlines()
                system, path = opened(place)
                with system.open_input_file(path) as source:
                    rows, held = [], 0
                    for entry in map(json.loads, entries):
                        whole = zlib.decompress(source.read_at(entry["length"], entry["offset"]), 31)
                        rows.append(parsed(*next(records(iter([whole])))[1:]))
                        held += len(whole)
                        if held >= 8 * CHUNK:
                            yield out(rows)
                            rows, held = [], 0
                    if rows:
                        yield out(rows)

    dealt = normalised.select("path", "index").repartition(shuffle_slots(normalised.sparkSession), "path")
    return dealt.mapInArrow(read, ddl + ", payload binary" * payloads)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive all pages, normalise the archives, and read every record back.

    One row per row of ``pages``. Null html counts as empty, a null url is left out of the
    record; rows with a null id have no number in their record and come back with a null id.
    Rows repeated under one id are equal responses. Other columns are not archived.
    """
    folder = f"{shared_folder(pages.sparkSession)}/warc/{uuid.uuid4().hex}"
    files = write_archives(captures(pages, id_col, url_col, html_col), f"{folder}/streams")
    return read_archives(normalise(files, f"{folder}/members"))
