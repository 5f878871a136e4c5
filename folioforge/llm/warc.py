"""WARC archives with revisit resolution.

Captures are written as response records, one gzip member a record. Only headers
(page, digest, size, place in the archive) are shuffled by payload digest; revisits
are joined to the response they repeat, and deduplicated archives are written with
fresh headers, file by file, from the captured ones. Reading is by member.
"""

from __future__ import annotations

import base64
import hashlib
import os
import shutil
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import batch_of, in_arrow, materialize, scratch

#: One date for all records, so that equal input gives equal archives.
DATE = datetime(2024, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 1


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {url}')}>"


def _value(x: str) -> str:
    """A header value must be one line; the rest stays as it is."""
    return x.replace("\r", "%0D").replace("\n", "%0A")


def build(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers: tuple[int | None, str | None] | None = None) -> bytes:
    """One record as a gzip member. A revisit has the HTTP head only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body = head + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, url)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_value(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {size}",
    ]
    if refers is not None:
        lines += [f"WARC-Refers-To: {record_id(*refers)}", f"X-Refers-To-Page: {refers[0]}", f"WARC-Profile: {REVISIT}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the payload after the HTTP head."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = rest[: int(headers["content-length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def filesystem(url: str) -> tuple[pafs.FileSystem, str]:
    """A shared folder as pyarrow sees it; plain local paths need no driver library."""
    parts = urlsplit(url)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem(), parts.path
    return pafs.FileSystem.from_uri(url)


class Writer:
    """Appends members to one archive that no other attempt writes."""

    def __init__(self, folder: str) -> None:
        self.fs, path = filesystem(folder)
        self.fs.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.gz"
        self.out = self.fs.open_output_stream(f"{path}/{self.name}")
        self.at = 0

    def add(self, member: bytes) -> tuple[int, int]:
        at = self.at
        self.out.write(member)
        self.at += len(member)
        return at, len(member)


def members(folder: str, name: str) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of an archive, read as a stream."""
    fs, path = filesystem(folder)
    with fs.open_input_stream(f"{path}/{name}") as f:
        at, buffer = 0, b""
        while True:
            unpacker = zlib.decompressobj(31)
            parts, used = [], 0
            while not unpacker.eof:
                if not buffer:
                    buffer = f.read(1 << 20)
                    if not buffer:
                        if used:
                            raise ValueError(f"{name} ends within a record")
                        return
                parts.append(unpacker.decompress(buffer))
                used += len(buffer) - len(unpacker.unused_data)
                buffer = unpacker.unused_data
            yield at, used, b"".join(parts)
            at += used


_PLACED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("size", pa.int64()), ("file", pa.string()), ("at", pa.int64())])
_PLACED_DDL = "page_id long, url string, digest string, size long, file string, at long"


def capture(pages: DataFrame, folder: str) -> DataFrame:
    """Write a response record for each row of ``pages(page_id, url, html)`` and return the
    headers with each record's place. Every task attempt writes a file of its own name;
    only files that the returned rows name belong to the archive, so what a lost
    executor left behind is never read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            writer = writer or Writer(folder)
            rows = []
            for page, url, html in zip(*(batch.column(i) for i in range(3)), strict=True):
                page, url, payload = page.as_py(), url.as_py(), (html.as_py() or "").encode()
                digest = digest_of(payload)
                at, _ = writer.add(build("response", page, url, payload, digest, len(payload)))
                rows.append((page, url, digest, len(payload), writer.name, at))
            if rows:
                yield batch_of(_PLACED, **{f.name: [r[i] for r in rows] for i, f in enumerate(_PLACED)})
        if writer:
            writer.out.close()

    return in_arrow(pages.select("page_id", "url", "html"), run, _PLACED_DDL)


def resolve(headers: DataFrame, least: int = 0) -> DataFrame:
    """Decide each header: of equal digests (payloads of ``least`` bytes at least) the
    greatest page_id is the response, which the others refer to. The greatest is found
    by an aggregation, so that a digest which a third of all pages share is no hot task."""
    first = headers.where(F.col("size") >= least).groupBy("digest").agg(F.max(F.struct("page_id", "url", "file", "at")).alias("original"))
    joined = headers.join(first, "digest", "left")
    same = (F.col("original.file") == F.col("file")) & (F.col("original.at") == F.col("at"))
    revisit = (F.col("size") >= least) & ~same & F.col("original").isNotNull()
    return joined.select("page_id", "url", "digest", "size", "file", "at", F.when(revisit, F.col("original.page_id")).alias("refers_to"), F.when(revisit, F.col("original.url")).alias("refers_url"), revisit.alias("revisit"))


def rewrite(decided: DataFrame, source: str, folder: str) -> DataFrame:
    """Write deduplicated archives: each captured file is read once, in order, by the task
    that holds its decisions, and its records are written with fresh headers. Returns
    the names of the new archives. A file holds what one task captured, so a group is
    bounded by a partition."""
    out = pa.schema([("archive", pa.string()), ("records", pa.int64())])

    def run(rows: pa.Table) -> pa.Table:
        by = {at: (page, url, digest, size, to, to_url, revisit) for at, page, url, digest, size, to, to_url, revisit in zip(*(rows.column(c).to_pylist() for c in ("at", "page_id", "url", "digest", "size", "refers_to", "refers_url", "revisit")), strict=True)}
        writer = Writer(folder)
        for at, _, record in members(source, rows.column("file")[0].as_py()):
            page, url, digest, size, to, to_url, revisit = by[at]
            if revisit:
                writer.add(build("revisit", page, url, b"", digest, size, (to, to_url)))
            else:
                writer.add(build("response", page, url, parse(record)[1], digest, size))
        writer.out.close()
        return pa.table({"archive": [writer.name], "records": [len(by)]}, schema=out)

    return decided.groupBy("file").applyInArrow(run, "archive string, records long")


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])


def read(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Read archives (a column of names) back, a row a record. A response's digest and size
    come from its payload and must equal its headers'; a revisit's come from its headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                for _, _, record in members(folder, name):
                    headers, payload = parse(record)
                    digest, length = headers["warc-payload-digest"].removeprefix("sha1:"), int(headers["x-payload-length"])
                    if headers["warc-type"] == "response" and (digest_of(payload), len(payload)) != (digest, length):
                        raise ValueError(f"{name}: a payload differs from its header")
                    refers = headers.get("x-refers-to-page")
                    rows.append((int(headers["x-page-id"]) if headers["x-page-id"] else None, headers["warc-target-uri"], length, digest, headers["warc-type"], int(refers) if refers and refers != "None" else None, payload.decode() if payloads else None))
                    size += length if payloads else 0
                    if len(rows) >= 2000 or size > 4 << 20:
                        yield batch_of(_READ, **{f.name: [r[i] for r in rows] for i, f in enumerate(_READ)})
                        rows, size = [], 0
                if rows:
                    yield batch_of(_READ, **{f.name: [r[i] for r in rows] for i, f in enumerate(_READ)})

    names = archives.select("archive")
    n = max(1, names.count())
    return in_arrow(names.repartition(min(n, names.sparkSession.sparkContext.defaultParallelism * 4)), run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")


def archive_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Capture, resolve, rewrite and read back ``pages(page_id, url, html, ...)``: a row a page.

    A null html has an empty payload, a null url an empty target. Equal page_ids keep
    their rows (which of equal ones is the response follows the url, then the place).
    An empty table gives no row. Archives lie in the shared folder; texts move from
    file to file and are never shuffled.
    """
    spark = pages.sparkSession
    raw, final = scratch(spark, "captured"), scratch(spark, "archives")
    headers, _ = materialize(capture(pages, raw), "headers")
    archives, _ = materialize(rewrite(resolve(headers, least), raw, final), "archive-names")
    drop_folder(raw)
    return read(archives, final).drop("payload")


def drop_folder(folder: str) -> None:
    fs, path = filesystem(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        if os.path.isdir(path):
            shutil.rmtree(path)
    elif fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)
