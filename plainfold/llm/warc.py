"""A splittable reader of WARC files compressed record by record, and a writer.

A task has a byte range. It looks for gzip's magic bytes in it, takes a place as the start of a record if what
decompresses there begins with a WARC version line and complete headers with a length, and from then on goes from member
to member; a record belongs to the task in whose range its member begins, however far it reaches. A member that is damaged
is passed over by looking for magic again, one byte on. Ranges of any size hence give the same records.

Defined results: an empty folder or file gives no records; an empty payload is empty, not null. A page without url or
page_id has no such header and comes back with null there; one without html is written as status 204 and comes back as
null. Repeated rows are records of their own. Bytes inside a stored member that spell a whole record can't be told
from one by a task that starts within it.

Files of others: headers come as they stand, in their order, repeated ones too; a header's further lines are joined to it.
A response is split at its first blank line if it begins with an HTTP status line, else all of it is the page. Bytes are
decoded by the charset that the HTTP header names (UTF-8 without one, or if it is unknown), what can't be decoded as U+FFFD.
Bodies in a transfer or content encoding are not unpacked.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainfold.sources.tables import table

from . import common as C

SPLIT_BYTES, READ_BYTES, HEADER_BYTES = 32 << 20, 1 << 20, 1 << 16
MAGIC = b"\x1f\x8b\x08"
LEVEL = 6
EXACT = "X-Exact-Url"  # a url that no header can hold as it is, escaped; only in files of our own
DATE = "2024-01-01T00:00:00Z"


def _escaped(value: str) -> str:
    """As in URLs, so that a header can hold it: no line break or control may stand there, nor a blank at either end."""
    return quote(value, safe="/:?#[]@!$&'()*+,;=-._~")


def _plain(value: str) -> bool:
    return value == value.strip() and not any(c < " " or c == "\x7f" for c in value)


def record(kind: str, headers: dict[str, str], payload: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = {"WARC-Type": kind, "WARC-Date": DATE, **headers, "Content-Length": str(len(payload))}
    text = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(text.encode() + payload + b"\r\n\r\n") + z.flush()


def page_record(page_id, url, html) -> bytes:
    status = "204 No Content" if html is None else "200 OK"
    http = f"HTTP/1.1 {status}\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"X-Page-Id: {page_id}\r\n" if page_id is not None else "") + "\r\n"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url}")
    headers = {"WARC-Record-ID": f"<urn:uuid:{name}>", "Content-Type": "application/http; msgtype=response"}
    if url is not None:
        headers["WARC-Target-URI"] = url if _plain(url) else _escaped(url)
        if not _plain(url):
            headers[EXACT] = _escaped(url)
    return record("response", headers, http.encode() + (html or "").encode())


def write_pages(pages: DataFrame, folder: str) -> int:
    """Each partition of pages as one file; a task that runs again replaces its own file. Gives the number of records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        part, n = TaskContext.get().partitionId(), 0
        draft = f"{base}/_{part}-{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as out:
            out.write(record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(part))}>", "Content-Type": "application/warc-fields"}, b"software: plainfold\r\n"))
            for batch in batches:
                for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                    out.write(page_record(page_id, url, html))
                    n += 1
        fs.move(draft, f"{base}/part-{part:06d}.warc.gz")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    light = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return light.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def header_lines(lines: list[bytes]) -> list[tuple[str, str]]:
    """(name, value) of each header, names in lower case."""
    found: list[tuple[str, str]] = []
    for line in lines:
        name, colon, value = line.partition(b":")
        if line[:1] in (b" ", b"\t") and found:
            found[-1] = (found[-1][0], (found[-1][1] + " " + line.strip().decode("utf-8", "replace")).strip())
        elif colon:
            found.append((name.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace")))
    return found


def first_of(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k == name), None)


def parse_head(block: bytes) -> tuple[list[tuple[str, str]], int] | None:
    """Headers of a record, and where its payload begins; None if it isn't one."""
    if not block.startswith(b"WARC/1."):
        return None
    end = block.find(b"\r\n\r\n")
    if end < 0:
        return None
    found = header_lines(block[:end].split(b"\r\n")[1:])
    length = first_of(found, "content-length") or ""
    return (found, end + 4) if length.isascii() and length.isdigit() and first_of(found, "warc-type") is not None else None


class Source:
    """A file read in blocks, from any place."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.block = file, size, 0, b""

    def read(self, at: int, most: int = 1 << 15) -> bytes:
        """Some bytes from ``at`` on; none at the end."""
        if not self.at <= at < self.at + len(self.block):
            if at >= self.size:
                return b""
            self.file.seek(at)
            self.at, self.block = at, self.file.read(min(READ_BYTES, self.size - at))
        return self.block[at - self.at : at - self.at + most]

    def find(self, at: int, end: int) -> int:
        """First place from ``at`` and before ``end`` where magic stands, or -1."""
        while at < end:
            block = self.read(at, READ_BYTES)
            if not block:
                return -1
            if len(block) < len(MAGIC):
                more = self.read(at + len(block))
                block += more[: len(MAGIC)]
            i = block.find(MAGIC)
            if i >= 0:
                return at + i if at + i < end else -1
            at += max(1, len(block) - len(MAGIC) + 1)
        return -1


def member(source: Source, at: int) -> tuple[list[tuple[str, str]], bytes, int] | None:
    """The record whose member begins at ``at``: headers, payload and the place after it. None if there is none."""
    z, parts, n, head, tried = zlib.decompressobj(31), [], 0, None, 9
    while not z.eof:
        block = source.read(at)
        if not block:
            return None
        try:
            got = z.decompress(block)
        except zlib.error:
            return None
        at += len(block)
        parts.append(got)
        n += len(got)
        if head is None and (z.eof or n >= tried):
            parts = [b"".join(parts)]
            head = parse_head(parts[0])
            if head is None and (z.eof or not parts[0].startswith(b"WARC/1.") or b"\r\n\r\n" in parts[0]):
                return None  # a candidate costs no more than its headers
            tried = max(HEADER_BYTES, 2 * n) if n >= HEADER_BYTES else 9  # headers may be of any length
    headers, begin = head
    body = b"".join(parts)
    length = int(first_of(headers, "content-length"))
    if len(body) < begin + length:
        return None
    return headers, body[begin : begin + length], at - len(z.unused_data)


def records(source: Source, start: int, end: int) -> Iterator[tuple[int, list[tuple[str, str]], bytes]]:
    """Records that begin in [start, end)."""
    at, joined = start, False
    while at < end:
        if not joined or source.read(at)[:3] != MAGIC:
            at = source.find(at, end)
            if at < 0:
                return
        got = member(source, at)
        if got is None:
            at, joined = at + 1, False
            continue
        headers, payload, after = got
        yield at, headers, payload
        at, joined = after, True


def splits(folder: str, split_bytes: int = SPLIT_BYTES) -> list[tuple[str, int, int, int]]:
    fs, base = pafs.FileSystem.from_uri(folder)
    found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True, recursive=True))
    files = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(".warc.gz") and not f.base_name.startswith(("_", ".")))
    return [(p, a, min(n, a + split_bytes), n) for p, n in files for a in range(0, n, split_bytes)]


_RECORDS = pa.schema(
    [("path", pa.string()), ("offset", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("payload", pa.binary())]
)


def read(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of a folder's .warc.gz files."""
    todo = splits(folder, split_bytes)
    schema = "path string, offset long, type string, record_id string, uri string, date string, headers array<struct<name:string,value:string>>, payload binary"
    if not todo:
        return spark.createDataFrame([], schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        rows: list[tuple] = []
        size = 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORDS)], schema=_RECORDS)

        for batch in batches:
            for path, start, end, whole in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_file(path) as file:
                    for at, h, payload in records(Source(file, whole), start, end):
                        own = [first_of(h, k) for k in ("warc-type", "warc-record-id", "warc-target-uri", "warc-date")]
                        rows.append((path, at, *own, [{"name": k, "value": v} for k, v in h], payload))
                        size += len(payload)
                        if size > C.SLICE_BYTES:
                            yield full()
                            rows.clear()
                            size = 0
        if rows:
            yield full()

    table = spark.createDataFrame(spark.sparkContext.parallelize(todo, len(todo)), "path string, start long, stop long, size long")
    return table.mapInArrow(scan, schema)


_PAGE = pa.struct([("page_id", pa.int64()), ("html", pa.string())])
_HEAD_END = re.compile(rb"\r?\n\r?\n")
_CHARSET = re.compile(r"charset *= *[\"']?([\w.:-]+)", re.I)
_NUMBER = re.compile(r"-?[0-9]{1,18}")


def decoded(body: bytes, charset: str | None) -> str:
    try:
        return body.decode(charset or "utf-8", "replace")
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace")


def page_of(payload: bytes | None) -> tuple[int | None, str | None]:
    """(page_id, html) of a response's payload."""
    if payload is None or not payload.startswith(b"HTTP/"):
        return None, None if payload is None else decoded(payload, None)
    cut = _HEAD_END.search(payload)
    lines = payload[: cut.start() if cut else len(payload)].splitlines()
    headers = header_lines(lines[1:])
    page_id = first_of(headers, "x-page-id") or ""
    charset = _CHARSET.search(first_of(headers, "content-type") or "")
    empty = lines[0].split(b" ")[1:2] == [b"204"]
    return int(page_id) if _NUMBER.fullmatch(page_id) else None, None if empty else decoded(payload[cut.end() :] if cut else b"", charset and charset.group(1))


def pages(found: DataFrame) -> DataFrame:
    """(page_id, url, html) of response records."""

    def read_pages(payload: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("page_id", "html"), page_of(x))) for x in payload.to_pylist()], _PAGE)

    exact = F.filter("headers", lambda h: h["name"] == EXACT.lower())
    rows = found.where("type = 'response'").select("uri", F.get(exact, F.lit(0))["value"].alias("exact"), F.arrow_udf(read_pages, "page_id long, html string")("payload").alias("page"))
    return rows.select("page.page_id", F.coalesce(F.try_url_decode(F.replace("exact", F.lit("+"), F.lit("%2B"))), "uri").alias("url"), "page.html")


def query(spark, sf_dir: str) -> DataFrame:
    """All of pages, written as WARC files and read back."""
    folder = C.work_path(spark, "warc")
    if "://" not in folder:
        folder = ("file://" if folder.startswith("/") else "") + folder.replace("file:/", "file:///", 1)
    write_pages(table(spark, sf_dir, "pages"), folder)
    return pages(read(spark, folder))


ORACLE = "select page_id, url, html from pages"
