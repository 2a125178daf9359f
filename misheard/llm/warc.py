"""Legacy archives converted to WARC.

ARC files of version 1 and 2 are read by their header lines: the version block
tells how many fields a record's line has, and its last field is the length of
what follows. Every record becomes a WARC record with an identifier made from its
payload digest and page, the time and address of the header line, its type, and
SHA-256 digests. Of records with equal payloads of at least `MIN_REVISIT` bytes,
the one of the smallest page is a response and the others revisit it.

Archives are written and read by Spark only, so any shared store will do: a row
of the text writer is one archive of about `ARCHIVE_BYTES`, and the binary reader
gives whole archives back. A task holds a few archives, never all records of a
key.

A null or empty page has an empty payload; a null page id is never pointed to and
always a response; rows with the same id and payload are all responses if theirs
is the smallest id. No pages give no records.
"""

import gzip
import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from misheard.llm.common import attach, cut

ARCHIVE_BYTES = 16 << 20
MIN_REVISIT = 100
CAPTURED = "20260101000000"
# The field names of ARC header lines by version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL_SAFE = "".join(map(chr, range(0x21, 0x7F)))


# --- archives as bytes ------------------------------------------------------


def arc_line(version: int, url: str, length: int, mime: str = "text/html", captured: str = CAPTURED) -> bytes:
    middle = "" if version == 1 else "200 - - 0 - "
    return f"{url} 0.0.0.0 {captured} {mime} {middle}{length}\n".encode()


def arc_start(version: int) -> bytes:
    block = f"{version} 0 pages\n{ARC_FIELDS[version]}\n".encode()
    return arc_line(version, "filedesc://pages.arc", len(block), "text/plain") + block


def arc_record(version: int, url: str | None, page: int | None, payload: bytes) -> bytes:
    named = "" if page is None else f"X-Page-Id: {page}\r\n"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}Content-Length: {len(payload)}\r\n\r\n"
    body = http.encode() + payload
    return b"\n" + arc_line(version, quote(url or "urn:none", safe=_URL_SAFE), len(body)) + body


def parse_arc(data: bytes) -> Iterator[tuple[dict, memoryview]]:
    """(fields of the header line, declared bytes) of every record but the
    version block."""
    view, at, version = memoryview(data), 0, None
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        start, length = end + 1, int(line.rsplit(" ", 1)[1])
        if start + length > len(data):
            raise ValueError(f"archive ends within {line!r}")
        block, at = view[start : start + length], start + length
        if version is None:
            version = int(bytes(block[:4]).split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown version {version}")
            continue
        names = ARC_FIELDS[version].split(" ")
        yield dict(zip(names, line.rsplit(" ", len(names) - 1))), block


def http_parts(block) -> tuple[bytes, memoryview]:
    """(HTTP header with its empty line, payload)."""
    block = memoryview(block)
    end = re.search(rb"\r\n\r\n", block) if block[:5] == b"HTTP/" else None
    cut_at = end.end() if end else 0
    return bytes(block[:cut_at]), block[cut_at:]


def header_value(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n"):
        key, _, value = line.partition(b":")
        if key.strip().lower() == name:
            return value.strip().decode("utf-8", "replace")
    return None


def record_id(digest: str, page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{digest}|{page}')}>"


def warc_time(captured: str) -> str:
    d = captured.ljust(14, "0")
    month, day = max("01", d[4:6]), max("01", d[6:8])
    return f"{d[:4]}-{month}-{day}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers if v is not None)]
    if block:
        lines.append(f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}")
    lines.append(f"Content-Length: {len(block)}")
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block


def parse_warc(data: bytes) -> Iterator[tuple[dict, memoryview]]:
    """(headers by lower-case name, block of the declared length)."""
    view, at = memoryview(data), 0
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record begins with {first[:40]!r}")
        headers = {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
        length = int(headers["content-length"])
        if end + 4 + length > len(data):
            raise ValueError("archive ends within a record")
        yield headers, view[end + 4 : end + 4 + length]
        at = end + 4 + length


# --- archives on a shared store ---------------------------------------------


def _write(archives: DataFrame, path: str, separator: str, by: list[str] = ()) -> None:
    """One file per row; bytes pass through the text writer unchanged."""
    rows = archives.select(*by, F.col("archive").cast("string").alias("value"))
    writer = rows.write.option("maxRecordsPerFile", 1).option("lineSep", separator)
    writer.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").partitionBy(*by).text(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")


def _unzipped(batches) -> Iterator[bytes]:
    for batch in batches:
        for content in batch.column(0):
            data = content.as_py()
            yield gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def write_arc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> None:
    """Pages as gzipped ARC files, of version 2 for odd ids, else of version 1."""
    rows = pages.select(
        F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("binary")
    )

    def run(batches):
        open_: dict[int, list[bytes]] = {}
        sizes = Counter()
        for batch in batches:
            for page, url, payload in zip(*(batch.column(k) for k in range(3))):
                page = page.as_py()
                version = 2 if (page or 0) % 2 else 1
                archive = open_.setdefault(version, [arc_start(version)])
                archive.append(arc_record(version, url.as_py(), page, payload.as_py() or b""))
                sizes[version] += len(archive[-1])
                if sizes[version] >= ARCHIVE_BYTES:
                    yield row(version, open_.pop(version))
                    sizes[version] = 0
        for version, archive in open_.items():
            yield row(version, archive)

    def row(version, archive):
        return pa.RecordBatch.from_arrays(
            [pa.array([version], pa.int32()), pa.array([b"".join(archive)], pa.binary())], names=["version", "archive"]
        )

    _write(rows.mapInArrow(run, "version int, archive binary"), path, "\n", ["version"])


_RECORD = pa.schema([
    ("page", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("captured", pa.string()),
    ("payload_bytes", pa.int64()), ("digest", pa.string()), ("block", pa.binary()),
])


def read_arc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """(page, url, ip, captured, payload_bytes, digest, block) of every record."""

    def run(batches):
        for data in _unzipped(batches):
            rows = []
            for fields, block in parse_arc(data):
                head, payload = http_parts(block)
                page = header_value(head, b"x-page-id")
                rows.append((
                    None if page is None else int(page), fields["URL"], fields["IP-address"], fields["Archive-date"],
                    len(payload), hashlib.sha256(payload).hexdigest(), bytes(block) if blocks else None,
                ))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORD)], schema=_RECORD
                )

    return _read(spark, path).mapInArrow(
        run,
        "page long, url string, ip string, captured string, payload_bytes long, digest string, block binary",
    )


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_revisit: int = MIN_REVISIT) -> None:
    """ARC files to gzipped WARC files."""
    payloads = read_arc(spark, arc_path, blocks=False).where(F.col("payload_bytes") >= min_revisit)
    firsts = cut(
        payloads.groupBy("digest")
        .agg(F.min("page").alias("first"), F.max("page").alias("_last"), F.count(F.lit(1)).alias("n"))
        .where("first < _last").select("digest", "first", "n")
    )
    records = attach(read_arc(spark, arc_path), firsts, ["digest"], "n", ["page", "url"], "left")
    refers = F.when(F.col("page") > F.col("first"), F.col("first"))
    records = records.select("page", "url", "ip", "captured", "payload_bytes", "digest", "block", refers.alias("refers"))

    def run(batches):
        archive, size = start(), 0
        for batch in batches:
            for r in zip(*(batch.column(k) for k in range(8))):
                page, url, ip, captured, n_bytes, digest, block, first = (x.as_py() for x in r)
                head, payload = http_parts(block)
                about = [
                    ("WARC-Record-ID", record_id(digest, page)), ("WARC-Date", warc_time(captured)),
                    ("WARC-Target-URI", url), ("WARC-IP-Address", ip), ("WARC-Payload-Digest", f"sha256:{digest}"),
                    ("Content-Type", "application/http; msgtype=response" if head else "application/octet-stream"),
                ]
                if first is not None:
                    about += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(digest, first)),
                              ("X-Refers-To-Page", first), ("X-Payload-Length", n_bytes)]
                    archive.append(warc_record("revisit", about, head))
                else:
                    archive.append(warc_record("response" if head else "resource", about, block))
                size += len(archive[-1])
                if size >= ARCHIVE_BYTES:
                    yield row(archive)
                    archive, size = start(), 0
        if len(archive) > 1:
            yield row(archive)

    def start():
        about = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'conversion')}>"),
                 ("WARC-Date", warc_time(CAPTURED)), ("Content-Type", "application/warc-fields")]
        return [warc_record("warcinfo", about, b"format: WARC File Format 1.1\r\n")]

    def row(archive):
        return pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(archive)], pa.binary())], names=["archive"])

    _write(records.mapInArrow(run, "archive binary"), warc_path, "\r\n\r\n")


_PAGE = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()),
    ("target_uri", pa.string()), ("warc_date", pa.string()), ("payload", pa.binary()),
])


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record but warcinfo; the payload's digest is checked."""

    def run(batches):
        for data in _unzipped(batches):
            rows = []
            for headers, block in parse_warc(data):
                kind = headers["warc-type"]
                if kind == "warcinfo":
                    continue
                head, payload = http_parts(block)
                page, digest = header_value(head, b"x-page-id"), headers["warc-payload-digest"].split(":")[1]
                if kind != "revisit" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {headers['warc-record-id']} is damaged")
                refers = headers.get("x-refers-to-page")
                rows.append((
                    None if page is None else int(page), int(headers.get("x-payload-length", len(payload))), digest,
                    kind, None if refers is None else int(refers), headers["warc-record-id"],
                    headers["warc-target-uri"], headers["warc-date"], bytes(payload) if payloads else None,
                ))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), _PAGE)], schema=_PAGE
                )

    return _read(spark, path).mapInArrow(
        run,
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "record_id string, target_uri string, warc_date string, payload binary",
    )
