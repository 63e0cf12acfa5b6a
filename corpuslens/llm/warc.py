"""WARC archives: one record per page, revisit records for equal payloads, and a reader that salvages damaged files.

Writing: a record is a gzip member of its own (or plain text with ``compress=False``). Of records with equal payloads of at least
``revisit_from`` bytes, the one with the largest id is a response, the others are revisits that refer to it and carry no payload. Each
task writes files of about ``FILE_BYTES`` under names of its own attempt below the shared folder; the manifest that Spark commits
names the files that count.

Reading: one task reads one file, from its first byte on, in pieces. Each record is checked: the member's own
checksum, the version line, the headers (up to their blank line, of any length), the lengths, and the payload's digest. After a failed check the reader goes on at the next
byte where a member or a version line begins, and accepts it only if a record that passes all checks follows. The bytes between
are a quarantined gap, reported with file, offset, length and reason.

A null html is empty. Equal pages under one largest id are all responses. A null id never is referred to; where a payload has no other
id, its records are all responses. Null urls are written without a target header. An empty table writes no file.
"""

from __future__ import annotations

import hashlib
import re
import sys
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from corpuslens.llm.common import parallel_paths, written
from corpuslens.session import scratch_path

REVISIT_FROM = 1000
FILE_BYTES = 64_000_000
#: Bytes read at once; a record that is longer is read on until it ends.
READ_BYTES = 1_000_000
#: Compressed bytes unpacked at once.
CHUNK_BYTES = 16_384
VERSION = b"WARC/1.1\r\n"
MEMBER = b"\x1f\x8b\x08"
LINE = b"WARC/1."
VERSION_LINE = re.compile(rb"WARC/1\.\d\r\n")
MANIFEST = "file string, bytes long, records long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed record."""
    revisit = refers_to is not None
    block = b"" if revisit else html
    head = [
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <urn:uuid:%s>" % str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}:{digest}")).encode(),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"WARC-Block-Digest: sha1:" + hashlib.sha1(block).hexdigest().encode(),
        b"X-Payload-Length: %d" % len(html),
        b"Content-Type: text/html; charset=utf-8",
    ]
    if page_id is not None:
        head.append(b"X-Page-ID: %d" % page_id)
    if url is not None:
        head.append(b"WARC-Target-URI: " + url.encode().replace(b"%", b"%25").replace(b"\r", b"%0D").replace(b"\n", b"%0A"))
    if revisit:
        head.append(b"WARC-Refers-To: <urn:page:%d>" % refers_to)
        head.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head.append(b"Content-Length: %d" % len(block))
    return VERSION + b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """The bytes as one gzip member."""
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Damaged(Exception):
    """A check failed."""


class Short(Exception):
    """The record does not end in the bytes at hand."""


def parse_headers(data: bytes, at: int, ended: bool) -> tuple[dict, int]:
    """Headers of the plain record at a place, however long they are, and where its block begins."""
    begin = at + len(VERSION)
    if len(data) < begin and not ended:
        raise Short
    if not VERSION_LINE.fullmatch(data[at:begin]):
        raise Damaged("no version line")
    headers = {}
    while (stop := data.find(b"\r\n", begin)) != begin:
        if stop < 0 and not ended:
            raise Short
        if stop < 0 or data.startswith(LINE, begin):  # the next record's version line
            raise Damaged("no end of headers")
        name, colon, value = data[begin:stop].partition(b":")
        if not colon:
            raise Damaged("header without colon")
        headers[name.strip().lower()] = value.strip()
        begin = stop + 2
    return headers, begin + 2


def parse(data: bytes, at: int, ended: bool) -> tuple[dict, bytes, int]:
    """Headers, block and end of the plain record at a place. ended: no more bytes follow data."""
    if not data.startswith(LINE, at):
        if not ended and LINE.startswith(data[at : at + len(LINE)]):
            raise Short
        raise Damaged("no version line")
    headers, begin = parse_headers(data, at, ended)
    size = headers.get(b"content-length", b"")
    if not size.isdigit() or len(size) > 15:
        raise Damaged("no content length")
    end = begin + int(size)
    if len(data) < end + 4:
        if not ended:
            raise Short
        raise Damaged("cut off")
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("no end of record")
    block = data[begin:end]
    wanted = headers.get(b"warc-block-digest", b"").removeprefix(b"sha1:").decode("ascii", "replace").lower()
    if wanted and wanted != hashlib.sha1(block).hexdigest():
        raise Damaged("digest differs")
    return headers, block, end + 4


def parse_member(data: bytes, at: int, ended: bool) -> tuple[dict, bytes, int]:
    """Headers, block and end of the gzip member at a place, which holds one record."""
    unpacker, plain, pos = zlib.decompressobj(31), bytearray(), at
    while not unpacker.eof:
        chunk = data[pos : pos + CHUNK_BYTES]
        if not chunk:
            if not ended:
                raise Short
            raise Damaged("cut off")
        try:
            plain += unpacker.decompress(chunk)
        except zlib.error as error:
            raise Damaged("bad gzip member") from error
        pos += len(chunk)
        if not plain.startswith(LINE[: len(plain)]):
            raise Damaged("no version line")
    headers, block, end = parse(bytes(plain), 0, True)
    if end != len(plain):
        raise Damaged("bytes after the record")
    return headers, block, pos - len(unpacker.unused_data)


def salvage(stream, size: int) -> Iterator[tuple]:
    """What a file that can be read on has: ("record", offset, headers, block) and ("gap", offset, length, reason)."""
    base, data, at = 0, b"", 0
    gap = reason = None

    def more(least: int) -> None:
        nonlocal data, base, at, size
        new = stream.read(max(least, READ_BYTES))
        data, base, at = data[at:] + new, base + at, 0
        if not new:
            size = base + len(data)  # the file is shorter than it was said to be

    while base + at < size:
        ended = base + len(data) >= size
        if gap is not None:
            # The next member or version line; the last bytes at hand may be the beginning of one.
            found = [x for x in (data.find(MEMBER, at), data.find(LINE, at)) if x >= 0]
            if not found and ended:
                break
            at = min(found, default=max(at, len(data) - len(LINE) + 1))
            if not found:
                more(0)
                continue
        try:
            if len(data) - at < len(LINE) and not ended:
                raise Short
            headers, block, end = (parse_member if data.startswith(MEMBER, at) else parse)(data, at, ended)
        except Short:
            more(len(data) - at)  # twice as many bytes at least, so a long record is read in linear time
            continue
        except Damaged as error:
            if gap is None:
                gap, reason = base + at, str(error)
            at += 1
            continue
        if gap is not None:
            yield "gap", gap, base + at - gap, reason
            gap = None
        yield "record", base + at, headers, block
        at = end
    if gap is not None:
        yield "gap", gap, size - gap, reason


def page_of(headers: dict, block: bytes) -> tuple:
    """The fields of RECORD from a record's headers and block."""

    def number(name: bytes, strip: bytes = b"") -> int | None:
        value = headers.get(name, b"").removeprefix(strip).removesuffix(b">" if strip else b"")
        return int(value) if value.lstrip(b"-").isdigit() else None

    kind = headers.get(b"warc-type", b"").decode("utf-8", "replace")
    url = headers.get(b"warc-target-uri")
    if url is not None:
        url = url.replace(b"%0A", b"\n").replace(b"%0D", b"\r").replace(b"%25", b"%").decode("utf-8", "replace")
    if kind == "revisit":
        digest, length = headers.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("utf-8", "replace"), number(b"x-payload-length")
    else:
        digest, length = hashlib.sha1(block).hexdigest(), len(block)
    return number(b"x-page-id"), url, length, digest, kind, number(b"warc-refers-to", b"<urn:page:"), None if kind == "revisit" else block


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = REVISIT_FROM) -> DataFrame:
    """(page_id, url, html, digest, refers_to) of every page; refers_to is null for responses."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("html"), F.sha1(body).alias("digest"))
    several = (
        rows.select("page_id", "digest", F.length("html").alias("size")).filter(F.col("size") >= revisit_from)
        .groupBy(F.col("digest").alias("_digest")).agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND last IS NOT NULL").drop("n")
    )
    several = written(several, "equal-payloads")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return rows.join(several, rows["digest"] == several["_digest"], "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write(rows: DataFrame, folder: str, compress: bool = True) -> DataFrame:
    """Write what with_revisits() returns below folder; the manifest of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out = []
        stream = None
        size = count = 0
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if stream is None:
                    system, base = parallel_paths(folder)
                    system.create_dir(base, recursive=True)
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.warc" + ".gz" * compress
                    stream, size, count = system.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                data = record(page_id, url, html, digest, refers_to)
                data = member(data) if compress else data
                stream.write(data)
                size, count = size + len(data), count + 1
                if size >= FILE_BYTES:
                    stream.close()
                    out.append((f"{folder}/{name}", size, count))
                    stream = None
        if stream is not None:
            stream.close()
            out.append((f"{folder}/{name}", size, count))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["file", "bytes", "records"])

    return written(rows.mapInArrow(run, MANIFEST), "archives")


def _scan(manifest: DataFrame, what: str, schema: str, row):
    names = [c.split()[0] for c in schema.split(", ")]
    files = manifest.select("file", F.col("bytes").cast("long").alias("bytes"))
    tasks = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size in zip(*(c.to_pylist() for c in batch.columns)):
                system, path = parallel_paths(file)
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for found in salvage(stream, size):
                        if found[0] == what:
                            rows.append(row(file, found))
                            held += len(found[3]) + 200 + (sum(map(len, found[2].values())) if what == "record" else 0)
                        if held > 8_000_000:
                            yield _batch(rows, names, schema)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, names, schema)

    return files.repartition(tasks).mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)


def read(manifest: DataFrame) -> DataFrame:
    """Every record that passes its checks. manifest: file, bytes."""
    return _scan(manifest, "record", RECORD, lambda file, found: page_of(found[2], found[3]))


def gaps(manifest: DataFrame) -> DataFrame:
    """The quarantined bytes: file, offset, length and the check that failed first."""
    return _scan(manifest, "gap", "file string, offset long, length long, reason string", lambda file, found: (file, found[1], found[2], found[3]))


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = REVISIT_FROM, compress: bool = True) -> DataFrame:
    """Write the archives below the shared folder and read them back."""
    return read(write(with_revisits(pages, page_id, url, html, revisit_from), scratch_path(pages.sparkSession, "warc"), compress))


#: What the archives must say, from the pages themselves.
ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), q AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY body) ELSE page_id END AS last FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM q"""

cloudpickle.register_pickle_by_value(sys.modules[__name__])
