"""WARC archives: .warc.gz files with one record set per page, read back and assembled into captures.

Tasks write their archives as files of their own, a gzip member per record, through pyarrow's file systems (local or mounted, HDFS, S3,
GCS). What a task wrote counts once it is in the manifest, a table of paths: names are never used twice, so files of a lost or repeated
task are merely left over. Archives are read by Spark's binaryFile source, from any store, one row a file.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts as small

#: Bytes of compressed records after which an archive is closed.
ARCHIVE_BYTES = 8 << 20
CRLF = b"\r\n"
SPACE_UUID = uuid.UUID("5b0f3c1e-7a54-5c0e-9a40-6f2d1f0c8a11")
DATE = "2020-01-01T00:00:00Z"


def record_id(role: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_UUID, f'{role} {key}')}>"


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + CRLF + block + CRLF + CRLF
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def header_value(text: str | None) -> str:
    """A value fit for a header line: control characters percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text or "")


def judged(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, html as payload, its digest, and refers_to: the smallest page_id with that payload, where another
    page than this one and the payload has `least` bytes or more. The pass over digests carries no payloads. Null html is empty; pages without id are responses
    that none revisits; rows stay as many as they are, none for an empty table."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    first = p.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"))
    ids = p.groupBy("digest", "page_id").agg(F.lit(1).alias("one")).join(first, "digest").filter(F.col("page_id") != F.col("first_id")).select("page_id", "digest", F.col("first_id").alias("refers_to"))
    return p.join(ids, ["page_id", "digest"], "left")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes request, response or revisit, and metadata records of judged pages to .warc.gz files in a folder that all
    executors share. Returns the manifest: archive string (path), records long, n_bytes long. An empty table gives no files."""

    def f(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        parts, size = [], 0
        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")

        def archive():
            path = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
            with store.open_output_stream(f"{root}/{path}", compression=None) as out:
                for x in parts:
                    out.write(x)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path}"]), pa.array([len(parts)], pa.int64()), pa.array([size], pa.int64())], ["archive", "records", "n_bytes"])

        for b in small(batches, 2):
            for page, url, html, digest, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                payload, key = html.encode("utf-8", "surrogatepass"), f"{page} {digest}"
                target = [("WARC-Target-URI", header_value(url))] if url else []
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                main = [*target, ("WARC-Record-ID", record_id("response", key)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
                if refers is None:
                    out = [record("response", main, http + payload)]
                else:
                    main += [("WARC-Refers-To", record_id("response", f"{refers} {digest}")), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(refers))]
                    out = [record("revisit", main, http)]
                with_id = [*target, ("WARC-Concurrent-To", record_id("response", key))]
                out.append(record("request", [*with_id, ("WARC-Record-ID", record_id("request", key)), ("Content-Type", "application/http; msgtype=request")], b"GET / HTTP/1.1\r\n\r\n"))
                out.append(record("metadata", [*with_id, ("WARC-Record-ID", record_id("metadata", key)), ("Content-Type", "application/warc-fields")], f"page-id: {'' if page is None else page}\r\n".encode()))
                parts += out
                size += sum(map(len, out))
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    parts, size = [], 0
        if parts:
            yield archive()

    return pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(f, "archive string, records long, n_bytes long")


def open_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """archive, content of the files of a folder that the manifest names."""
    found = manifest.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    name = F.substring_index(F.col("archive"), "/", -1).alias("name")
    files = found.select(F.col("path").alias("archive"), "content").withColumn("name", name)
    return files.join(manifest.select(name), "name", "left_semi").select("archive", "content")


def members(content: bytes, step: int = 1 << 14):
    """The decompressed gzip members of an archive one after the other, and whether each is whole, fed in small steps: what lies
    behind a member's end is copied. What cannot be decompressed is the last, as far as it goes."""
    view, at = memoryview(content), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        try:
            while not z.eof and at < len(view):
                out.append(z.decompress(view[at : at + step]))
                at += len(view[at : at + step])
        except zlib.error:
            at = len(view)
        at -= len(z.unused_data)
        yield b"".join(out), z.eof
        if not z.eof:
            return


def records_of(content: bytes):
    """(type, header fields with names in lower case, block, whole) of each record, also where a member holds several or
    the archive is not compressed. What is no record has type None."""
    for raw, whole in members(content) if content[:2] == b"\x1f\x8b" else [(content, True)]:
        while raw.strip():
            head, found, rest = raw.partition(CRLF + CRLF)
            lines = head.decode("utf-8", "replace").lstrip().split("\r\n")
            if not found or not lines[0].startswith("WARC/"):
                yield None, {}, raw, False
                break
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            told = fields.get("content-length", "")
            n = int(told) if told.isdigit() else len(rest.removesuffix(CRLF + CRLF))
            yield fields.get("warc-type"), fields, rest[:n], told.isdigit() and len(rest) >= n and (whole or len(rest) > n)
            raw = rest[n:].lstrip(CRLF)


def http_payload(block: bytes) -> tuple[bytes, int | None, bool]:
    """The body of an HTTP message, the Content-Length it tells, and whether it fits that. Chunks are joined."""
    http, _, body = block.partition(CRLF + CRLF)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(CRLF)[1:])}
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        out, rest = [], body
        while True:
            size, found, rest = rest.partition(CRLF)
            try:
                n = int(size.split(b";")[0], 16)
            except ValueError:
                n = -1
            if not found or n < 0 or n > len(rest):  # not in chunks as it should be
                return body, None, False
            if not n:
                return b"".join(out), None, True
            out.append(rest[:n])
            rest = rest[n:].removeprefix(CRLF)
    told = fields.get(b"content-length", b"")
    n = int(told) if told.isdigit() else None
    return body, n, n is None or n == len(body)


RECORDS = "archive string, record_type string, record_id string, concurrent_to string, target_uri string, refers_to_id string, refers_to_page long, payload_digest string, payload_bytes long, payload binary, fields string, damaged boolean"


def read_records(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row per record of archives (archive, content). payload: of responses, if payloads is set, chunks joined; payload_bytes and payload_digest: those of the payload
    as read, of revisits those their headers tell; fields: the block of metadata records.

    damaged: the record is cut short, is none (record_type null), has a length that is not what it tells, or a payload whose digest is not the one told. Such records
    are rows like others, with what could be read; the payload of a response without or with a wrong Content-Length is its whole body.
    Null contents give no rows; archives that appear twice give their rows twice."""

    def f(batches):
        names = [x.split()[0] for x in RECORDS.split(", ")]
        types = [pa.int64() if x.endswith("long") else pa.binary() if x.endswith("binary") else pa.bool_() if x.endswith("boolean") else pa.string() for x in RECORDS.split(", ")]

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, size = [], 0
                for kind, at, block, whole in records_of(content.as_py() or b""):
                    told = at.get("warc-payload-digest", "")
                    digest = told.removeprefix("sha256:") or None
                    payload = n = fields = None
                    if kind == "response":
                        payload, _, fits = http_payload(block)
                        n, real = len(payload), hashlib.sha256(payload).hexdigest()
                        whole = whole and fits and (not told.startswith("sha256:") or digest == real)
                        digest, payload = real, payload if payloads else None
                    elif kind == "revisit":
                        n = http_payload(block)[1]
                    elif kind == "metadata":
                        fields = block.decode("utf-8", "replace")
                    page = at.get("x-refers-to-page", "")
                    rows.append((name, kind, at.get("warc-record-id"), at.get("warc-concurrent-to"), at.get("warc-target-uri"), at.get("warc-refers-to"), int(page) if page.removeprefix("-").isdigit() else None, digest, n, payload, fields, not whole))
                    size += len(payload or b"") + 200
                    if size > 4 << 20:
                        yield flush(rows)
                        rows, size = [], 0
                if rows:
                    yield flush(rows)

    return archives.select("archive", "content").mapInArrow(f, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, page_id, request, response and metadata structs.

    Request and metadata records name their capture's response record as concurrent-to; a response or revisit stands
    for itself. A capture has three records, so a group stays small whatever the data; rows repeated in the input
    have equal record ids and give as many equal captures. Records without any id are left out; an empty table gives no rows.
    """
    records = records.filter("coalesce(concurrent_to, record_id) is not null")
    key = F.coalesce("concurrent_to", "record_id").alias("capture_id")
    main = F.col("record_type").isin("response", "revisit")
    pick = lambda cond, *cols: F.max(F.when(cond, F.struct(*cols)))
    g = records.groupBy(key).agg(
        F.sum(main.cast("int")).alias("times"),
        pick(F.col("record_type") == "request", "record_id", "target_uri").alias("request"),
        pick(main, "record_type", "record_id", "target_uri", "payload_digest", "payload_bytes", "refers_to_id", "refers_to_page", "payload").alias("response"),
        pick(F.col("record_type") == "metadata", "record_id", "fields").alias("metadata"),
    )
    page = F.nullif(F.regexp_extract("metadata.fields", r"page-id: (-?\d+)", 1), F.lit("")).cast("long")
    return g.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("times", F.lit(1))))).select("capture_id", page.alias("page_id"), "request", "response", "metadata")
