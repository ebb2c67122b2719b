"""WARC archives: captures written as transactions, and assembled from them.

Every capture is three records: a response (or, where another capture has the
same payload, a revisit of it), a request and metadata; the last two name the
first in WARC-Concurrent-To. Archives are gzip files with a member per record,
the first of which is a warcinfo record.
Reading lists the records of all archives and joins request, response and
metadata through the concurrent-to identifiers into one nested row per capture.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm._shared import arrow_batches
from lexiloom.plans.materialise import fresh_path, materialise

LEAST = 100  # payloads of fewer bytes are not revisited
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
LEVEL = 4
READ = 1 << 18
ARCHIVE = 1 << 30  # bytes after which a task goes on in another archive


def _clean(value: str) -> str:
    """A header value cannot hold line breaks."""
    return " ".join(value.split())


def record(kind: str, record_id: str, body: bytes, headers: dict[str, str], content: str) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {EPOCH}", *[f"{k}: {_clean(v)}" for k, v in headers.items()], f"Content-Type: {content}", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def capture_records(capture: str, page_id: int | None, url: str, payload: bytes | None, digest: str, n_bytes: int, refers_to: int | None, refers_uri: str | None = None) -> list[bytes]:
    """Records of a capture; without a payload it is a revisit of page ``refers_to``, captured from ``refers_uri``."""
    ids = {kind: f"urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}" for kind in ("main", "request", "metadata") for h in [hashlib.sha256(f"{capture}/{kind}".encode()).hexdigest()]}
    target = {"WARC-Target-URI": url}
    main = target | {"WARC-Payload-Digest": f"sha256:{digest}"}
    if payload is None:
        main |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Target-URI": refers_uri or "", "WARC-Refers-To-Date": EPOCH, "WARC-Refers-To-Page": str(refers_to)}
        first = record("revisit", ids["main"], b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n", main, "application/http; msgtype=response")
    else:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        first = record("response", ids["main"], head + payload, main, "application/http; msgtype=response")
    beside = target | {"WARC-Concurrent-To": f"<{ids['main']}>"}
    request = record("request", ids["request"], b"GET / HTTP/1.1\r\nAccept: text/html\r\n\r\n", beside, "application/http; msgtype=request")
    fields = f"page-id: {'' if page_id is None else page_id}\r\npayload-bytes: {n_bytes}\r\n".encode()
    return [request, first, record("metadata", ids["metadata"], fields, beside, "application/warc-fields")]


def information(name: str) -> bytes:
    """The record that opens an archive."""
    h = hashlib.sha256(f"{name}/warcinfo".encode()).hexdigest()
    return record("warcinfo", f"urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}", b"software: lexiloom\r\nformat: WARC File Format 1.1\r\n", {"WARC-Filename": name.rpartition("/")[2]}, "application/warc-fields")


def read_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and body of each record of a gzip archive, whose bytes come in chunks."""
    unpack, buffer = zlib.decompressobj(31), bytearray()

    def whole() -> tuple[dict[str, str], bytes] | None:
        end = buffer.find(b"\r\n\r\n")
        if end < 0:
            return None
        lines = bytes(buffer[:end]).decode("utf-8", "surrogatepass").split("\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        length = int(headers["Content-Length"])
        if len(buffer) < end + 8 + length:
            return None
        body = bytes(buffer[end + 4 : end + 4 + length])
        del buffer[: end + 8 + length]
        return headers, body

    for chunk in chunks:
        while chunk:
            buffer += unpack.decompress(chunk)
            chunk = b""
            if unpack.eof:  # a member is a record
                chunk, unpack = unpack.unused_data, zlib.decompressobj(31)
                while buffer and (found := whole()):
                    yield found
    if buffer:
        raise ValueError("an archive ends within a record")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write captures (page_id, url, html, digest, refers_to, refers_uri) as archives; the files written, as (path, captures).

    Each task writes its files under names of its attempt and then moves them to
    their final names, so a task that runs again replaces its own files. A file
    ends after ARCHIVE bytes.
    """
    arrow_batches(pages.sparkSession)
    source = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), "digest", "refers_to", "refers_uri")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        out, name, n, done = None, "", 0, []

        def close() -> None:
            out.close()
            system.move(f"{name}.{task.taskAttemptId()}.tmp", f"{name}.warc.gz")
            done.append((f"{name}.warc.gz", n))

        for batch in batches:
            for page_id, url, html, digest, refers, uri in zip(*[c.to_pylist() for c in batch.columns]):
                if out is not None and out.tell() >= ARCHIVE:
                    close()
                    out = None
                if out is None:
                    system.create_dir(root, recursive=True)
                    name, n = f"{root}/part-{task.partitionId():06d}-{len(done):04d}", 0
                    out = system.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp", compression=None)
                    out.write(member(information(f"{name}.warc.gz")))
                body = html.encode("utf-8", "surrogatepass")
                for r in capture_records(f"{name}/{n}", page_id, url or "", None if refers is not None else body, digest, len(body), refers, uri):
                    out.write(member(r))
                n += 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["path", "captures"])

    return materialise(source.mapInArrow(run, "path string, captures long"), "archives")


def scan_records(paths: DataFrame, folder: str) -> DataFrame:
    """(type, record_id, concurrent_to, uri, digest, refers_to, fields, length, sha256) of every record in the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        names = ["type", "record_id", "concurrent_to", "uri", "digest", "refers_to", "fields", "length", "sha256"]
        kinds = [pa.string()] * 7 + [pa.int64(), pa.string()]

        def chunks(path: str) -> Iterator[bytes]:
            with system.open_input_stream(path, compression=None) as f:
                while data := f.read(READ):
                    yield data

        rows: list[tuple] = []
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for h, body in read_records(chunks(path)):
                    kind = h["WARC-Type"]
                    payload = body.partition(b"\r\n\r\n")[2] if kind == "response" else b""
                    rows.append((kind, h["WARC-Record-ID"], h.get("WARC-Concurrent-To"), h.get("WARC-Target-URI"), h.get("WARC-Payload-Digest", "").rpartition(":")[2] or None, h.get("WARC-Refers-To-Page"), body.decode() if kind == "metadata" else None, len(payload) if kind == "response" else None, hashlib.sha256(payload).hexdigest() if kind == "response" else None))
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
                        rows.clear()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return paths.select("path").mapInArrow(run, "type string, record_id string, concurrent_to string, uri string, digest string, refers_to string, fields string, length long, sha256 string")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, main (response or revisit) and metadata, joined by concurrent-to.

    Record ids are unique, so all records of a capture, and nothing else, meet
    under its main record's id. A capture without a request or without metadata
    has null there; records that name no main record of the archives are left out.
    """
    of = F.when(F.col("type").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to"))
    body = F.struct("type", "record_id", "uri", "digest", "refers_to", "fields", "length", "sha256")
    part = lambda *kinds: F.first(F.when(F.col("type").isin(*kinds), body), ignorenulls=True)
    joined = records.where("type in ('response', 'revisit', 'request', 'metadata')").groupBy(of.alias("capture"))
    return joined.agg(part("request").alias("request"), part("response", "revisit").alias("main"), part("metadata").alias("metadata")).where("main is not null")


def dedupe(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Adds digest, refers_to and refers_uri: of equal payloads of at least ``least`` bytes, the smallest page_id (else null) and its url.

    The smallest id itself refers to nothing; of several urls with it, the least counts. Only payloads that occur again
    are joined; their groups' minimum is combined before it is shuffled.
    """
    text = F.coalesce(F.col("html"), F.lit(""))
    hashed = pages.select("page_id", "url", "html").withColumn("digest", F.sha2(text.cast("binary"), 256))
    groups = hashed.where(F.octet_length(text) >= least).groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    return hashed.join(groups, "digest", "left").withColumn("refers_to", F.when(F.col("page_id").eqNullSafe(F.col("first.page_id")), None).otherwise(F.col("first.page_id"))).withColumn("refers_uri", F.when(F.col("refers_to").isNotNull(), F.col("first.url"))).drop("first")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives of all pages, written, read back and assembled: one row per page.

    A null html is an empty payload, a null url an empty target. Rows with the
    same page_id and payload are all responses if that id is the smallest of
    the payload, and all revisits otherwise; a null page_id is never the
    smallest. An empty table gives an empty result, and columns other than
    page_id, url and html are not read.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    files = write_archives(dedupe(pages), folder)
    # A task for each archive: by number, or Spark would put the few small rows of paths into one task.
    captures = assemble(scan_records(files.repartition(max(1, files.count())), folder))
    field = lambda name: F.nullif(F.regexp_extract("metadata.fields", rf"{name}: (-?\d*)", 1), F.lit("")).cast("long")
    return captures.select(
        field("page-id").alias("page_id"),
        F.coalesce("main.length", field("payload-bytes")).alias("payload_bytes"),
        F.coalesce("main.sha256", "main.digest").alias("payload_digest"),
        F.col("main.type").alias("record_type"),
        F.col("main.refers_to").cast("long").alias("refers_to"),
    )
