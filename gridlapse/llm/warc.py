"""WARC archives with revisit records in place of repeated payloads.

The headers (page id, payload length, SHA-256) are grouped by digest, which finds each repeated
payload's first page; pages join that list, and every task writes what it holds as an archive of its
own: a ``response`` with the payload, or a ``revisit`` that names the response's record and has fresh
headers but no payload. Files get names of their own and count only once a finished task has
reported them in the manifest, so a lost or repeated task leaves nothing behind that is read.

Every record is a gzip member, so an archive can be read from any record on. Defined results:

* a null payload is the empty one; payloads below ``min_bytes`` are never deduplicated;
* of equal payloads the page with the smallest id is the response; rows that repeat that id are
  responses too. A null id is larger than any other; if all are null, all are responses;
* a null address leaves out ``WARC-Target-URI``; further columns are not written;
* an empty table gives an empty manifest, read back as no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlapse.llm.common import fresh_folder, output_name, stage, store

MANIFEST = "path string, records long, bytes long"
RECORDS = (
    "page_id long, record_id string, target_uri string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, verified boolean"
)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROLL_BYTES = 256 << 20
CHUNK = 1 << 20


def resolve_revisits(
    pages: DataFrame, *, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 100
) -> DataFrame:
    """Pages with digest, length, record type and the response that a revisit refers to.

    Only digests that occur twice are kept for the join. It is staged first, so that Spark may send
    it to all tasks if it is small, or split a hot digest's pages if it is not.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    headers = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        body.alias("payload"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        F.sha2(body.cast("binary"), 256).alias("payload_digest"),
    )
    first = (
        headers.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 and first_id is not null")
        .select(F.col("payload_digest").alias("first_digest"), "first_id")
    )
    first = stage(first, "responses")
    joined = headers.join(first, F.col("payload_digest") == F.col("first_digest"), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id",
        "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}:{digest}"


def record(page_id, url, payload, size: int, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record; the block is the HTTP header, for a response followed by the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id(page_id, digest)}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {' '.join(url.split())}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, digest)}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(resolved: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write the records; the staged manifest lists the finished files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = store(folder)
        out, name, records, size, done = None, "", 0, 0, []
        for batch in batches:
            payloads = batch.column("payload").cast(pa.binary())
            rest = [batch.column(c) for c in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")]
            for i in range(batch.num_rows):
                page, url, n, digest, kind, refers = (c[i].as_py() for c in rest)
                if out is None:
                    system.create_dir(path, recursive=True)
                    name, records, size = f"{output_name('pages')}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                packed = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packed.compress(record(page, url, payloads[i].as_py(), n, digest, kind, refers)) + packed.flush()
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= ROLL_BYTES:
                    out.close()
                    done.append((name, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records, size))
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{d[0]}" for d in done]), pa.array([d[1] for d in done]), pa.array([d[2] for d in done])],
                names=["path", "records", "bytes"],
            )

    return stage(resolved.mapInArrow(write, MANIFEST), "warc-manifest")


def members(stream) -> Iterator[bytes]:
    """The unpacked gzip members of a stream, one at a time."""
    unpack, parts, data = zlib.decompressobj(31), [], stream.read(CHUNK)
    while data:
        parts.append(unpack.decompress(data))
        if unpack.eof:
            yield b"".join(parts)
            data = unpack.unused_data or stream.read(CHUNK)
            unpack, parts = zlib.decompressobj(31), []
        else:
            data = stream.read(CHUNK)
    if any(parts):
        raise ValueError("an archive ends within a record")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:size]


def page_of(identifier: str) -> int | None:
    page = identifier.strip("<>").split(":")[2]
    return None if page == "null" else int(page)


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the listed archives; digests of responses are computed anew from the payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in RECORDS.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for uri in batch.column("path").to_pylist():
                system, path = store(uri)
                rows = []
                with system.open_input_stream(path, compression=None) as stream:
                    for member in members(stream):
                        fields, block = parse(member)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind = fields["warc-type"]
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        size = int(http.rpartition(b"Content-Length:")[2])
                        good = hashlib.sha256(block).hexdigest() == fields["warc-block-digest"].removeprefix("sha256:")
                        if kind == "response":
                            found = hashlib.sha256(payload).hexdigest()
                            good = good and found == digest and size == len(payload)
                            digest, size = found, len(payload)
                        identifier = fields["warc-record-id"].strip("<>")
                        refers = page_of(fields["warc-refers-to"]) if kind == "revisit" else None
                        rows.append((page_of(identifier), identifier, fields.get("warc-target-uri"), size, digest, kind, refers, good))
                        if len(rows) == 4096:
                            yield packed(rows)
                            rows = []
                if rows:
                    yield packed(rows)

    spread = manifest.repartition(max(1, 2 * manifest.sparkSession.sparkContext.defaultParallelism))
    return spread.mapInArrow(read, RECORDS)


def archive(pages: DataFrame, folder: str | None = None, *, min_bytes: int = 100, **columns: str) -> DataFrame:
    """Resolve revisits and write the archives below ``folder``; gives the manifest."""
    folder = folder or fresh_folder(pages.sparkSession, "warc")
    return write_archives(resolve_revisits(pages, min_bytes=min_bytes, **columns), folder)
