"""WARC archives: write records with revisits, read them as a table of payload chunks."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

#: Bytes of a chunk, and chunk bytes of one Arrow batch.
CHUNK, BATCH_BYTES = 1 << 16, 1 << 22
#: Compressed bytes after which a task begins another archive.
ROLL_BYTES = 1 << 26
#: Most tasks that read archives; with more archives each task reads several.
READ_TASKS = 100_000
DATE = "2024-01-01T00:00:00Z"
_ID = re.compile(r"<urn:x-page:(-?\d+|null)>")

MANIFEST = "path string, n_records long, n_bytes long"
CHUNKS = ("path string, page_id long, url string, record_type string, refers_to long, "
          "header_digest string, chunk_no int, data binary, payload_bytes long, "
          "payload_digest string, last boolean, complete boolean")


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _record(page_id, url, digest: str, n_bytes: int, refers_to) -> bytes:
    """The header of a record, with the HTTP header that begins its block."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {n_bytes}\r\n\r\n").encode()
    revisit = refers_to is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}",
              "Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(http) + (0 if revisit else n_bytes)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def planned(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) with digest (hexadecimal SHA-1), payload_bytes and refers_to.

    Of records with equal payloads of at least least_bytes, that with the largest page_id stands
    for all; refers_to is its page_id in the others and null in itself and in smaller payloads.
    Of several rows with that page_id and payload the first by url stands, and the others refer to
    their own page_id. Groups are reduced to a row each before their shuffle and joined back to
    (page_id, digest) rows, never gathered; html moves once, by page_id.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn(
        "payload_bytes", F.octet_length("html").cast("long"))
    key = ["page_id", "digest"]
    counted = stored(rows.filter("page_id is not null").groupBy(*key).agg(
        F.first("payload_bytes").alias("payload_bytes"), F.count(F.lit(1)).alias("n")))
    largest = counted.groupBy("digest").agg(F.max("page_id").alias("owner"))
    linked = counted.filter(F.col("payload_bytes") >= least_bytes).join(largest, "digest")
    links = linked.filter("owner != page_id").select(*key, F.col("owner").alias("refers_to"))
    ties = stored(linked.filter("owner = page_id and n > 1").select(*key))
    first = F.row_number().over(Window.partitionBy(*key).orderBy("url")) == 1
    settled = rows.join(ties, key).withColumn("refers_to", F.when(~first, F.col("page_id")))
    return rows.join(ties, key, "left_anti").join(links, key, "left").unionByName(settled)


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write a record for each page and return the manifest (path, n_records, n_bytes).

    Each task writes gzip archives, a member for each record, and feeds payloads to the compressor
    in chunks. The manifest is stored and lists finished archives only; files of lost or repeated
    tasks are not in it. A record whose page_id is null never refers and is never referred to;
    repeated rows are written each, one of them as the response that the others refer to. A null
    html is an empty payload, a null url leaves the header out; other columns are left out. An
    empty table has an empty manifest.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)
        name, sink, n, size, done = "", None, 0, 0, []
        for batch in batches:
            data = batch["html"]
            for i, (page, url, digest, refers, total) in enumerate(zip(
                    *(batch[c].to_pylist() for c in
                      ("page_id", "url", "digest", "refers_to", "payload_bytes")), strict=True)):
                if sink is None:
                    name, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = system.open_output_stream(name, compression=None)
                member = zlib.compressobj(6, wbits=31)
                base32 = base64.b32encode(bytes.fromhex(digest)).decode()
                parts = [member.compress(_record(page, url, base32, total, refers))]
                if refers is None:
                    payload = memoryview(data[i].as_buffer())
                    for at in range(0, total, CHUNK):
                        parts.append(member.compress(payload[at:at + CHUNK]))
                        size += sink.write(b"".join(parts)) or sum(map(len, parts))
                        parts = []
                parts += [member.compress(b"\r\n\r\n"), member.flush()]
                sink.write(b"".join(parts))
                n, size = n + 1, size + sum(map(len, parts))
                if size >= ROLL_BYTES:
                    sink.close()
                    done.append((name, n, size))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((name, n, size))
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*done, strict=True)], ["path", "n_records", "n_bytes"])

    small_batches(pages.sparkSession)
    system, base = _file_system(folder)
    system.create_dir(base, recursive=True)
    return stored(planned(pages, least_bytes).mapInArrow(run, MANIFEST))


def _header(stream: io.BufferedReader) -> dict[str, str] | None:
    """The named fields of the next record; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    fields = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def _number(urn: str | None) -> int | None:
    found = _ID.fullmatch(urn or "")
    return None if not found or found[1] == "null" else int(found[1])


def chunks_of(path: str, chunk: int = CHUNK) -> Iterator[dict]:
    """The chunk rows of an archive, plain or gzip; never more than a chunk of payload at a time."""
    system, local = _file_system(path)
    with system.open_input_stream(local, compression=None) as raw:
        packed = local.endswith(".gz")
        stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if packed else raw, 1 << 17)
        while (fields := _header(stream)) is not None:
            left = int(fields.get("content-length", 0))
            stated = 0
            if fields.get("content-type", "").startswith("application/http"):
                while left:
                    line = stream.readline(left)
                    left -= len(line)
                    if line.lower().startswith(b"content-length:"):
                        stated = int(line.partition(b":")[2])
                    if line in (b"\r\n", b"\n", b""):
                        break
            kind = fields.get("warc-type")
            given = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
            row = {"path": path, "page_id": _number(fields.get("warc-record-id")),
                   "url": fields.get("warc-target-uri"), "record_type": kind,
                   "refers_to": _number(fields.get("warc-refers-to")), "header_digest": given}
            if kind == "revisit":
                yield row | {"chunk_no": 0, "data": b"", "payload_bytes": stated,
                             "payload_digest": given, "last": True, "complete": True}
                continue
            digest, seen, number = hashlib.sha1(), 0, 0
            while True:
                data = stream.read(min(chunk, left))
                left -= len(data)
                seen += len(data)
                digest.update(data)
                so_far = base64.b32encode(digest.digest()).decode()
                last = not left or not data
                yield row | {"chunk_no": number, "data": data, "payload_bytes": seen,
                             "payload_digest": so_far, "last": last,
                             "complete": not left and given in (None, so_far) if last else None}
                if last:
                    break
                number += 1


def read(manifest: DataFrame) -> DataFrame:
    """The chunk table of the archives in manifest(path): rows (path, page_id, chunk_no, data, ...).

    payload_bytes and payload_digest are those of the payload up to and with the chunk, so a
    record's last chunk (`last`) has them for all of it, and `complete` tells whether the payload
    ended as announced and its digest is that of the header. A revisit is one row without data,
    with the length and digest of the payload it stands for. An empty payload is one empty chunk.
    Each archive is read by one task, in one pass; ROLL_BYTES bounds an archive. The number of
    tasks follows the number of archives, because the manifest's few bytes say nothing of the work.
    """
    names = [f.split()[0] for f in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.split()[0], {
            "string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(),
            "boolean": pa.bool_()}[f.split()[1]]) for f in CHUNKS.split(", ")])
        for batch in batches:
            for path in batch["path"].to_pylist():
                rows, held = [], 0
                for row in chunks_of(path):
                    rows.append(row)
                    held += len(row["data"]) + 256
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    tasks = max(1, min(manifest.count(), READ_TASKS))
    return manifest.select("path").repartition(tasks).mapInArrow(run, CHUNKS).select(*names)
