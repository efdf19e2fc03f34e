"""WARC files: records are read one gzip member at a time, and a damaged file gives its whole records and a row that says so.

read_warc() reads through Spark's binary source, from any store Spark knows; a file is then one row, of at most 2 GB.
stream_warc() opens each file as a stream in the task, from what pyarrow's file systems reach, and holds one record at a time."""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "rec_type string, url string, status int, content_type string, body binary, error string"
_KIND = pa.schema([("rec_type", pa.string()), ("url", pa.string()), ("status", pa.int32()), ("content_type", pa.string()), ("body", pa.binary()), ("error", pa.string())])
#: Bytes of bodies after which a batch of records leaves; bytes read from a stream at once; seconds to wait for a server.
BATCH_BYTES, READ_BYTES, TIMEOUT = 8_000_000, 1 << 20, 300


def _headers(stream: io.BufferedIOBase) -> dict[str, str]:
    found: dict[str, str] = {}
    while (line := stream.readline()).strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found.setdefault(name.strip().lower(), value.strip())
    return found


def records(raw: io.BufferedIOBase) -> Iterator[dict]:
    """The records of a WARC file, compressed or not. What can't be read ends the file with a record that has only an error."""
    buffered = io.BufferedReader(raw) if not isinstance(raw, io.BufferedReader) else raw
    stream = gzip.GzipFile(fileobj=buffered) if buffered.peek(2)[:2] == b"\x1f\x8b" else buffered
    while True:
        try:
            line = stream.readline()
            while line and not line.strip():
                line = stream.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record begins with {line[:20]!r}")
            head = _headers(stream)
            size = int(head.get("content-length", "0"))
            payload = stream.read(size)
            if len(payload) < size:
                raise EOFError("the file ends within a record")
        except (EOFError, OSError, ValueError, zlib.error) as failed:
            yield {**dict.fromkeys(_KIND.names), "error": f"read failed: {failed}"}
            return
        record = {"rec_type": head.get("warc-type"), "url": head.get("warc-target-uri"), "status": None, "content_type": None, "body": payload, "error": None}
        if record["rec_type"] == "response" and payload.startswith(b"HTTP/"):
            inner = io.BytesIO(payload)
            first = inner.readline().split()
            http = _headers(inner)
            record["status"] = int(first[1]) if len(first) > 1 and first[1].isdigit() else None
            record["content_type"] = http.get("content-type")
            body = inner.read()
            if "chunked" in http.get("transfer-encoding", "").lower():
                body = _unchunked(body)
            if http.get("content-encoding", "").lower() == "gzip":
                try:
                    body = gzip.decompress(body)
                except (OSError, EOFError, zlib.error):
                    pass
            record["body"] = body
        yield record


def _unchunked(body: bytes) -> bytes:
    stream, parts = io.BytesIO(body), []
    while True:
        try:
            size = int(stream.readline().split(b";")[0] or b"0", 16)
        except ValueError:
            return body
        if not size:
            return b"".join(parts)
        parts.append(stream.read(size))
        stream.readline()


def _batches(name: str, found: Iterator[dict], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for record in found:
        held.append({"path": name, **record})
        size += len(record["body"] or b"")
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=kind)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, schema=kind)


def read_warc(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, rec_type, url, status, content_type, body, error of every record. Spark lists and reads the files, from any of its stores;
    a file is one row of Spark's binary source, and its records leave in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                yield from _batches(name, records(io.BytesIO(content.as_buffer())), kind)

    kind = pa.schema([("path", pa.string()), *_KIND])
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, f"path string, {RECORD}")


def _opened(name: str):
    """A file, from a server too, as a stream of bytes."""
    if name.startswith(("http://", "https://")):
        from urllib.request import urlopen

        return urlopen(name, timeout=TIMEOUT)
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(name) if "://" in name or name.startswith("file:") else (fs.LocalFileSystem(), name)
    return system.open_input_stream(inside, compression=None)


def stream_warc(paths: DataFrame, column: str = "path") -> DataFrame:
    """The same for files whose paths, URIs or web addresses stand in a column, each opened as a stream in its task: no file is ever held whole.
    A file that can't be opened is a row with an error. Files are dealt out one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                try:
                    with _opened(name) as stream:
                        yield from _batches(name, records(io.BufferedReader(stream, READ_BYTES)), kind)
                except (OSError, pa.ArrowException, TypeError) as failed:
                    yield from _batches(str(name), iter([{**dict.fromkeys(_KIND.names), "error": f"open failed: {failed}"}]), kind)

    kind = pa.schema([("path", pa.string()), *_KIND])
    given = paths.select(F.col(column).cast("string").alias("path"))
    return given.repartition(max(1, paths.sparkSession.sparkContext.defaultParallelism), "path").mapInArrow(run, f"path string, {RECORD}")


def file_totals(warc: DataFrame) -> DataFrame:
    """path, ok, records, html, body_bytes, error for each file."""
    from ..operators.ingest import html_response

    html = F.coalesce((F.col("rec_type") == "response") & html_response(F.col("status"), F.col("content_type")), F.lit(False))
    return warc.groupBy("path").agg(
        F.every(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNull()).alias("records"), F.count_if(html).alias("html"),
        F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).cast("long").alias("body_bytes"), F.max("error").alias("error"),
    )


def html_pages(warc: DataFrame) -> DataFrame:
    """url, html of the HTML responses; bytes that are not UTF-8 become replacement characters."""
    from ..operators.ingest import html_response

    wanted = warc.where((F.col("rec_type") == "response") & html_response(F.col("status"), F.col("content_type")))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [None if b is None else b.decode("utf-8", "replace") for b in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("url"), pa.array(text, pa.string())], names=["url", "html"])

    return wanted.select("url", "body").mapInArrow(decode, "url string, html string")
