"""WARC archives: a writer of one gzip member per record and a sequential reader.

Writer: a page's record is ``response``, or ``revisit`` when an equal payload of at least ``min_revisit_bytes`` has its record
under a larger page id. Each task writes one archive in the shared folder under a name of its own attempt; the returned manifest
(one row per archive) names the archives that count, so a lost or repeated task leaves no half-written archive among them.

Reader: reads a stream in fixed blocks, inflates one member at a time with zlib, frames the record by its Content-Length, and
checks block and payload digests; it holds one record at a time.

Defined cases: null html is an empty payload; rows with a null page_id are responses without an id; rows that repeat the largest
page_id of a payload are all responses. An empty table gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm.common import new_folder

BLOCK = 1 << 16
MANIFEST = "path string, n_records long, n_bytes long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def with_references(pages: DataFrame, min_revisit_bytes: int = 1000) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is set for revisits.

    Only payloads that occur more than once enter the join; of a payload that very many rows share, the join's other side is one
    row, and adaptive execution splits the rows.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    long = pages.where(F.octet_length("html") >= min_revisit_bytes)
    last = long.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")
    return pages.join(last, "digest", "left").withColumn("refers_to", F.when(F.col("page_id") < F.col("last"), F.col("last"))).drop("last")


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP head, whose Content-Length is the full payload's."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {_digest(payload)}", f"WARC-Block-Digest: {_digest(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 1000) -> list[tuple[str, int, int]]:
    """Writes all pages; returns the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        path, count, size, out = f"{top}/{uuid.uuid4().hex}.warc.gz", 0, 0, None
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c for c in batch.columns)):
                out = out or store.open_output_stream(path, compression=None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = record(page_id.as_py(), url.as_py(), html.cast(pa.binary()).as_py(), refers_to.as_py())
                data = packer.compress(data) + packer.flush()
                out.write(data)
                count, size = count + 1, size + len(data)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count]), pa.array([size])], names=["path", "n_records", "n_bytes"])

    rows = with_references(pages, min_revisit_bytes).select("page_id", "url", "html", "refers_to").mapInArrow(run, MANIFEST)
    return [tuple(r) for r in rows.collect()]


class Corrupt(ValueError):
    """A record that breaks framing or fails its digest."""


def members(stream: BinaryIO) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as inflated pieces; each must be used up before the next."""
    rest = stream.read(BLOCK)

    def pieces() -> Iterator[bytes]:
        nonlocal rest
        unpacker = zlib.decompressobj(31)
        while not unpacker.eof:
            if not rest and not (rest := stream.read(BLOCK)):
                raise Corrupt("a member ends early")
            got = unpacker.decompress(rest, BLOCK)
            rest = unpacker.unused_data if unpacker.eof else unpacker.unconsumed_tail
            if got:
                yield got

    while rest or (rest := stream.read(BLOCK)):
        yield pieces()


def read_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, block digest verified."""
    for member in members(stream):
        data = bytearray()
        end = -1
        for piece in member:
            data += piece
            if end < 0 and (end := data.find(b"\r\n\r\n")) >= 0:
                version, *lines = data[:end].decode().split("\r\n")
                fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
                size = int(fields["Content-Length"])
        if end < 0 or not version.startswith("WARC/") or len(data) != end + 4 + size + 4 or data[-4:] != b"\r\n\r\n":
            raise Corrupt("a record is not framed by its Content-Length")
        block = bytes(data[end + 4 : end + 4 + size])
        if _digest(block) != fields["WARC-Block-Digest"]:
            raise Corrupt("a block fails its digest")
        yield fields, block


def _page(text: str | None) -> int | None:
    number = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read_archives(spark: SparkSession, folder: str, manifest: list[tuple[str, int, int]]) -> DataFrame:
    """One row per record of the manifest's archives; payload digests are verified where the payload is there."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, count, _ in zip(*(c.to_pylist() for c in batch.columns)):
                rows, seen = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for fields, block in read_records(stream):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
                        if fields["WARC-Type"] == "response" and (len(payload) != size or _digest(payload) != fields["WARC-Payload-Digest"]):
                            raise Corrupt("a payload fails its length or digest")
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        rows.append((_page(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], _page(fields.get("WARC-Refers-To")), fields["WARC-Target-URI"]))
                        seen += 1
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows = []
                if seen != count:
                    raise Corrupt(f"{path} holds {seen} of {count} records")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    archives = spark.createDataFrame(manifest, MANIFEST)
    return archives.repartition(max(1, len(manifest))).mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 1000) -> DataFrame:
    """Writes archives into a new shared folder and reads them back."""
    folder = new_folder(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder, min_revisit_bytes)
    return read_archives(pages.sparkSession, folder, manifest)
