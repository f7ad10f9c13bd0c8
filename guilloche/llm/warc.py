"""WARC archives: one gzip member for each record, written and read in sequence.

The reader inflates a file piece by piece, so it holds one record at a time; it frames the
block by its content length and verifies both digests.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, small, stage

_VERSION = b"WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: A file is closed after the record with which it exceeds this size.
ARCHIVE_BYTES = 32 << 20
_MANIFEST = "path string, n_records long, n_bytes long"
_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member; with ``refers_to`` a revisit, whose block has no payload."""
    digest = hashlib.sha1(payload).hexdigest()
    block = _HTTP % len(payload) + (payload if refers_to is None else b"")
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{uuid.uuid4() if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(2, "WARC-Target-URI: " + " ".join(url.split()))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(_VERSION + b"\r\n" + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def members(stream, chunk: int = 1 << 20):
    """Inflated gzip members of a file-like object, one after the other."""
    inflate, data, begun = zlib.decompressobj(31), bytearray(), False
    while piece := stream.read(chunk):
        while piece:
            data += inflate.decompress(piece)
            begun = True
            piece = inflate.unused_data
            if inflate.eof:
                yield bytes(data)
                inflate, begun = zlib.decompressobj(31), False
                data.clear()
    if begun:
        raise ValueError("the archive ends within a record")


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP head and payload of a record; ValueError if framing or a digest is wrong."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != _VERSION:
        raise ValueError("no record header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "surrogatepass").partition(":") for x in lines[1:])}
    length = int(fields["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')}: the block is not {length} bytes long")
    if fields["warc-block-digest"] != "sha1:" + hashlib.sha1(block).hexdigest():
        raise ValueError(f"record {fields.get('warc-record-id')}: wrong block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields["warc-type"] == "response" and fields["warc-payload-digest"] != "sha1:" + hashlib.sha1(payload).hexdigest():
        raise ValueError(f"record {fields.get('warc-record-id')}: wrong payload digest")
    return fields, http, payload


def _page(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name.lstrip("-").isdigit() else None


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, payload and ``refers_to``: the largest page_id with an equal payload, null for that page itself.

    The pages are not shuffled while few payloads occur more than once: only digests are
    grouped, before they meet the pages again.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload")).withColumn("_sha", F.sha1(F.col("payload").cast("binary")))
    large = F.octet_length("payload") >= min_bytes
    twice = rows.where(large).groupBy("_sha").agg(F.count("*").alias("n"), F.max("page_id").alias("_last")).where("n > 1").select("_sha", "_last")
    joined = rows.join(small(stage(twice, "equal-payloads")), "_sha", "left")
    refers = F.when(large & ~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last"))
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, *, min_bytes: int = 1000, archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each page below ``path``; returns the manifest of the files.

    Of pages with equal payloads of at least ``min_bytes`` that with the largest page_id is a
    response and the others revisit it; rows that repeat it are responses too. Null html is
    an empty payload, a null url has no target field, a null page_id a random record id.
    File names are new for each attempt of a task: the manifest has those that count.
    """

    def write(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        out, name, n, size = None, "", 0, 0
        done = []
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4))):
                page_id, url, payload, refers = (x.as_py() for x in row)
                if out is None:
                    store.create_dir(base, recursive=True)
                    name, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(name, compression=None)
                data = record(page_id, url, payload.encode("utf-8", "surrogatepass"), refers, date)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    done.append((name, n, size))
        if out is not None:
            out.close()
            done.append((name, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["path", "n_records", "n_bytes"])

    return stage(revisits(pages, min_bytes).mapInArrow(write, _MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, path: str, *, with_payload: bool = True) -> DataFrame:
    """Records of the archives in the manifest (columns ``_RECORD``, then ``payload``), one task for each few files.

    Payload length and digest are of the full payload: verified for a response, as recorded
    for a revisit, whose payload is null. A damaged or cut-off archive raises ValueError.
    """
    files = manifest.select("path").repartition(max(1, manifest.count()))
    names = [x.split()[0] for x in _RECORD.split(", ")] + ["payload"] * with_payload

    def read(batches):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(file, compression=None) as stream:
                    for data in members(stream):
                        fields, http, payload = parse(data)
                        full = fields["warc-type"] == "response"
                        length = len(payload) if full else int(http.lower().partition(b"content-length:")[2].split(b"\r\n")[0])
                        rows.append((_page(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], _page(fields.get("warc-refers-to")), length, fields["warc-payload-digest"].removeprefix("sha1:"), payload if full else None))
                        size += len(data) if with_payload else 0
                        if size > 8 << 20 or len(rows) >= 5000:
                            yield _batch(rows, names)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, names)

    return files.mapInArrow(read, _RECORD + ", payload binary" * with_payload)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k, _ in zip(zip(*rows), kinds, names)], names)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path, min_bytes=1000)
    return read_archives(manifest, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS last FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to
FROM d LEFT JOIN m USING (payload_digest)
"""
