"""WARC archives in Zstandard: written one frame a record behind a dictionary, read back and validated.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself Zstandard-compressed,
trained on at most the first 256 payloads of the archive (up to 4 MB). Every record is one frame with a content
checksum. The reader loads the dictionary, decodes a frame at a time in memory bounded by one record, and checks the
version line, the mandatory headers, Content-Length against the block, the record's end, the HTTP length and the
payload digest; whatever is broken is a ``WarcError``. Archives are written by tasks straight into the shared folder under names of their own; a manifest,
committed by Spark's writer, lists those of the attempts that succeeded, so a lost executor leaves no half archive in it.

Payloads of at least 100 bytes that occur more than once are stored once: the row with the smallest id is the response,
the others are revisit records without payload that refer to it.

The folder is opened by Arrow's file systems in the tasks (local, HDFS, S3, GCS, ABFS; ``s3a`` is taken as ``s3``), the manifest by Spark's.

Defined results: a null payload is empty, a null url has no target header; a null id writes no page header, is never the
one referred to, and revisits the smallest known id; rows that repeat the smallest id with the same payload are responses
too; every record has an id of its own, from its archive and place, and revisits name the page they refer to; payloads of any
length are one record; empty tables give an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, slices, table, written

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")

MIN_SHARED, ROLL_BYTES, DICT_BYTES, TRAIN_RECORDS, TRAIN_BYTES = 100, 256 << 20, 32 << 10, 256, 4 << 20
MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


class WarcError(ValueError):
    """A record or archive that breaks the format."""


def _head(lines: list[tuple[str, object]]) -> str:
    return "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = "2020-01-01T00:00:00Z", name: str = "") -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP head alone. ``name`` tells it from all others."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    url = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    head = _head([
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name or f'page:{page_id}')}>"), ("WARC-Date", date),
        ("WARC-Target-URI", url), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Profile", PROFILE if refers_to is not None else None),
        ("WARC-Refers-To-Page-ID", refers_to),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ])
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the first samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[: DICT_BYTES // 2] or b"<html></html>"


def archive_head(data: bytes) -> bytes:
    packed = zstandard.ZstdCompressor().compress(data)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed


def parse_record(raw: bytes) -> dict:
    """The record's fields; raises WarcError where a header or a length is wrong."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    try:
        lines = head.decode("utf-8").split("\r\n")
    except UnicodeDecodeError as e:
        raise WarcError(f"the head is no UTF-8: {e}") from e
    if not sep or lines[0] != VERSION:
        raise WarcError(f"no {VERSION} head: {lines[0][:40]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"not a header: {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    if missing := [h for h in MANDATORY if h not in headers]:
        raise WarcError(f"headers missing: {missing}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {headers['content-length']}, block has {len(rest) - 4} bytes")
    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "")
    if kind not in ("response", "revisit") or not digest.startswith("sha256:"):
        raise WarcError(f"type {kind!r}, digest {digest[:20]!r}")
    http, sep, payload = rest[:-4].partition(b"\r\n\r\n")
    length = next((x.split(b":", 1)[1].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), b"")
    if not sep or not length.isdigit():
        raise WarcError("the HTTP head has no length")
    if kind == "response" and (len(payload) != int(length) or hashlib.sha256(payload).hexdigest() != digest[7:]):
        raise WarcError("the payload doesn't have the length or digest it claims")
    if kind == "revisit" and (payload or "warc-refers-to-page-id" not in headers or headers.get("warc-profile") != PROFILE):
        raise WarcError("not a revisit by identical payload digest")

    def number(h: str) -> int | None:
        if h in headers and not headers[h].removeprefix("-").isdecimal():
            raise WarcError(f"{h} is no number: {headers[h][:40]!r}")
        return int(headers[h]) if h in headers else None

    return {"page_id": number("warc-page-id"), "target_uri": headers.get("warc-target-uri"), "record_type": kind, "refers_to": number("warc-refers-to-page-id"), "payload_bytes": int(length), "payload_digest": digest[7:], "payload": payload if kind == "response" else None}


def read_archive(stream, chunk: int = 1 << 20) -> Iterator[dict]:
    """The records of an archive, frame by frame."""
    head = stream.read(8)
    magic, n = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    if magic != SKIPPABLE:
        raise WarcError("the archive doesn't start with a dictionary frame")
    data = stream.read(n)
    if len(data) != n:
        raise WarcError("the dictionary is cut short")
    try:
        if data[:4] == ZSTD_MAGIC:
            data = zstandard.ZstdDecompressor().decompress(data)
        decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
    except zstandard.ZstdError as e:
        raise WarcError(f"bad dictionary: {e}") from e
    left = stream.read(chunk)
    while left:
        frame, parts = decoder.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(left))
            except zstandard.ZstdError as e:
                raise WarcError(f"bad frame: {e}") from e
            if frame.eof:
                left = frame.unused_data or stream.read(chunk)
                break
            if not (left := stream.read(chunk)):
                raise WarcError("the last frame is cut short")
        yield parse_record(b"".join(parts))


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("s3" + path[3:] if path.startswith(("s3a:", "s3n:")) else path)


def _writer(root: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = _opened(root)
        disk.create_dir(base, recursive=True)
        part, out, made, packer = TaskContext.get().partitionId(), None, [], None
        for batch in (b for whole in batches for b in slices(whole, 2)):
            rows = zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True)
            rows = [(a, b, (c or "").encode("utf-8"), d, e) for a, b, c, d, e in rows]
            for page_id, url, payload, digest, refers in rows:
                if out is None:
                    path = f"{base}/{part:06d}-{uuid.uuid4().hex}.warc.zst"
                    samples, total = [], 0
                    for x in rows[:TRAIN_RECORDS]:
                        total += len(x[2])
                        samples += [x[2]] if x[4] is None and x[2] and (total <= TRAIN_BYTES or not samples) else []
                    data = dictionary([s[:TRAIN_BYTES] for s in samples])
                    packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data), write_checksum=True)
                    out, n = disk.open_output_stream(path, compression=None), 0
                    out.write(archive_head(data))
                out.write(packer.compress(record_bytes(page_id, url, payload, digest, refers, name=f"{path}#{n}")))
                n += 1
                if out.tell() > roll_bytes:
                    made.append((path, n, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            made.append((path, n, out.tell()))
            out.close()
        where = root.rstrip("/")
        yield pa.RecordBatch.from_pydict({"path": [f"{where}/{p.rsplit('/', 1)[1]}" for p, _, _ in made], "records": [n for _, n, _ in made], "bytes": [b for _, _, b in made]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return run


def _reader(with_payload: bool):
    fields = [("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(fields)
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                disk, name = _opened(path)
                rows, held, seen = [], 0, 0
                with disk.open_input_stream(name, compression=None) as stream:
                    for r in read_archive(stream):
                        if not with_payload:
                            r["payload"] = None
                        rows.append(r)
                        held, seen = held + len(r["payload"] or b""), seen + 1
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if seen != records:
                    raise WarcError(f"{path} has {seen} records, {records} were written")
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", folder: str | None = None, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes one or more archives a partition, a new one beyond ``roll_bytes``, and returns the manifest (path, records, bytes)."""
    spark = pages.sparkSession
    digest = F.sha2(F.coalesce(F.col(payload), F.lit("")), 256)
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(payload).cast("string").alias("html"), digest.alias("digest"))
    shared = rows.where(F.octet_length("html") >= MIN_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    shared = written(shared.select("digest", "first"), "warc-shared")  # its size is then known: small ones are broadcast
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    marked = rows.join(shared, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    root = folder or shared_dir(spark, "warc")
    return written(marked.mapInArrow(_writer(root, roll_bytes), MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The validated records of the archives in a manifest, an archive a task."""
    n = max(1, manifest.count())
    return manifest.select("path", "records").repartition(n).mapInArrow(_reader(with_payload), RECORD)


def op4_warc_zst(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(table(spark, sf_dir, "pages")), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")


OP4_SQL = f"""
with p as (select page_id, url, coalesce(html, '') html from pages),
d as (select page_id, url, octet_length(encode(html)) n, sha256(html) h from p),
f as (select h, min(page_id) first from d where n >= {MIN_SHARED} group by h)
select d.page_id, d.n::bigint payload_bytes, d.h payload_digest,
  case when f.first is null or f.first = d.page_id then 'response' else 'revisit' end record_type,
  case when f.first <> d.page_id then f.first end refers_to, d.url target_uri
from d left join f on d.h = f.h
"""
