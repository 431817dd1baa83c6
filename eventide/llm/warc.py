"""Deterministic sharded WARC writer and reader.

``write_archives`` range-sorts records by (payload digest, page_id), so every run over the same
rows gives the same files: a task writes its range as a series of gzip-compressed WARC files and
starts the next file when the compressed size passes ``roll_bytes``.  All headers are made anew
(lengths, digests, record ids from the content), nothing depends on time or place.  Files are
written under temporary names that carry the task attempt; the tasks' manifest rows are kept in
the shared folder, and only then a second job renames exactly the files of the manifest to their
final names (again without harm if it is repeated) and the manifest is written beside them.
Files that lost attempts leave behind are never in a manifest.

De-duplication: of records with equal payloads of at least ``min_dedup_bytes`` the one with the
largest page_id is the response and the others are revisit records without payload that refer to
it.  Which digests repeat is counted on digests alone (partial sums before the shuffle); the table
of repeated digests is broadcast if its counted rows are few and shuffled otherwise.

Defined cases
* null html: empty payload; null url: an empty target; null page_id: an empty id, smaller than any;
* very long pages: a record larger than ``roll_bytes`` fills a file of its own;
* ties: rows that repeat the largest page_id with the same payload are all responses;
* empty table: no files, an empty manifest and no records; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import partitions, scratch_path, slices, small, texts, written

ROLL_BYTES = 64 << 20
MIN_DEDUP_BYTES = 1000
LEVEL = 3
#: A fixed date: archives of the same rows are the same bytes.
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "temp string, name string, records long, bytes long, sha1 string"
RECORDS = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
           "refers_to long, payload binary")


def _number(x) -> str:
    return "" if x is None else str(x)


def record(page_id, url, payload: bytes, sha1: bytes, revisit: bool, refers_to, date: str = DATE) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    digest = "sha1:" + base64.b32encode(sha1).decode()
    name = hashlib.sha1(b"\n".join((_number(page_id).encode(), (url or "").encode(), sha1, b"revisit" if revisit else b"response"))).digest()
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <urn:uuid:{uuid.UUID(bytes=name[:16], version=5)}>", f"WARC-Date: {date}",
             f"WARC-Target-URI: {''.join((url or '').split())}", f"X-Page-ID: {_number(page_id)}",
             f"WARC-Payload-Digest: {digest}", "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(),
             f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {_number(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(stream):
    """(headers, block) of every record of an uncompressed WARC stream; checks block digests."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            headers[k.strip().lower()] = v.strip()
        block = stream.read(int(headers["content-length"]))
        want = headers.get("warc-block-digest")
        if want and want != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
            raise ValueError(f"block digest of {headers.get('warc-record-id')} does not match")
        yield headers, block


def _store(path: str):
    """A pyarrow filesystem and the path inside it, for any URI it knows or a plain path."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Roller:
    """Writes records into files under temporary names, a gzip member each, by compressed size."""

    def __init__(self, folder: str, part: int, attempt: str, roll_bytes: int):
        self.fs, self.folder = _store(folder)
        self.part, self.attempt, self.roll = part, attempt, roll_bytes
        self.serial, self.out, self.done = 0, None, []

    def add(self, raw: bytes):
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        data = packer.compress(raw) + packer.flush()
        if self.out is not None and self.size + len(data) > self.roll:
            self.close()
        if self.out is None:
            self.name = f"part-{self.part:05d}-{self.serial:05d}.warc.gz"
            self.temp = f"_temporary/{self.name}.{self.attempt}"
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.temp}")
            self.size, self.records, self.sha1 = 0, 0, hashlib.sha1()
        self.out.write(data)
        self.sha1.update(data)
        self.size += len(data)
        self.records += 1

    def close(self):
        if self.out is not None:
            self.out.close()
            self.done.append((self.temp, self.name, self.records, self.size, self.sha1.hexdigest()))
            self.out, self.serial = None, self.serial + 1


def with_roles(pages: DataFrame, min_dedup_bytes: int = MIN_DEDUP_BYTES) -> DataFrame:
    """page_id, url, html, digest, payload_bytes, revisit, refers_to."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"),
                        F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    groups = (rows.where(F.col("payload_bytes") >= min_dedup_bytes).groupBy("digest", "payload_bytes")
              .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    groups = written(groups.select("digest", "payload_bytes", "response", F.lit(True).alias("many")), "warc-groups")
    joined = rows.join(small(groups, groups.count()), ["digest", "payload_bytes"], "left")
    revisit = F.coalesce("many", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("response"))
    return joined.select("page_id", "url", "html", "digest", "payload_bytes", revisit.alias("revisit"),
                         F.when(revisit, F.col("response")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, *, roll_bytes: int = ROLL_BYTES, n_ranges: int | None = None,
                   min_dedup_bytes: int = MIN_DEDUP_BYTES) -> DataFrame:
    """Write one record per row under ``folder``; returns the committed manifest (name, records,
    bytes, sha1 of every file)."""
    spark = pages.sparkSession
    fs, inner = _store(folder)
    fs.create_dir(f"{inner}/_temporary", recursive=True)
    run = uuid.uuid4().hex[:8]

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        context = TaskContext.get()
        out = _Roller(folder, context.partitionId(), f"{run}-{context.taskAttemptId()}", roll_bytes)
        for b in (s for batch in batches for s in slices(batch, "html")):
            html = texts(b.column("html"))
            cols = [b.column(n).to_pylist() for n in ("page_id", "url", "revisit", "refers_to", "digest")]
            for text, page_id, url, revisit, refers_to, digest in zip(html, *cols, strict=True):
                out.add(record(page_id, url, text.encode(), bytes.fromhex(digest), revisit, refers_to))
        out.close()
        if out.done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out.done, strict=True)],
                                             names=["temp", "name", "records", "bytes", "sha1"])

    rows = with_roles(pages, min_dedup_bytes)
    order = ["digest", F.desc_nulls_last("page_id"), F.asc_nulls_first("url")]
    ranged = rows.repartitionByRange(n_ranges or partitions(spark), *order).sortWithinPartitions(*order)
    manifest = written(ranged.mapInArrow(write, MANIFEST), "warc-manifest")

    def commit(batches):  # renames only what the manifest names; a repeated task finds the work done
        import pyarrow as pa
        from pyarrow.fs import FileType
        fs, inner = _store(folder)
        for b in batches:
            for temp, name, size in zip(*(b.column(n).to_pylist() for n in ("temp", "name", "bytes")), strict=True):
                if fs.get_file_info(f"{inner}/{temp}").type == FileType.File:
                    fs.move(f"{inner}/{temp}", f"{inner}/{name}")
                found = fs.get_file_info(f"{inner}/{name}")
                if found.type != FileType.File or found.size != size:
                    raise OSError(f"{name}: not committed")
            yield b.select(["name", "records", "bytes", "sha1"])

    committed = manifest.mapInArrow(commit, "name string, records long, bytes long, sha1 string")
    committed.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/_manifest")
    return spark.read.schema(committed.schema).parquet(f"{folder.rstrip('/')}/_manifest")


def read_archives(spark: SparkSession, folder: str, *, with_payload: bool = True) -> DataFrame:
    """The records (columns of ``RECORDS``) of all files that the manifest names, digests checked."""
    files = spark.read.parquet(f"{folder.rstrip('/')}/_manifest").select("name")
    n = max(1, min(files.count(), 4 * partitions(spark)))

    def read(batches):
        import gzip

        import pyarrow as pa
        fs, inner = _store(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                            ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        rows, held = [], 0

        def batch():
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_stream(f"{inner}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as f:
                    for head, block in parse(io.BufferedReader(f, 1 << 20)):
                        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:"))
                        payload = None
                        if head["warc-type"] == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4:]
                            if hashlib.sha1(payload).digest() != digest:
                                raise ValueError(f"{name}: payload digest of page {head['x-page-id']} does not match")
                        page, refers = (int(x) if x else None for x in (head["x-page-id"], head.get("x-refers-to-page-id", "")))
                        size = len(payload) if payload is not None else int(head["x-payload-length"])
                        rows.append((page, head["warc-target-uri"], head["warc-type"], size, digest.hex(), refers,
                                     payload if with_payload else None))
                        held += size
                        if held > 8_000_000 or len(rows) >= 5_000:
                            yield batch()
                            rows, held = [], 0
        if rows:
            yield batch()
    return files.repartition(n).mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write archives into the shared folder and read their records back, without payloads."""
    folder = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, folder, **options)
    return read_archives(pages.sparkSession, folder, with_payload=False)
