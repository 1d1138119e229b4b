"""WARC archives: a deterministic sharded writer, and the reader.

Pages are range-sorted by id, in ranges found by counting (ranges.py), so the
same pages give the same files however they were partitioned; each range is
written to files that roll by compressed size. Every record is a gzip member of
its own with headers, digests and record ids made anew from the page, and no
clock enters, so a task that runs again writes the same bytes. Files get their
final names by a move; the manifest names the files that count, and each task
writes its own lines of it. A folder that holds anything is refused.

Equal payloads are stored once: the page with the largest id is the response,
the others are revisit records that refer to it. Winners come from an
aggregation over (digest, id) alone, without the payloads.

Defined results: null html is the empty payload; a null url is the empty URI.
Rows that repeat a page_id are all written: of equal payloads under the largest
id the first is the response, the rest revisit it. Null ids sort first and
count as smaller than any id. Extra columns are not written. An empty table
gives no files and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import files
from assayer.llm.common import even_keys, shared_dir, shuffle_partitions
from assayer.llm.ranges import borders, range_of

ROLL_BYTES = 64 << 20
LEVEL = 6
DATE = "2000-01-01T00:00:00Z"  # records carry a set date, not the clock
_SPACE = uuid.UUID("5f1f3a52-8a3e-4ed4-9e57-7c2a4bd0a7b1")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}|{digest}|{copy}')}>"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", LEVEL, mtime=0)


def _one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, copy: int) -> bytes:
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest, copy)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _one_line(url)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, 0))]
        if refers_to is not None:
            headers.append(("X-Refers-To-Page-Id", str(refers_to)))
    return _member(headers, block)


def decided(pages: DataFrame) -> DataFrame:
    """The pages and, before any page with a payload that others have too, a row without payload that tells the largest id of these.

    Both kinds go through one range sort, so payloads are shuffled once.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("_digest", F.unhex(F.sha1("html")))
    ids = rows.select("page_id", "_digest")
    winners = ids.groupBy("_digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).where("n > 1").drop("n")
    told = ids.distinct().join(winners, "_digest").select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"), "_digest", "winner")
    return rows.withColumn("winner", F.lit(None).cast("long")).unionByName(told)


def write(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, partitions: int | None = None) -> DataFrame:
    """Writes the archives and their manifest under folder, which must be empty or absent; returns the manifest (file, records, bytes, sha256)."""
    spark = pages.sparkSession
    files.refuse_if_used(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = files.open_fs(folder)
        file, name, part, number, digest, records = None, "", -1, 0, hashlib.sha256(), 0
        done: list[tuple] = []
        last, copy, told, winner = None, 0, None, None

        def close():
            file.commit()
            done.append((name, records, file.size, digest.hexdigest()))

        try:
            for batch in batches:
                for at, page_id, url, html, own, largest in zip(*(batch.column(c).to_pylist() for c in ("_range", "page_id", "url", "html", "_digest", "winner")), strict=True):
                    if html is None:
                        told, winner = (page_id, own), largest
                        continue
                    if told != (page_id, own):
                        winner = page_id
                    copy = copy + 1 if (page_id, own) == last else 0
                    last = (page_id, own)
                    member = _record(page_id, url, html, winner, winner != page_id or copy > 0, copy)
                    if file and (at != part or file.size + len(member) > roll_bytes):
                        close()
                        file = None
                    if at != part:
                        part, number = at, 0
                    if not file:
                        name = f"part-{part:06d}-{number:05d}.warc.gz"
                        file, digest, records, number = files.Pending(system, base, name), hashlib.sha256(), 0, number + 1
                        info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                        file.write(info)
                        digest.update(info)
                    file.write(member)
                    digest.update(member)
                    records += 1
                if len(done) > 1_000:
                    yield files.as_rows(["file", "records", "bytes", "sha256"], [pa.string(), pa.int64(), pa.int64(), pa.string()], done)
                    done.clear()
            if file:
                close()
                file = None
        finally:
            if file:
                file.drop()
        yield files.as_rows(["file", "records", "bytes", "sha256"], [pa.string(), pa.int64(), pa.int64(), pa.string()], done)

    n = partitions or shuffle_partitions(spark)
    cuts = borders(pages.select(F.col("page_id").cast("long").alias("page_id")), "page_id", n)
    at = F.element_at(F.lit(even_keys(spark, n).tolist()), F.col("_range") + 1)
    rows = decided(pages).withColumn("_range", range_of(F.col("page_id"), cuts)).withColumn("_key", at)
    rows = rows.repartition(n, "_key").sortWithinPartitions("_range", "page_id", "_digest", F.col("html").isNotNull(), "url")
    files.write_manifest(rows.drop("_key").mapInArrow(run, MANIFEST), folder)
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return files.read_manifest(spark, folder, MANIFEST)


def _members(stream: Iterator[bytes]) -> Iterator[bytes]:
    """The content of each gzip member; the file is never held whole."""
    unzip, parts = zlib.decompressobj(31), []
    for data in stream:
        while data:
            parts.append(unzip.decompress(data))
            data = unzip.unused_data
            if unzip.eof:
                yield b"".join(parts)
                unzip, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends inside a record")


def _parse(record: bytes) -> tuple | None:
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    if h["WARC-Type"] not in ("response", "revisit"):
        return None
    block = rest[: int(h["Content-Length"])]
    digest, revisit = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"] == "revisit"
    payload = b"" if revisit else block.partition(b"\r\n\r\n")[2]
    if h["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}" or not revisit and (digest != base32_sha1(payload) or len(payload) != int(h["X-Payload-Length"])):
        raise ValueError(f"digest mismatch in {h['WARC-Record-ID']}")
    page, refers = h.get("X-Page-Id"), h.get("X-Refers-To-Page-Id")
    return (page and int(page), h["WARC-Target-URI"], int(h["X-Payload-Length"]), digest, h["WARC-Type"], refers and int(refers), None if revisit else payload)


def read(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The page records of the files in the manifest. Digests are computed anew; a mismatch raises."""
    listed = read_manifest(spark, folder)
    names = [x for x in RECORDS.split(", ") if payload or not x.startswith("payload ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = files.open_fs(folder)
        for frame in frames:
            for name, expected in zip(frame.column("file").to_pylist(), frame.column("records").to_pylist(), strict=True):
                rows, held, count = [], 0, 0
                for record in _members(files.blocks(system, f"{base}/{name}")):
                    row = _parse(record)
                    if row:
                        rows.append(row[: len(names)])
                        count += 1
                        held += len(record) if payload else 200
                    if held > 4 << 20:
                        yield files.as_rows([x.split()[0] for x in names], kinds, rows)
                        rows, held = [], 0
                if count != expected:
                    raise ValueError(f"{name}: {count} records, the manifest has {expected}")
                yield files.as_rows([x.split()[0] for x in names], kinds, rows)

    n = max(1, min(listed.count(), 4 * shuffle_partitions(spark)))
    return listed.select("file", "records").repartition(n).mapInArrow(run, ", ".join(names))


def op8_warc(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read(spark, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
