"""Elements of JSON arrays of any size, read by byte ranges, and files as streams.

Spark reads a `multiLine` file in one task. Here a file is cut in ranges. What a
range does to the reader's state (in a string or not, after a backslash or not,
depth of brackets) is worked out for each state it may begin in, in parallel; one
row for each range, in order, is folded to the state that it does begin in; then
each range gives the elements whose opening bracket or comma is in it, reading on
past its end to where the last of them ends. Bytes are looked at in blocks.

Files are opened through pyarrow's file systems: local, HDFS, S3, GCS.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2  # of a string; after a backslash in one
ELEMENTS = "file string, ordinal long, value string"


def open_file(uri: str):
    """(file system, path) of a path as Spark writes it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = f"file://{uri.removeprefix('file:')}"
    if uri.startswith("s3a://"):
        uri = f"s3://{uri.removeprefix('s3a://')}"
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def listed(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """(file, bytes) of the files under a path. Contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def marks(data: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of brackets and commas outside of strings, what each adds to the depth, and the state after the data."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), state
    slash = data == 92
    if state == ESCAPED:
        slash[0] = False
    # a byte is escaped where an odd number of backslashes comes right before it
    place = np.arange(len(data))
    last_other = np.maximum.accumulate(np.where(slash, -1, place))
    run = place - last_other  # of backslashes that end here
    escaped = np.concatenate([[state == ESCAPED], run[:-1] % 2 == 1])
    quote = (data == 34) & ~escaped
    inside = (np.cumsum(quote) - quote + (state != OUTSIDE)) % 2 == 1  # before each byte
    at = np.flatnonzero(np.isin(data, np.frombuffer(b"{}[],", np.uint8)) & ~inside)
    step = np.select([np.isin(data[at], np.frombuffer(b"{[", np.uint8)), data[at] == 44], [1, 0], -1)
    within = bool(inside[-1]) != bool(quote[-1])
    end = OUTSIDE if not within else ESCAPED if run[-1] % 2 == 1 else INSIDE
    return at, step, end


def _blocks(uri: str, begin: int, end: int, block: int = BLOCK_BYTES) -> Iterator[np.ndarray]:
    system, path = open_file(uri)
    with system.open_input_file(path) as f:
        f.seek(begin)
        while begin < end and (data := f.read(min(block, BLOCK_BYTES, end - begin))):
            begin += len(data)
            yield np.frombuffer(data, np.uint8)


def effect(uri: str, begin: int, end: int) -> list[tuple[int, int]]:
    """(state after, change of depth) of a range for each state before it."""
    now = [(OUTSIDE, 0), (INSIDE, 0), (ESCAPED, 0)]
    for data in _blocks(uri, begin, end):
        known = {state: marks(data, state) for state, _ in now}
        now = [(known[state][2], depth + int(known[state][1].sum())) for state, depth in now]
    return now


def elements(uri: str, begin: int, end: int, size: int, state: int, depth: int) -> Iterator[str]:
    """Elements whose opening bracket or comma lies in the range, which begins in a state and at a depth."""
    held: bytearray | None = None  # of the element that is open
    at_end = False
    for first, data in _counted(_blocks(uri, begin, size, end - begin), begin):  # past its end as much at a time as it has itself
        places, steps, state = marks(data, state)
        depths = depth + np.cumsum(steps)
        kinds = data[places]
        # between elements of the whole: the first bracket, commas at depth 1, the last bracket
        border = ((kinds == 91) & (depths == 1)) | ((kinds == 44) & (depths == 1)) | ((kinds == 93) & (depths == 0))
        depth += int(steps.sum())
        raw, last = data.tobytes(), 0
        for place, kind in zip(places[border].tolist(), kinds[border].tolist(), strict=True):
            if held is not None:
                held += raw[last:place]
                text = held.decode().strip()
                if text or kind == 44:
                    yield text
                held = None
            if first + place >= end:  # the next range's
                at_end = True
                break
            if kind != 93:
                held = bytearray()
            last = place + 1
        if at_end or (held is None and first + len(data) >= end):
            return
        if held is not None:
            held += raw[last:]


def _counted(blocks: Iterator[np.ndarray], begin: int) -> Iterator[tuple[int, np.ndarray]]:
    for data in blocks:
        yield begin, data
        begin += len(data)


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def array_elements(spark: SparkSession, path: str | list[str], pattern: str = "*.json", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, ordinal, value): every element of the JSON array that each file is, as JSON text; ordinal grows along a file."""
    last = F.greatest(F.lit(0), F.floor((F.col("bytes") - 1) / range_bytes)).cast("long")
    ranges = listed(spark, path, pattern).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    # a range is a row: its bytes are read by the task. A given number of tasks: by the rows' own size they would all go to one
    n = _tasks(spark)
    ranges = ranges.repartition(n, "file", "k")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = [effect(r["file"], r["k"] * range_bytes, min(r["bytes"], (r["k"] + 1) * range_bytes)) for r in rows]
            yield pa.RecordBatch.from_pylist([r | {"states": [s for s, _ in x], "depths": [d for _, d in x]} for r, x in zip(rows, found, strict=True)], pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("k", pa.int64()), ("states", pa.list_(pa.int64())), ("depths", pa.list_(pa.int64()))]))

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, state, depth = None, OUTSIDE, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["file"] != file:
                    file, state, depth = r["file"], OUTSIDE, 0
                out.append({"file": file, "bytes": r["bytes"], "k": r["k"], "state": state, "depth": depth})
                state, depth = r["states"][state], depth + r["depths"][state]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("k", pa.int64()), ("state", pa.int64()), ("depth", pa.int64())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("value", pa.string())])
        for batch in batches:
            for r in batch.to_pylist():
                out, held = [], 0
                own = elements(r["file"], r["k"] * range_bytes, min(r["bytes"], (r["k"] + 1) * range_bytes), r["bytes"], r["state"], r["depth"])
                for i, value in enumerate(own):
                    out.append((r["file"], (r["k"] << 32) + i, value))
                    held += len(value)
                    if held > BLOCK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)

    effects = ranges.mapInArrow(summed, "file string, bytes long, k long, states array<long>, depths array<long>")
    starts = effects.repartition("file").sortWithinPartitions("file", "k").mapInArrow(begun, "file string, bytes long, k long, state long, depth long")  # a row for each range
    return starts.repartition(n, "file", "k").mapInArrow(read, ELEMENTS)


def digests(files: DataFrame) -> DataFrame:
    """(file, bytes) with sha256, each file read as a stream by one task, since the digest needs its bytes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for uri in batch.column("file").to_pylist():
                own, (system, path) = hashlib.sha256(), open_file(uri)
                with system.open_input_stream(path, compression=None) as f:
                    while data := f.read(BLOCK_BYTES):
                        own.update(data)
                out.append(own.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("bytes"), pa.array(out, pa.string())], names=["file", "bytes", "sha256"])

    return files.repartition(_tasks(files.sparkSession), "file").mapInArrow(run, "file string, bytes long, sha256 string")
