"""What the operators of this package share: staged tables, batches of bytes, word and shingle hashes.

Texts reach Python as Arrow batches. `chunks` cuts a batch into slices of a few
megabytes, so a worker's memory follows the slice (or one document), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from assayer.sources.shared import discard as discard
from assayer.sources.shared import shared_dir as shared_dir
from assayer.sources.shared import staged as staged

CHUNK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def released(spark: SparkSession) -> None:
    """Has what finished jobs have shuffled deleted now. Spark does so when the driver collects garbage, which may be long after the disks are full."""
    spark.sparkContext._jvm.java.lang.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_even: dict[int, np.ndarray] = {}


def even_keys(spark: SparkSession, n: int) -> np.ndarray:
    """n integers of which repartition(n, key) deals each to a partition of its own; plain numbers would share some and leave others empty."""
    if n not in _even:
        keys = np.arange(n, dtype=np.int32)
        numbers = spark.range(0, 16 * n + 16, 1, 1).select(F.col("id").cast("int").alias("key"))
        for key, part in numbers.select("key", F.pmod(F.hash("key"), F.lit(n))).collect()[::-1]:
            keys[part] = key
        taken = set()
        for i, key in enumerate(keys.tolist()):  # a partition that no number fell to: any number not used yet
            while key in taken:
                key += 16 * n + 16
            keys[i] = key
            taken.add(key)
        _even[n] = keys
    return _even[n]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of strings, joined, and the offset of each row; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most so many bytes of text each (or one row), with their bytes and offsets."""
    data, at = bytes_of(batch.column(text))
    row, n = 0, batch.num_rows
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        end = min(end, n)
        yield batch.slice(row, end - row), data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_REACH = 256  # places of a word that have numbers of their own


def _tabulated() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each place in a word and byte, one table after another; and which bytes are blank."""
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    values = mix(np.arange(1, _REACH * 256 + 1, dtype=np.uint64) * np.uint64(_BASE)).reshape(_REACH, 256)
    values[:, 65:91] = values[:, 97:123]  # A-Z count as a-z
    values[:, blank] = 0
    return values.ravel(), blank


_VALUES, _SPACE = _tabulated()


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words [^ \\t-\\r]+ with A-Z in lower case: 64-bit hashes, first bytes, and for each row the place of its first word (one more at the end).

    A word's hash is the sum of numbers drawn for its bytes by place, so no regular pattern of bytes cancels out.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    begins[first] = ~space[first]
    starts = np.flatnonzero(begins)
    bounds = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, bounds
    lead = starts[0]
    size = np.diff(starts, append=n)
    place = np.arange(n - lead, dtype=np.int32) - np.repeat((starts - lead).astype(np.int32), size)
    values = _VALUES[((place & np.int32(_REACH - 1)) << 8) | data[lead:]]
    if size.max() > _REACH:
        far = np.flatnonzero((place >= _REACH) & ~space[lead:])
        values[far] = mix(values[far] + (place[far] // _REACH).astype(np.uint64) * np.uint64(_BASE))
    return mix(np.add.reduceat(values, starts - lead)), starts, bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of k words, rows one after another, and the place of each row's first (one more at the end).

    A row with 1 to k-1 words has one run, all its words; without words it has none.
    """
    count = np.diff(bounds)
    runs = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    place = np.concatenate([[0], np.cumsum(runs)]).astype(np.int64)
    if not place[-1]:
        return np.zeros(0, np.uint64), place
    first = np.repeat(bounds[:-1] - place[:-1], runs) + np.arange(place[-1])
    length = np.repeat(np.minimum(count, k), runs)
    out = np.zeros(len(first), np.uint64)
    last = len(words) - 1
    for j in range(k):
        part = np.where(length > j, words[np.minimum(first + j, last)], np.uint64(0))
        out = out * np.uint64(_BASE) + part
    return mix(out), place


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    hashes = np.sort(hashes)
    return hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])] if len(hashes) else hashes
