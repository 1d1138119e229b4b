"""Benchmark decontamination: size-partitioned MinHash containment search.

An item's domain is its set of different k-word shingles. Items are partitioned
by its size: class c holds those of over 2c/3 and at most c. An item's sketch
is its least hashes, as many for each class as leave no match out: a document
that has `percent` of the item's n shingles lacks n - m at most, so of a sketch
of s at least s - (n - m) are in it; s is chosen so that this is about a tenth of
the class. A document isn't sketched: each of its shingles is looked up among
the sketches of all items, wherever in the document it is, and items of whose
sketch it has enough are candidates. So short items are found in documents of
any length, and what repeats within an item or lies scattered in a document
changes nothing.

Of items of up to FEW shingles the rarest of the block are taken instead of the
least hashes, since a single one makes a candidate.

Candidates are verified exactly, shingle by shingle, as words: containment is
the share of the item's distinct shingles that occur in the whole document.

Items with one text are searched for once. Different texts come in blocks of
bounded number and size, which are broadcast; each block is searched in all
documents, so documents are never shuffled.

Defined results: null or blank texts have no shingles and match nothing. Texts
of fewer than k words have all their words as one shingle: a short item matches
documents of just these words. Repeated items and documents are reported each;
extra columns are kept by `decontaminate` and ignored by `search`. Empty tables
give no pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import bytes_of, chunks, distinct, mix, shingle_hashes, word_hashes
from assayer.llm.files import as_rows

WORDS = 5
PERCENT = 80
FEW = 8
MIN_HASH = np.uint64(0xA24BAED4963EE407)
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20
_WORD = re.compile(r"[^ \t-\r]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
FOUND = "doc_id long, _item string, n_item_shingles long, n_shared long, containment double"


def shingles(text: str | None, k: int = WORDS) -> set[tuple[str, ...]]:
    words = _WORD.findall((text or "").translate(_LOWER))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def size_class(n: int) -> int:
    """The least of 8, 12, 16, 24, 32, 48 ... that is at least n."""
    c = 8
    while c < n:
        c = c * 3 // 2 if c & (c - 1) == 0 else c * 4 // 3
    return c


def sketch_size(n: int, percent: int) -> tuple[int, int]:
    """(s, need) of an item of n different shingles: how many its sketch has, and how many of these a document with percent of the n has at least."""
    c = n if n <= FEW else size_class(n)
    s = min(n, c + percent * c // -100 + max(1, c // 10))
    return s, max(1, s - (n + percent * n // -100))


@dataclass
class Index:
    """A block of items. keys: ascending, the hashes of all sketches; owners[keys_at[i]:keys_at[i + 1]] are the items that have a key; need: by item."""

    k: int
    ids: list[str] = field(default_factory=list)
    sets: list[set] = field(default_factory=list)
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    keys_at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    owners: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    need: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def build(items: list[tuple[str, str | None]], k: int = WORDS, percent: int = PERCENT) -> Index:
    index = Index(k)
    items = [(i, t) for i, t in items if shingles(t, k)]
    if not items:
        return index
    data, at = bytes_of(pa.array([t for _, t in items], pa.string()))
    words, _, bounds = word_hashes(data, at)
    hashes, place = shingle_hashes(words, bounds, k)
    own = [distinct(hashes[a:b]) for a, b in zip(place[:-1], place[1:], strict=True)]
    seen, count = np.unique(np.concatenate(own), return_counts=True)
    keys, owners, need = [], [], []
    for n, (item, text) in enumerate(items):
        index.ids.append(item)
        index.sets.append(shingles(text, k))
        size, least = sketch_size(len(own[n]), percent)
        order = count[np.searchsorted(seen, own[n])] if len(own[n]) <= FEW else mix(own[n] ^ MIN_HASH)
        keys.append(own[n][np.argsort(order, kind="stable")][:size])
        owners.append(np.full(size, n))
        need.append(least)
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(keys, kind="stable")
    index.keys, first = np.unique(keys[order], return_index=True)
    index.keys_at, index.owners, index.need = np.append(first, len(keys)), owners[order], np.array(need)
    return index


def candidates(index: Index, hashes: np.ndarray, place: np.ndarray) -> list[tuple[int, int]]:
    """(row, item's number), ascending, of rows that have enough of the item's sketch."""
    if not len(hashes) or not len(index.keys):
        return []
    at = np.minimum(np.searchsorted(index.keys, hashes), len(index.keys) - 1)
    hit = np.flatnonzero(index.keys[at] == hashes)
    row = np.searchsorted(place, hit, "right") - 1
    found = np.unique(row * len(index.keys) + at[hit])
    row, key = found // len(index.keys), found % len(index.keys)
    many = index.keys_at[key + 1] - index.keys_at[key]
    entry = np.repeat(index.keys_at[key] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    pair, count = np.unique(np.repeat(row, many) * len(index.ids) + index.owners[entry], return_counts=True)
    pair = pair[count >= index.need[pair % len(index.ids)]]
    return list(zip((pair // len(index.ids)).tolist(), (pair % len(index.ids)).tolist(), strict=True))


def matches(index: Index, part: pa.RecordBatch, text: str, data: np.ndarray, at: np.ndarray, percent: int) -> list[tuple[int, int, int, int]]:
    """(row, item's number, its shingles, those found) of verified pairs."""
    words, _, bounds = word_hashes(data, at)
    hashes, place = shingle_hashes(words, bounds, index.k)
    out, last, own = [], -1, set()
    for row, item in candidates(index, hashes, place):
        if row != last:
            last, own = row, shingles(part.column(text)[row].as_py(), index.k)
        shared = len(index.sets[item] & own)
        if 100 * shared >= percent * len(index.sets[item]):
            out.append((row, item, len(index.sets[item]), shared))
    return out


def named(benchmark: DataFrame) -> DataFrame:
    """(item_id, text, _item): _item is the same for items with one text."""
    text = F.col("text").cast("string")
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text"), F.sha1(F.coalesce(text, F.lit(""))).alias("_item"))


def blocks(benchmark: DataFrame, k: int = WORDS, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES, percent: int = PERCENT) -> Iterator[Index]:
    """Indexes of blocks of items' texts, each of about the given number and bytes at most."""
    items = named(benchmark).select("_item", "text").distinct()
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    total = max(1, -(-2 * n // block_items), -(-2 * size // block_bytes)) if n > block_items or size > block_bytes else 1
    for b in range(total):
        part = items if total == 1 else items.where(F.pmod(F.xxhash64("_item"), F.lit(total)) == b)
        yield build([(r["_item"], r["text"]) for r in part.collect()], k, percent)  # bounded by the block


def search(docs: DataFrame, benchmark: DataFrame, k: int = WORDS, percent: int = PERCENT, **bounds: int) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) of every pair of at least percent."""
    out = None
    for index in blocks(benchmark, k, percent=percent, **bounds):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            for batch in batches:
                rows = []
                for part, data, at in chunks(batch):
                    ids = part.column("doc_id").to_pylist()
                    rows += [(ids[r], index.ids[i], n, s, s / n) for r, i, n, s in matches(index, part, "text", data, at, percent)]
                yield as_rows([x.split()[0] for x in FOUND.split(", ")], kinds, rows)

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)
        out = found if out is None else out.unionByName(found)
    return out.join(named(benchmark).drop("text"), "_item").select("doc_id", "item_id", "n_item_shingles", "n_shared", "containment")


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = WORDS, percent: int = PERCENT, text: str = "text", **bounds: int) -> DataFrame:
    """docs without the rows that contain an item; all columns are kept."""
    for index in blocks(benchmark, k, percent=percent, **bounds):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data, at in chunks(batch, text):
                    keep = np.ones(part.num_rows, bool)
                    keep[[x[0] for x in matches(shared.value, part, text, data, at, percent)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
