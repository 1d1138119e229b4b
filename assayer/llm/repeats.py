"""Which hashed items of documents occur elsewhere: one shuffle of packed arrays.

A task hands over its items (hash, place) in one packed row for each bucket of
hashes, so 10^8 items are some thousand rows. Before that, what the task itself
can settle is settled: of items with one hash in several documents of a chunk,
one goes on and all that repeat are answered at once. So a hash that very many documents
share sends one item for each chunk. A bucket's task finds the repeats of its
hashes by sorting them, and answers with places, packed by parts of the
documents in the same way; a last shuffle gathers each document's.

Documents are told apart by (doc_id, mark), mark being a hash of the text:
rows alike in both are one document that occurs twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import chunks, even_keys, mix, shuffle_partitions, staged

NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id, which sorts last
SALTS = 16
PLACES = "doc_id long, mark long, places binary"

#: (data, offsets) of a chunk -> hashes (a row of one or two 64-bit numbers each), row of each, place of each (uint32)
Items = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text) with NO_ID for null ids and '' for null texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def doc_id(name: str = "doc_id") -> Column:
    return F.nullif(F.col(name), F.lit(int(NO_ID)))


def _planes(numbers: np.ndarray) -> np.ndarray:
    """First bytes, second bytes and so on: the high ones are alike and compress."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T).reshape(-1)


def _from_planes(data: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


PACKED = "part int, docs binary, counts binary, places binary"


def pack_answers(doc: np.ndarray, mark: np.ndarray, row: np.ndarray, numbers: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """Numbers (uint32) for rows (doc, mark), packed in one row for each part of the documents. row must be ascending; keys: of the parts, see even_keys."""
    if not len(row):
        return pa.RecordBatch.from_arrays([pa.array([], k) for k in (pa.int32(), pa.binary(), pa.binary(), pa.binary())], names=["part", "docs", "counts", "places"])
    begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    count = np.diff(np.concatenate([begins, [len(row)]]))
    d, m = doc[row[begins]], mark[row[begins]]
    part = (mix(d.astype(np.uint64) * np.uint64(3) ^ m.astype(np.uint64)) % np.uint64(len(keys))).astype(np.int64)
    order = np.argsort(part, kind="stable")
    item = np.repeat(begins[order] - (np.cumsum(count[order]) - count[order]), count[order]) + np.arange(len(row))
    d, m, part, count, numbers = d[order], m[order], part[order], count[order], numbers[item].astype("<u4")
    at = np.concatenate([[0], np.cumsum(count)])
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    rows = [(int(keys[part[i]]), np.stack([d[i:j], m[i:j]]).tobytes(), count[i:j].astype("<u4").tobytes(), numbers[at[i] : at[j]].tobytes()) for i, j in zip(cuts, [*cuts[1:], len(part)], strict=True)]
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "docs", "counts", "places"])


def gathered(packed: DataFrame, parts: int) -> DataFrame:
    """(doc_id, mark, places), a row for each document, of rows as from pack_answers."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, ...]]] = {}
        for batch in batches:
            for p, *x in zip(*(batch.column(c).to_pylist() for c in ("part", "docs", "counts", "places")), strict=True):
                held.setdefault(p, []).append(tuple(x))
        for p in sorted(held):
            own = held.pop(p)
            ids = np.concatenate([np.frombuffer(x[0], np.int64).reshape(2, -1) for x in own], axis=1)
            count = np.concatenate([np.frombuffer(x[1], "<u4") for x in own]).astype(np.int64)
            numbers = np.frombuffer(b"".join(x[2] for x in own), "<u4")
            order = np.lexsort((ids[1], ids[0]))
            begin = (np.cumsum(count) - count)[order]
            count, ids = count[order], ids[:, order]
            item = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(len(numbers))
            data, at = numbers[item].tobytes(), np.concatenate([[0], np.cumsum(count)]) * 4
            first = np.flatnonzero(np.concatenate([[True], (ids[:, 1:] != ids[:, :-1]).any(0)])) if len(count) else np.zeros(0, np.int64)
            last = np.concatenate([first[1:], [len(count)]]).astype(np.int64)
            for i in range(0, len(first), 2_000):
                part = slice(i, i + 2_000)
                blobs = [data[at[a] : at[b]] for a, b in zip(first[part].tolist(), last[part].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[0][first[part]], pa.int64()), pa.array(ids[1][first[part]], pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "mark", "places"])

    return packed.repartition(parts, "part").mapInArrow(gather, PLACES)


def _without_copies(batch: pa.RecordBatch, seen: dict[tuple[int, int], int]) -> pa.RecordBatch:
    """The rows but those whose text (by mark and length) a smaller doc_id has had. seen: of each text, the smallest so far."""
    keep = []
    for doc, *text in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), pc.binary_length(batch.column("text")).to_pylist(), strict=True):
        least = seen.setdefault(tuple(text), doc)
        keep.append(doc <= least)
        if doc < least:
            seen[tuple(text)] = doc
    return batch.filter(pa.array(keep, pa.bool_()))


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n_bytes) of the documents (marked) whose text one with a smaller doc_id has too. Texts count as equal by 128 bits of hash and length."""
    ids = staged(docs.select("doc_id", "mark", F.xxhash64(F.lit(1), "text").alias("_second"), F.octet_length("text").alias("n_bytes")), "ids")
    by = ["mark", "_second", "n_bytes"]
    least = ids.groupBy(*by).agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most")).where("_least < _most").drop("_most")
    # a text that very many have is dealt to SALTS tasks
    least = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = ids.withColumn("_salt", F.pmod(F.hash("doc_id"), F.lit(SALTS)))
    return staged(salted.join(least.hint("merge"), [*by, "_salt"]).where("doc_id > _least").select("doc_id", "mark", "n_bytes").distinct(), "copies")


def repeated(docs: DataFrame, items: Items, across: bool, kept: int = 8, copies_apart: bool = False, elsewhere: int = 0) -> DataFrame:
    """(doc_id, mark, places): places may come in several rows of a document.

    across: the places of hashes that occur in documents of different ids.
    Otherwise the places of all but the first item of a hash, in the order of
    (doc_id, mark, place). docs: from marked(). kept: bytes of a hash's first
    number that are sent and compared, besides the bucket; with few, hashes that
    only look alike count as repeats. copies_apart: the caller sees to documents whose text a
    document with a smaller id has too; a task leaves out those it comes across.
    elsewhere: a bit of the places (not with across) of items that only count where the first item is
    another document's; then all of a document's do.
    """
    spark = docs.sparkSession
    buckets = shuffle_partitions(spark)
    keys = even_keys(spark, buckets)

    def settle(hashes: np.ndarray, doc: np.ndarray, mark: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(what repeats, what stands for each hash elsewhere) as places in the arrays."""
        by = (doc[row], *hashes.T)
        order = np.lexsort(by if across else (place, mark[row], *by))
        h, d = hashes[order], doc[row][order]
        begins = np.concatenate([[True], (h[1:] != h[:-1]).any(1)]) if len(h) else np.zeros(0, bool)
        first = np.flatnonzero(begins)
        group = np.cumsum(begins) - 1
        if across:
            last = np.concatenate([first[1:], [len(h)]]) - 1
            known = (d[first] != d[last])[group]
            return order[known], order[begins | ~known]  # of one document's items all go on: none is answered yet
        m, p = mark[row][order], place[order]
        lead = first[group]
        other, marked = (d != d[lead]) | (m != m[lead]), (p & elsewhere) != 0
        return order[other | ((p != p[lead]) & ~marked)], order[begins | (marked & ~other)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            if copies_apart:
                batch = _without_copies(batch, seen)
            for part, data, at in chunks(batch):
                doc, mark = (part.column(c).to_numpy() for c in ("doc_id", "mark"))
                hashes, row, place = items(data, at)
                if not len(hashes):
                    continue
                known, first = settle(hashes, doc, mark, row, place)
                by = known[np.argsort(row[known], kind="stable")]
                own = pack_answers(doc, mark, row[by], place[by], keys)
                if own.num_rows:  # without hashes: passes the buckets as it is
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.nulls(own.num_rows, pa.binary())], names=["bucket", "docs", "counts", "places", "hashes"])
                hashes, row, place = hashes[first], row[first], place[first]
                bucket = ((hashes[:, 0] >> np.uint64(40)) % np.uint64(buckets)).astype(np.uint32)
                order = np.lexsort((row, bucket))
                hashes, row, place, bucket = hashes[order], row[order], place[order], bucket[order]
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                rows = []
                for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
                    own_row, count = np.unique(row[a:b], return_counts=True)
                    short = np.ascontiguousarray(hashes[a:b]).view(np.uint8)
                    short = np.concatenate([short[:, :kept], short[:, 8:]], 1)  # and the bucket
                    planes = _planes(place[a:b].astype("<u4"))
                    ids = np.stack([_planes(doc[own_row]), mark[own_row].view(np.uint8)])
                    rows.append((int(keys[bucket[a]]), ids.tobytes(), count.astype("<u4").tobytes(), planes.tobytes(), short.tobytes()))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "docs", "counts", "places", "hashes"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, ...]]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            packed = batch.column("hashes").is_valid()
            through = batch.filter(pc.invert(packed)).select(["bucket", "docs", "counts", "places"])
            yield pa.RecordBatch.from_arrays(through.columns, names=["part", "docs", "counts", "places"])
            for b, *x in zip(*(batch.filter(packed).column(c).to_pylist() for c in ("bucket", "places", "hashes", "docs", "counts")), strict=True):
                held.setdefault(b, []).append(tuple(x))
        for b in sorted(held):
            parts = held.pop(b)
            place = np.concatenate([_from_planes(p[0], "<u4") for p in parts])
            sent = np.frombuffer(b"".join(p[1] for p in parts), np.uint8).reshape(len(place), -1)
            hashes = np.zeros((len(place), sent.shape[1] + 8 - kept), np.uint8)
            hashes[:, :kept], hashes[:, 8:] = sent[:, :kept], sent[:, kept:]
            ids = np.stack([np.concatenate(x) for x in zip(*((_from_planes(p[2][: len(p[2]) // 2], np.int64), np.frombuffer(p[2], np.int64)[len(p[2]) // 16 :]) for p in parts), strict=True)])
            row = np.repeat(np.arange(ids.shape[1]), np.concatenate([np.frombuffer(p[3], "<u4") for p in parts]))
            again, _ = settle(hashes.view(np.uint64), ids[0], ids[1], row, place)
            again = again[np.argsort(row[again], kind="stable")]
            yield pack_answers(ids[0], ids[1], row[again], place[again], keys)

    packed = docs.mapInArrow(send, "bucket int, docs binary, counts binary, places binary, hashes binary")
    return gathered(packed.repartition(buckets, "bucket").mapInArrow(find, PACKED), buckets)


def with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """docs (marked) with `places`, a list of packed places, null where there is none. No partial lists are carried for a document but its own."""
    gathered = places.groupBy("doc_id", "mark").agg(F.collect_list("places").alias("places"))
    return docs.join(gathered.hint("merge"), ["doc_id", "mark"], "left")


def unpack(blobs: list[bytes] | None) -> np.ndarray:
    """Ascending, each once."""
    return np.unique(np.frombuffer(b"".join(blobs), "<u4")).astype(np.int64) if blobs else np.zeros(0, np.int64)
