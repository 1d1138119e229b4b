"""Ranked lexical search: the highest inner products of items and documents, by norm buckets.

A document's impact vector holds for each of the items' terms its weight times
its impact, an integer; an item's vector holds how often it has the term. Their
inner product is the score. As in LEMP, vectors go in order of length, longest
first, in buckets of BUCKET. For an item with the threshold t (its k-th best
score so far):

1. |item| * |longest of the bucket| < t (Cauchy-Schwarz): this bucket and all
   after it have nothing.
2. The item's coordinates are taken from the one that can add most in the bucket,
   until what is left can't reach t; only documents on these terms' lists can.
3. Of those, one whose part so far, and what its other coordinates can add (by
   the bucket's largest values, and by Cauchy-Schwarz of the rest of both vectors)
   is under t is left out.
4. The rest are scored exactly, in 64-bit integers. Floating-point numbers are
   only in the bounds, which are rounded up.

Documents are read once and become a table of counts of the items' terms, from
which sums and document frequencies come. Each task sorts what it has by length,
batch by batch, so vectors are never shuffled. A first pass scores only the
longest bucket of each batch: the k-th best of these is a threshold that holds
for all tasks in the second pass. A task gives its k best of each item; of these
are the k best of all.

Items come in blocks of bounded number and size, which are broadcast with their
terms' weights; each block is a search of its own.

Defined results: null and empty texts have no terms, match nothing and don't
count as documents with terms. Repeated documents are ranked each; at equal
scores a null doc_id comes last. Rows of benchmark alike in item_id and text are
one item; a null item_id is an item. Items without a match have no rows. Extra
columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import chunks, staged
from assayer.llm.files import as_rows
from assayer.llm.repeats import NO_ID

BEST = 10
BUCKET = 1_024
FIRST = 128
BLOCK_ITEMS = 5_000
BLOCK_BYTES = 8 << 20
SALTS = 32
SLACK = 1 + 1e-9
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
FOUND = "item_id long, _item int, doc_id long, score long"


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII digits and letters, A-Z in lower case, and of whatever isn't ASCII."""
    return _TERM.findall(text.lower())  # bytes: only A-Z change


@dataclass
class Items:
    """A block of items; for each its terms by number and how often it has them."""

    ids: list[int | None]
    numbers: list[np.ndarray]
    repeats: list[np.ndarray]
    vocabulary: dict[bytes, int]


@dataclass
class Weights:
    """What all documents give: weights by term, the number of documents with terms, and that of all terms."""

    weight: np.ndarray
    documents: int
    total: int


def read_items(rows: list[tuple[int | None, str | None]]) -> Items:
    out = Items([], [], [], {})
    for item, text in rows:
        counted = Counter(terms((text or "").encode()))
        out.ids.append(item)
        out.numbers.append(np.array([out.vocabulary.setdefault(t, len(out.vocabulary)) for t in counted], np.int64))
        out.repeats.append(np.array(list(counted.values()), np.int64))
    return out


def counts(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, n, terms, times): n is the number of all its terms; terms and times are the items' terms that it has, and how often."""
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            for part, data, at in chunks(batch):
                whole, n, own, times, ends = data.tobytes(), [], [], [], [0]
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    found = terms(whole[a:b])
                    n.append(len(found))
                    known, often = np.unique(np.array([x for x in map(number, found) if x is not None], np.int32), return_counts=True)
                    own.append(known)
                    times.append(often)
                    ends.append(ends[-1] + len(known))
                ends = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(np.int32))) for x in (own, times)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, times array<int>")


def weights(counted: DataFrame, items: Items) -> Weights:
    documents, total = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()  # a row for each of the block's terms at most
    weight = np.zeros(len(items.vocabulary), np.int64)
    for t, df in held:
        weight[t] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    return Weights(weight, documents, total)


def impacts(n: np.ndarray, row: np.ndarray, term: np.ndarray, times: np.ndarray, w: Weights) -> np.ndarray:
    """Coordinates of documents' vectors, in integers."""
    m = 25 + (75 * n * w.documents) // max(1, w.total)
    return w.weight[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m[row]))


class Bucket:
    """Vectors of about one length, with the list of each term."""

    def __init__(self, doc: np.ndarray, row: np.ndarray, term: np.ndarray, value: np.ndarray, norm: np.ndarray):
        self.doc, self.norm, self.longest = doc, norm, float(norm.max(initial=0))
        self.term, self.value = term, value
        self.first = np.searchsorted(row, np.arange(len(doc) + 1))
        by = np.argsort(term, kind="stable")
        self.rows, self.values = row[by], value[by]
        self.known, begin = np.unique(term[by], return_index=True)
        self.begin = np.append(begin, len(by))
        self.most = np.maximum.reduceat(self.values, begin) if len(by) else np.zeros(0, np.int64)

    def candidates(self, number: np.ndarray, repeats: np.ndarray, least: int) -> np.ndarray:
        """Rows that can reach the score `least`."""
        none = np.zeros(0, np.int64)
        if not len(self.known):
            return none
        at = np.minimum(np.searchsorted(self.known, number), len(self.known) - 1)
        here = self.known[at] == number
        at, often = at[here], repeats[here]
        can = often * self.most[at]
        order = np.argsort(-can, kind="stable")
        left = np.cumsum(can[order][::-1])[::-1]  # what a coordinate and all after it can add
        focus = order[: int(np.count_nonzero(left >= least))]
        if not len(focus):
            return none
        rest = int(left[len(focus)]) if len(focus) < len(left) else 0
        part, square = np.zeros(len(self.doc), np.int64), np.zeros(len(self.doc))
        for i in focus.tolist():
            own = slice(self.begin[at[i]], self.begin[at[i] + 1])
            part[self.rows[own]] += often[i] * self.values[own]
            square[self.rows[own]] += self.values[own].astype(float) ** 2
        rows = np.flatnonzero(part)
        other = float(np.sqrt((often[order[len(focus) :]].astype(float) ** 2).sum()))
        length = np.sqrt(np.maximum(0, (self.norm[rows] * SLACK) ** 2 - square[rows]))
        bound = part[rows] + np.minimum(rest, np.ceil(other * length * SLACK) + 1)
        return rows[bound >= least]

    def scores(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Exact scores; dense: the item's repeats by term."""
        out = np.zeros(len(rows), np.int64)
        size = self.first[rows + 1] - self.first[rows]
        place = np.repeat(self.first[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        np.add.at(out, np.repeat(np.arange(len(rows)), size), dense[self.term[place]] * self.value[place])
        return out


def buckets(batch: pa.RecordBatch, w: Weights, size: int = BUCKET) -> Iterator[Bucket]:
    """The batch's vectors, longest first."""
    lists, times = batch.column("terms"), batch.column("times")
    n, doc = batch.column("n").to_numpy(), batch.column("doc_id").to_numpy()
    count = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(doc)), count)
    term, often = lists.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(np.int64)
    value = impacts(n, row, term, often, w)
    norm = np.sqrt(np.bincount(row, value.astype(float) ** 2, len(doc)))
    order = np.argsort(-norm, kind="stable")
    order = order[norm[order] > 0]
    begin = np.cumsum(count) - count
    for a in range(0, len(order), size):
        own = order[a : a + size]
        many = count[own]
        place = np.repeat(begin[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        yield Bucket(doc[own], np.repeat(np.arange(len(own)), many), term[place], value[place], norm[own])


class Best:
    """The k best of each item, and from which score on more are wanted."""

    def __init__(self, items: Items, least: np.ndarray, k: int):
        self.items, self.k, self.least = items, k, least.copy()
        self.doc = [np.zeros(0, np.int64) for _ in items.ids]
        self.score = [np.zeros(0, np.int64) for _ in items.ids]
        self.length = [math.sqrt(float((r.astype(float) ** 2).sum())) * SLACK for r in items.repeats]
        self.dense = np.zeros(len(items.vocabulary), np.int64)

    def search(self, bucket: Bucket, open_: list[int]) -> list[int]:
        """Adds what the bucket has; gives the items for which a shorter vector may do."""
        on = []
        for i in open_:
            if self.length[i] * bucket.longest * SLACK < self.least[i]:
                continue
            on.append(i)
            number, repeats = self.items.numbers[i], self.items.repeats[i]
            rows = bucket.candidates(number, repeats, int(self.least[i]))
            if not len(rows):
                continue
            self.dense[number] = repeats
            scores = bucket.scores(rows, self.dense)
            self.dense[number] = 0
            good = scores >= self.least[i]
            doc, score = np.append(self.doc[i], bucket.doc[rows[good]]), np.append(self.score[i], scores[good])
            best = np.lexsort((doc, -score))[: self.k]
            self.doc[i], self.score[i] = doc[best], score[best]
            if len(best) == self.k:
                self.least[i] = max(self.least[i], score[best[-1]])
        return on

    def rows(self) -> pa.RecordBatch:
        out = [(item, i, d, s) for i, item in enumerate(self.items.ids) for d, s in zip(self.doc[i].tolist(), self.score[i].tolist(), strict=True)]
        return as_rows(["item_id", "_item", "doc_id", "score"], [pa.int64(), pa.int32(), pa.int64(), pa.int64()], out)


def _pass(counted: DataFrame, items: Items, w: Weights, least: np.ndarray, k: int, first: int | None) -> DataFrame:
    """Each task's k best of each item. first: only so many of the longest vectors of each batch."""
    shared = counted.sparkSession.sparkContext.broadcast((items, w, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, w, least = shared.value
        best = Best(items, least, k)
        for batch in batches:
            open_ = list(range(len(items.ids)))
            for bucket in buckets(batch, w, first or BUCKET):
                open_ = best.search(bucket, open_)
                if first or not open_:
                    break
        yield best.rows()

    return counted.mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item, numbered; those of a share of the documents first, so no task gets what all tasks found for an item."""
    order = [F.desc("score"), F.asc("doc_id")]
    share = Window.partitionBy("_item", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(*order)
    few = found.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= k).drop("rank")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("_item").orderBy(*order))).where(F.col("rank") <= k)


def item_blocks(benchmark: DataFrame, block_items: int, block_bytes: int) -> Iterator[Items]:
    """Items in blocks of about the given number and bytes at most."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    total = max(1, -(-2 * n // block_items), -(-2 * size // block_bytes)) if n > block_items or size > block_bytes else 1
    for b in range(total):
        part = rows if total == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(total)) == b)
        yield read_items([tuple(r) for r in part.orderBy("item_id", "text").collect()])  # bounded by the block


def search(docs: DataFrame, benchmark: DataFrame, k: int = BEST, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score above 0 for each item of benchmark (item_id, text)."""
    out = None
    for items in item_blocks(benchmark, block_items, block_bytes):
        counted = staged(counts(docs, items), "term-counts")
        w = weights(counted, items)
        least = np.ones(len(items.ids), np.int64)
        first = _ranked(_pass(counted, items, w, least, k, FIRST), k).where(F.col("rank") == k).select("_item", "score")
        for i, score in first.collect():  # a row for each item of the block at most
            least[i] = score
        found = staged(_pass(counted, items, w, least, k, None), "found")
        ranked = _ranked(found, k).select("item_id", "rank", F.nullif(F.col("doc_id"), F.lit(int(NO_ID))).alias("doc_id"), "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
