"""Suffix-array dedup: Burrows-Wheeler transforms of shards, merged by iterative interleave refinement.

What is asked: each byte covered by a `length`-byte string that also starts in
a document with a smaller doc_id goes; strings never cross documents.

0. Of documents with equal texts only the one with the smallest doc_id takes
   part; all windows of the others go, which aggregation by hash tells.
1. Candidates. Of each `length`-byte window the `GRAM`-byte run with the least
   hash is its anchor, so equal windows have equal anchors. Anchors found in
   documents of different ids (one shuffle of packed hashes) mark the windows
   that can repeat at all; all others are left alone. Nothing is lost: a string
   in two documents has its anchor in both.
2. Groups. Each marked window goes to the group of its owner, the least hash
   of its `OWNER`-byte runs; neighbouring windows of one owner go as one string
   (string of n windows: n + length - 1 bytes). Equal windows meet in a group.
   Equal strings of a task go once, with the smallest doc_id among them: the
   windows of the others are settled there and then, so a passage that very many
   documents share sends one string for each task.
3. Within a group, what one task sent is a shard. Each shard's suffixes are
   sorted and give its transform, and the transforms of all tasks' shards are
   merged by refinement (transforms.py). What lies between two borders in the
   end is an interval of one repeated `length`-byte string. Its smallest doc_id
   decides for all its windows.
   A group of over GROUP_BYTES is not merged: its strings are dealt out anew, by
   owners under other hashes, and go through 2 and 3 again, up to
   LEVELS times; one still over the bound then (equal strings) is merged whole.
   No task holds more than one group, nor more of it than that.
4. Removed windows go back to their documents, which are cut.

Defined results: null text is the empty text. Rows of one doc_id never remove
from each other, whether alike or not. A null doc_id is larger than all others.
Extra columns are kept by `dedup` and ignored by `removed`. An empty table
gives no rows. Texts are bytes: a cut may fall within a character. `dedup`
returns text again and drops the rest of a cut character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from assayer.llm.common import chunks, even_keys, mix, released, shuffle_partitions, staged
from assayer.llm.files import as_rows
from assayer.llm.repeats import NO_ID, PLACES, copies, gathered, marked, pack_answers, repeated, with_places
from assayer.llm.transforms import encoded, merged_intervals, repeats_of_later

LENGTH = 50
GRAM = 24
OWNER = 8
MOST_WINDOWS = 64
GROUPS = 64  # for each shuffle partition
GROUP_BYTES = 4 << 20
HELD_BYTES = 8 << 20
LEVELS = 60
_TABLE = mix(np.arange(1, 257, dtype=np.uint64))
_ODD = [int(x) | 1 for x in mix(np.arange(11, 20, dtype=np.uint64))]


def gram_hashes(data: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of the `size` bytes from each place; len(data) - size + 1 of them."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    n = len(data) - size + 1
    part, k, i, h, covered = _TABLE[data], 1, 0, None, 0
    while True:  # size is put together from hashes of 1, 2, 4 ... bytes
        if size & k:
            own = part[covered : covered + n]
            h = own.copy() if h is None else h * np.uint64(_ODD[i]) + own
            covered += k
        if covered == size:
            break
        part = part[:-k] * np.uint64(_ODD[i]) + part[k:]
        k, i = 2 * k, i + 1
    h ^= np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h


def _slide(h: np.ndarray, width: int, pick) -> np.ndarray:
    """The extreme of each `width` neighbours; width - 1 fewer."""
    k = 1
    while 2 * k <= width:
        h = pick(h[:-k], h[k:])
        k *= 2
    return pick(h[: len(h) - (width - k)], h[width - k :]) if width > k else h


def anchors(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and place of each run that is the least of some window of its row (all of them, at ties)."""
    h = gram_hashes(data, gram)
    width = length - gram + 1
    if len(h) < width:
        return np.zeros((0, 1), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    low = _slide(h, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    top = _slide(np.concatenate([pad, low, pad]), width, np.maximum)  # over the windows that hold the run
    found = np.flatnonzero(top == h)
    row = np.searchsorted(at, found, "right") - 1
    inside = (found + gram <= at[row + 1]) & (at[row + 1] - at[row] >= length)
    found, row = found[inside], row[inside]
    return h[found, None], row, (found - at[row]).astype(np.uint32)


def owned_runs(data: np.ndarray, windows: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ascending window starts: (first window, number of windows, owner's hash) of each stretch of neighbours with one owner."""
    if not len(windows):
        return windows, windows, np.zeros(0, np.uint64)
    low = _slide(gram_hashes(data, OWNER, seed + 1), length - OWNER + 1, np.minimum)
    owner = low[windows]
    begins = np.concatenate([[True], (owner[1:] != owner[:-1]) | (windows[1:] != windows[:-1] + 1)])
    first = np.flatnonzero(begins)
    count = np.diff(np.concatenate([first, [len(windows)]]))
    pieces = -(-count // MOST_WINDOWS)  # a stretch is longer only where a text repeats itself
    within = (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * MOST_WINDOWS
    first, count = np.repeat(first, pieces) + within, np.minimum(np.repeat(count, pieces) - within, MOST_WINDOWS)
    return windows[first], count, owner[first]


_TABULATED = mix(np.arange(1, (MOST_WINDOWS + 256) * 256 + 1, dtype=np.uint64))


def _within(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin[i], begin[i] + 1, ... of each i, size[i] of them, one after another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Strings:
    """Strings of a task: text (each with an end), its length, group and owner; the document and place it is from."""

    FIELDS = ("text", "size", "owner", "doc", "mark", "start")

    def __init__(self, length: int, seed: int):
        self.length, self.seed = length, seed
        self.clear()

    def clear(self) -> None:
        self.held: list[tuple[np.ndarray, ...]] = []
        self.bytes = 0

    def add(self, data: np.ndarray, windows: np.ndarray, at: np.ndarray, doc: np.ndarray, mark: np.ndarray, start: np.ndarray) -> None:
        """The windows (ascending) of rows that begin at `at` in data, whose byte 0 is 255; start: place of each row in its document."""
        first, n, owner = owned_runs(data, windows, self.length, self.seed)
        if not len(first):
            return
        row = np.searchsorted(at, first, "right") - 1
        size = n + self.length
        text = data[np.minimum(_within(first, size), len(data) - 1)]
        text[np.cumsum(size) - 1] = 0
        self.held.append((text, size, mix(owner), doc[row], mark[row], start[row] + first - at[row]))
        self.bytes += len(text) + 40 * len(size)

    def shards(self, groups: int) -> Iterator[tuple]:
        """(settled, shards): settled is (doc, mark, first window, windows) of strings that a smaller doc has too; a shard is (group, text, sizes, docs, uses of each string, marks, starts), by group."""
        if not self.held:
            return
        text, size, owner, doc, mark, start = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.clear()
        begin = np.cumsum(size) - size
        place = np.arange(len(text)) - np.repeat(begin, size)
        content = np.add.reduceat(_TABULATED[(place << 8) | text], begin)
        group = (owner % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((doc, content, owner, group))
        size, owner, doc, mark, start, content, group, begin = (x[order] for x in (size, owner, doc, mark, start, content, group, begin))
        fresh = np.concatenate([[True], (owner[1:] != owner[:-1]) | (content[1:] != content[:-1])])
        lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        later = doc > doc[lead]
        yield doc[later], mark[later], start[later], size[later] - self.length
        used = ~later
        lead, uses = np.unique(lead[used], return_counts=True)  # places in the order by group
        text, marks, starts = text[_within(begin[lead], size[lead])], mark[used], start[used]
        cuts = np.flatnonzero(np.concatenate([[True], group[lead][1:] != group[lead][:-1]]))
        ends = np.concatenate([[0], np.cumsum(size[lead])])
        use = np.concatenate([[0], np.cumsum(uses)])
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(lead)], strict=True):
            a, b = use[i], use[j]
            yield int(group[lead[i]]), text[ends[i] : ends[j]], doc[lead[i:j]], uses[i:j], marks[a:b], starts[a:b]


def _stretches(of: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(of, first window, windows) of neighbouring windows, ascending."""
    key = np.sort((of.astype(np.int64) << 32) | window)
    fresh = np.concatenate([[True], key[1:] != key[:-1] + 1]) if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(fresh)
    n = np.diff(np.concatenate([first, [len(key)]]))
    return key[first] >> 32, key[first] & 0xFFFFFFFF, n


def later_windows(text: np.ndarray, shards: np.ndarray, docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first window, windows) of what occurs in a string with a smaller doc. text: shards one after another; docs: of each string."""
    places, begins = merged_intervals(text, shards, length)
    ends = np.flatnonzero(text == 0)
    string = np.searchsorted(ends, places)
    later = repeats_of_later(begins, docs[string])
    string = string[later]
    return _stretches(string, places[later] - np.concatenate([[0], ends + 1])[string])


ROWS = "key int, part int, docs binary, counts binary, places binary, body binary"
ROW_NAMES = [x.split()[0] for x in ROWS.split(", ")]
ROW_KINDS = [pa.int32(), pa.int32(), *[pa.binary()] * 4]


def _answers(found: list[tuple[np.ndarray, ...]], keys: np.ndarray) -> pa.RecordBatch:
    """Rows without part and body of (doc, mark, first window, windows)."""
    doc, mark, start, n = (np.concatenate(x) for x in zip(*found, strict=True))
    numbers = np.stack([start, n], 1).astype("<u4").reshape(-1)
    packed = pack_answers(doc, mark, np.repeat(np.arange(len(doc)), 2), numbers, keys)
    nothing = pa.nulls(packed.num_rows, pa.int32()), pa.nulls(packed.num_rows, pa.binary())
    return pa.RecordBatch.from_arrays([packed.column("part"), nothing[0], packed.column("docs"), packed.column("counts"), packed.column("places"), nothing[1]], names=ROW_NAMES)


def _handed_over(strings: Strings, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a task holds, as rows: answers first, then its shards."""
    made = strings.shards(GROUPS * len(keys))
    settled = next(made, None)
    if settled is None:
        return
    if len(settled[0]):
        yield _answers([settled], keys)
    pack, rows, held = zstandard.ZstdCompressor(level=1), [], 0
    for group, text, docs, uses, marks, starts in made:
        ids = pack.compress(np.concatenate([docs, marks]).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())
        rows.append((int(keys[group % len(keys)]), group // len(keys), ids, uses.astype("<u4").tobytes(), starts.astype("<u4").tobytes(), pack.compress(text.tobytes())))
        held += len(text)
        if held > 4 << 20:
            yield as_rows(ROW_NAMES, ROW_KINDS, rows)
            rows, held = [], 0
    yield as_rows(ROW_NAMES, ROW_KINDS, rows)


class Group:
    """Shards of one group, as they come."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, ids: bytes, uses: bytes, starts: bytes, body: bytes) -> None:
        unpack = zstandard.ZstdDecompressor()
        count = np.frombuffer(uses, "<u4").astype(np.int64)
        own = np.ascontiguousarray(np.frombuffer(unpack.decompress(ids), np.uint8).reshape(8, -1).T).view("<i8").ravel()
        self.rows.append((np.frombuffer(unpack.decompress(body), np.uint8), own[: len(count)], count, own[len(count) :], np.frombuffer(starts, "<u4").astype(np.int64)))
        self.bytes += len(self.rows[-1][0])

    def take(self) -> tuple[np.ndarray, ...]:
        """(bytes of each shard, text, docs, uses, marks, starts), which are then forgotten."""
        shards = np.array([len(r[0]) for r in self.rows])
        out = shards, *(np.concatenate(x) for x in zip(*self.rows, strict=True))
        self.__init__()
        return out


def _spread(string: np.ndarray, docs: np.ndarray, uses: np.ndarray, marks: np.ndarray, starts: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, mark, first window, windows) for each use of the strings."""
    use = _within((np.cumsum(uses) - uses)[string], uses[string])
    times = uses[string]
    return np.repeat(docs[string], times), marks[use], starts[use] + np.repeat(first, times), np.repeat(n, times)


def _merge(batches: Iterator[pa.RecordBatch], length: int, group_bytes: int, seed: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Answers of the groups, which come one after another; groups that are too large are handed over again under the next seed."""
    group, key, large = Group(), None, False
    again, found, held = Strings(length, seed + 1), [], 0

    def close() -> None:
        nonlocal held
        if not group.rows:
            return
        shards, text, docs, uses, marks, starts = group.take()
        if len(docs) > 1:
            string, first, n = later_windows(text, shards, docs, length)
            found.append(_spread(string, docs, uses, marks, starts, first, n))
            held += len(found[-1][0])

    def dealt_again() -> None:
        """The group's strings as rows of documents; each use of a string is one."""
        _, text, docs, uses, marks, starts = group.take()
        ends = np.flatnonzero(text == 0)
        begin = np.concatenate([[0], ends[:-1] + 1])
        string = np.repeat(np.arange(len(docs)), uses)
        size = (ends - begin + 1)[string]
        text = text[_within(begin[string], size)]
        at = np.cumsum(size) - size
        again.add(text, _within(at, size - length), at, docs[string], marks, starts)

    for batch in batches:
        own = batch.column("part").is_null()
        if pc.any(own).as_py():  # settled before: passes as it is
            yield batch.filter(own)
            batch = batch.filter(pc.invert(own))
        for *name, ids, uses, starts, body in zip(*(batch.column(c).to_pylist() for c in ROW_NAMES), strict=True):
            if name != key:
                if large and group.rows:
                    dealt_again()
                close()
                key, large = name, False
            group.add(ids, uses, starts, body)
            large = large or group.bytes > group_bytes and seed < LEVELS
            if large and group.bytes > group_bytes:
                dealt_again()
            if again.bytes > HELD_BYTES:
                yield from _handed_over(again, keys)
            if held > 500_000:
                yield _answers(found, keys)
                found, held = [], 0
    if large and group.rows:
        dealt_again()
    close()
    if held:
        yield _answers(found, keys)
    yield from _handed_over(again, keys)


def removed(base: DataFrame, length: int = LENGTH, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, mark, places): packed pairs (first window, number of windows) to remove, in any number of rows of a document. base: from marked(), with any other columns; its shuffle is one with the caller's if that joins the places to base."""
    spark = base.sparkSession
    buckets = shuffle_partitions(spark)
    keys = even_keys(spark, buckets)
    places = repeated(base, lambda data, at: anchors(data, at, length), across=True, kept=4, copies_apart=True)  # looking alike is enough to be a candidate
    places = staged(places, "anchors")  # so that the hashes are off the disks before the texts are shuffled
    copied = copies(base)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Strings(length, 0)
        for batch in batches:
            batch = batch.filter(batch.column("places").is_valid())
            for part, data, at in chunks(batch):
                lists = part.column("places").to_pylist()
                anchor = [np.frombuffer(b"".join(x), "<u4") for x in lists]
                where = np.concatenate(anchor).astype(np.int64) + np.repeat(at[:-1], [len(x) for x in anchor])
                first, last = (np.repeat(x, [len(y) for y in anchor]) for x in (at[:-1], at[1:]))
                change = np.bincount(np.maximum(where - (length - GRAM), first), minlength=len(data) + 1)
                change -= np.bincount(np.minimum(where, last - length) + 1, minlength=len(data) + 1)
                windows = np.flatnonzero(np.cumsum(change) > 0)
                doc, mark = (part.column(c).to_numpy() for c in ("doc_id", "mark"))
                held.add(encoded(data), windows, at[:-1], doc, mark, np.zeros(part.num_rows, np.int64))
                if held.bytes > HELD_BYTES:
                    yield from _handed_over(held, keys)
        yield from _handed_over(held, keys)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [np.array([0, n - length + 1], "<u4").tobytes() for n in batch.column("n_bytes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(pairs, pa.binary())], names=["doc_id", "mark", "places"])

    left_out = copied.select("doc_id", "mark", F.lit(True).alias("_copy")).hint("merge")
    alone = with_places(base, places).join(left_out, ["doc_id", "mark"], "left").where("places is not null and _copy is null")
    dealt, answers = alone.mapInArrow(strings, ROWS), None
    for seed in range(LEVELS + 1):
        merge = dealt.repartition(buckets, "key").sortWithinPartitions("part").mapInArrow(lambda x, seed=seed: _merge(x, length, group_bytes, seed, keys), ROWS)
        done = staged(merge, f"merged-{seed}")
        own = done.where("part is null").select(F.col("key").alias("part"), "docs", "counts", "places")
        answers = own if answers is None else answers.unionByName(own)
        dealt = done.where("part is not null")
        released(spark)
        if dealt.isEmpty():
            break
    return gathered(answers, buckets).unionByName(copied.where(F.col("n_bytes") >= length).mapInArrow(whole, PLACES))


def _spans(blobs: list[bytes] | None, length: int, size: int) -> list[tuple[int, int]]:
    """Maximal removed stretches of bytes."""
    if not blobs:
        return []
    pairs = np.frombuffer(b"".join(blobs), "<u4").reshape(-1, 2).astype(np.int64)
    begin, end = pairs[:, 0], pairs[:, 0] + pairs[:, 1] + length - 1
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    fresh = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]]))
    last = np.concatenate([fresh[1:], [len(begin)]]) - 1
    return list(zip(begin[fresh].tolist(), reach[last].tolist(), strict=True))


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    cuts = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def summary(docs: DataFrame, length: int = LENGTH, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of docs."""
    base = marked(docs)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in chunks(batch):
                raw, out = data.tobytes(), []
                for i, (doc, blobs) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("places").to_pylist(), strict=True)):
                    text = raw[at[i] : at[i + 1]]
                    spans = _spans(blobs, length, len(text))
                    out.append((None if doc == NO_ID else doc, len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_kept(text, spans)).hexdigest()))
                yield as_rows(names, [pa.int64()] * 4 + [pa.string()], out)

    return with_places(base, removed(base, length, group_bytes)).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame, length: int = LENGTH, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """docs with the repeated bytes cut out of text; all columns are kept (n_chars, where there is one, is counted anew)."""
    columns = docs.columns
    rest = [c for c in columns if c not in ("doc_id", "text")]
    full = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("mark"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("text").isNull().alias("none"), F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(rest)), F.lit(0).alias("z")).alias("rest"))
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("none", full.schema["none"].dataType), full.schema["rest"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in chunks(batch):
                raw = data.tobytes()
                texts = []
                for i, blobs in enumerate(part.column("places").to_pylist()):
                    text = raw[at[i] : at[i + 1]]
                    spans = _spans(blobs, length, len(text))
                    texts.append((_kept(text, spans) if spans else text).decode(errors="ignore"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), part.column("none"), part.column("rest")], names=["doc_id", "text", "none", "rest"])

    out = with_places(full, removed(full, length, group_bytes)).select("doc_id", "text", "none", "rest", "places").mapInArrow(run, schema)
    at = {c: F.col(f"rest.c{i}") for i, c in enumerate(rest)}
    at["doc_id"] = F.nullif(F.col("doc_id"), F.lit(int(NO_ID)))
    at["text"] = F.when(~F.col("none"), F.col("text"))
    if "n_chars" in at:
        at["n_chars"] = F.coalesce(F.length(at["text"]), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return out.select(*(at[c].alias(c) for c in columns))


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return summary(spark.read.parquet(f"{sf_dir}/documents.parquet"))
