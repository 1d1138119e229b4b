"""Substring dedup by sliding sentence spans.

A text is cut into sentences, which end after `.`, `!`, `?` (with the white
space that follows) or a line break. Every run of `span` consecutive sentences
is hashed to 128 bits, runs are compared over all documents, and every sentence that lies
in a run which is not its hash's first occurrence goes. First is by (doc_id,
text hash, place); a run that occurs again within one document goes there too.
Runs are of `span` sentences or, in texts with fewer, of all of them. A run
without words is no repeat; every other run counts. A caller can ask for a floor,
`least` words in a run, below which headings and lists may recur. Only these
ASCII characters end sentences: of a script with other full stops a line is one.

A passage need not begin and end where sentences do, nor hold three whole ones. A caller
can have such found too (`words`): of the windows of words, those with the least hash
among some neighbours are compared, which are the same ones in any text, so that
every passage of `words` words that an earlier document has shares at least one.
The words of a window whose first occurrence is in another document go, and count
as a sentence removed for each sentence they are of. Up to GAP - 1 words at either end of a
passage may stay; shorter passages, down to a window's words - GAP + 1, may be found.

Defined results: null text is the empty text and stays as it is (''), with no
sentences. Rows alike in doc_id and text are one document: neither is the
other's repeat. A null doc_id is later than all others. Extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import chunks, mix, shingle_hashes, word_hashes
from assayer.llm.files import as_rows
from assayer.llm.repeats import NO_ID, marked, repeated, unpack, with_places

SPAN = 3
WORDS = 50
GAP = 11  # neighbours of which the least is taken: about one window in six
IN_WORDS = 1 << 31  # marks the place of a window, which is its first word
OUT = "doc_id long, text string, n_sentences long, n_removed long, kept_sha256 string"
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n\r"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def sentences(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each sentence, rows one after another, and the place of each row's first (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    end, blank = _END[data], _BLANK[data]
    # a sentence begins at a byte that is neither blank nor an end and follows blanks or ends with an end among them
    solid = ~(end | blank)
    places = np.flatnonzero(solid)
    begins = np.zeros(n, bool)
    if len(places):
        ends = np.cumsum(end)
        gap = np.diff(ends[places]) > 0
        before = np.diff(places) > 1
        # an end only counts before a blank or at a line break: 3.14 is one word
        split = gap & before & (_BLANK[data[places[1:] - 1]])
        begins[places[1:][split]] = True
    first = at[:-1][at[:-1] < at[1:]]
    begins[first] = True
    row_of = np.searchsorted(first, places, "right") - 1
    lead = places[np.concatenate([[True], row_of[1:] != row_of[:-1]])] if len(places) else places
    begins[lead] = False  # what comes before the first solid byte belongs to the first sentence
    begins[first] = True
    starts = np.flatnonzero(begins)
    return starts, np.searchsorted(starts, at)


def runs(data: np.ndarray, at: np.ndarray, span: int, least: int, words: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (two numbers), row and first sentence of each run. Sentences are compared by their words (from word_hashes), in lower case."""
    starts, bounds = sentences(data, at)
    if not len(starts) or not len(words):
        return np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    which = np.searchsorted(starts, begins, "right") - 1
    first = np.searchsorted(which, np.arange(len(starts) + 1))
    count = np.diff(first)
    position = (np.arange(len(words)) - first[which]).astype(np.uint64)
    both = []
    for step in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words + position * np.uint64(step)))])
        both.append(mix(total[first[1:]] - total[first[:-1]] + count.astype(np.uint64)))
    own, place = zip(*(shingle_hashes(hashes, bounds, span) for hashes in both), strict=True)
    own, place = np.stack(own, 1), place[0]
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(place))
    sentence = np.arange(len(own)) - place[row]
    a = bounds[row] + sentence
    b = np.minimum(a + span, bounds[row + 1])
    enough = first[b] - first[a] >= least
    return own[enough], row[enough], sentence[enough].astype(np.uint32)


def windows(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (two numbers), row and first word (with IN_WORDS) of windows, of which every `size` words of a row hold one at least. bounds: of the rows' words."""
    k, n = size - GAP + 1, len(words)
    if n < size:
        return np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    both = []
    for step in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):  # odd: with an inverse
        power, back = (np.cumprod(np.full(n, x, np.uint64)) for x in (step, pow(step, -1, 1 << 64)))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power)])
        both.append(mix((total[k:] - total[:-k]) * back[: n - k + 1] + np.uint64(k)))
    own, groups = both[0], n - size + 1
    least = own[:groups].copy()
    for i in range(1, GAP):
        np.minimum(least, own[i : i + groups], out=least)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    least[np.arange(groups) + size > bounds[1:][row[:groups]]] = 0  # neighbours in two rows
    most = np.zeros(len(own), np.uint64)
    for i in range(GAP):
        np.maximum(most[i : i + groups], least, out=most[i : i + groups])
    at = np.flatnonzero((most == own) & (own > 0))
    return np.stack(both, 1)[at], row[at], ((at - bounds[row[at]]) | IN_WORDS).astype(np.uint32)


def without(raw: np.ndarray, cuts: np.ndarray, gone: np.ndarray, first: np.ndarray, size: int) -> tuple[bytes, int]:
    """A text (bytes) without the sentences (which begin at cuts) that are gone and the windows of size words from first on, and how many sentences lost something."""
    solid = ~_BLANK[raw]
    begins = np.append(np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1]])), len(raw))
    lost = np.zeros(len(raw) + 1, np.int64)
    for a, b in ((cuts[:-1][gone], cuts[1:][gone]), (begins[first], begins[first + size])):
        np.add.at(lost, a, 1)
        np.add.at(lost, b, -1)
    lost = np.cumsum(lost[:-1]) > 0
    touched = np.add.reduceat(lost & solid, cuts[:-1], dtype=np.int64) > 0
    return raw[~lost].tobytes(), int((gone | touched).sum())


def drop_repeated_spans(docs: DataFrame, span: int = SPAN, least: int = 1, words: int = 0) -> DataFrame:
    """docs (doc_id, text) with what is left of each text, the number of its sentences and of those removed. words: of passages that are found wherever they begin; 0: none, otherwise GAP at least."""
    base = marked(docs)

    def items(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes, begins, bounds = word_hashes(data, at)
        found = runs(data, at, span, least, hashes, begins)
        return tuple(np.concatenate(x) for x in zip(found, windows(hashes, bounds, words), strict=True)) if words else found

    places = repeated(base, items, across=False, kept=8, elsewhere=IN_WORDS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for part, data, at in chunks(batch):
                starts, bounds = sentences(data, at)
                out = []
                raw = data.tobytes()
                for i, (doc, blobs) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("places").to_pylist(), strict=True)):
                    text, n = raw[at[i] : at[i + 1]], int(bounds[i + 1] - bounds[i])
                    gone = np.zeros(n + 1, np.int64)
                    first = unpack(blobs)
                    first, inner = first[first < IN_WORDS], first[first >= IN_WORDS] - IN_WORDS
                    np.add.at(gone, first, 1)
                    np.add.at(gone, np.minimum(first + span, n), -1)
                    gone = np.cumsum(gone[:n]) > 0
                    removed = int(gone.sum())
                    if len(inner):
                        cuts = np.append(starts[bounds[i] : bounds[i + 1]], at[i + 1]) - at[i]
                        text, removed = without(data[at[i] : at[i + 1]], cuts, gone, inner, words - GAP + 1)
                    elif removed:
                        cuts = [*starts[bounds[i] : bounds[i + 1]].tolist(), int(at[i + 1])]
                        text = b"".join(raw[cuts[s] : cuts[s + 1]] for s in np.flatnonzero(~gone).tolist())
                    out.append((None if doc == NO_ID else doc, text.decode(), n, removed, hashlib.sha256(text).hexdigest()))
                yield as_rows([x.split()[0] for x in OUT.split(", ")], kinds, out)

    return with_places(base, places).mapInArrow(cut, OUT)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = drop_repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=WORDS)
    return out.select("doc_id", "n_sentences", "n_removed", "kept_sha256", "text")
