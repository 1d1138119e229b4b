"""Burrows-Wheeler transforms of shards of strings, and their merge by interleave refinement.

A shard is what one task hands over: strings one after another, each with an end
(byte 0) after it, which text itself has as 255, a byte that UTF-8 never has.
Its suffixes are sorted as far as asked and give its transform: the byte before
each suffix, and the entry of the suffix that is one byte longer.

Transforms of shards are merged without sorting suffixes across shards. The
interleave begins with the shards one after another in one block; each round
reads the transforms at its entries, and a block whose entries have different
bytes before them is dealt out by these, stably. Rounds read four bytes at
once. After a round the borders between blocks are where the common prefix is
under the bytes read. An entry alone in its block stays so and takes no further
part. After `depth` bytes a block is an interval: one string of `depth` bytes
and all its places.
"""

from __future__ import annotations

import numpy as np

_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
_PLACE = 17  # bits of a place in what is sorted at once
SORTED_BYTES = 1 << _PLACE
SORTED_SHARDS = 1 << 6


def encoded(data: np.ndarray) -> np.ndarray:
    """Bytes with 0 as 255."""
    out = data.copy()
    out[out == 0] = 255
    return out


def _first_bytes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Five bytes from each place as a number, with zeros from the string's end on, and whether that end is among them."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.ndarray(len(text), ">u8", padded, strides=(1,)).astype(np.uint64)
    ends = ~(((word & _LOW) + _LOW) | word | _LOW)  # 0x80 in each byte that is zero
    for shift in (8, 16, 32):
        ends |= ends >> np.uint64(shift)
    word &= ~((ends >> np.uint64(7)) * np.uint64(255))
    return word >> np.uint64(24), (ends & np.uint64(0x80000000)) != 0


def suffix_order(text: np.ndarray, shard: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of (shard, first `depth` bytes of the suffix, up to its string's end).

    At most SORTED_BYTES places; shard: one for each, under SORTED_SHARDS. Five
    bytes first, then by doubling: what is still tied is sorted by the rank of
    the suffix that begins where the known part ends. Keys carry the place, so
    sorting numbers is all it takes.
    """
    low, n = np.uint64(SORTED_BYTES - 1), len(text)
    key, ended = _first_bytes(text)
    key |= shard.astype(np.uint64) << np.uint64(40)
    key <<= np.uint64(_PLACE)
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    order = (key & low).astype(np.int32)
    key >>= np.uint64(_PLACE)
    fresh = np.ones(n, bool)
    np.not_equal(key[1:], key[:-1], out=fresh[1:])
    fresh |= ended[order]  # equal up to their ends: by place, as they are
    slot = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=np.int32), 0))
    rank = np.empty(n, np.int32)
    rank[order] = slot
    known = 5
    while known < depth:
        single = fresh.copy()
        single[:-1] &= fresh[1:]
        at = np.flatnonzero(~single)
        if not len(at):
            break
        step = min(known, depth - known)
        own = order[at]
        key = (((slot[at].astype(np.uint64) << np.uint64(_PLACE)) | rank[own + step].astype(np.uint64)) << np.uint64(_PLACE)) | own.astype(np.uint64)
        key.sort()
        own = (key & low).astype(np.int32)
        key >>= np.uint64(_PLACE)
        first = np.ones(len(key), bool)
        np.not_equal(key[1:], key[:-1], out=first[1:])
        order[at], fresh[at] = own, first
        slot[at] = rank[own] = np.maximum.accumulate(np.where(first, at, 0))
        known += step
    return order


def transforms(text: np.ndarray, shards: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte before, entry one byte longer, place) of each entry, shard after shard. shards: bytes of each; larger ones are taken in parts, cut after a string."""
    cuts = [0]
    for end in np.cumsum(shards).tolist():
        while end - cuts[-1] > SORTED_BYTES:
            room = text[cuts[-1] : cuts[-1] + SORTED_BYTES]
            cuts.append(cuts[-1] + len(room) - int(np.argmin(room[::-1])))
        if end > cuts[-1]:
            cuts.append(end)
    symbol, back, where = np.empty(len(text), np.uint8), np.empty(len(text), np.int32), np.empty(len(text), np.int32)
    i = 0
    while i + 1 < len(cuts):
        j = i + 1
        while j + 1 < len(cuts) and j - i < SORTED_SHARDS and cuts[j + 1] - cuts[i] <= SORTED_BYTES:
            j += 1
        a, b = cuts[i], cuts[j]
        own = text[a:b]
        order = suffix_order(own, np.repeat(np.arange(j - i, dtype=np.uint8), np.diff(cuts[i : j + 1])), depth)
        rank = np.empty(b - a, np.int32)
        rank[order] = np.arange(b - a, dtype=np.int32)
        symbol[a:b], back[a:b], where[a:b] = own[order - 1], rank[order - 1] + a, order + a
        i = j
    return symbol, back, where


def _sorted_within(block: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The stable order of (block, key of 32 bits)."""
    n = len(block)
    bits = int(n - 1).bit_length()
    if int(block[-1]).bit_length() + 32 + bits <= 64:
        packed = (((block.astype(np.uint64) << np.uint64(32)) | key) << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
        packed.sort()
        return (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
    return np.argsort((block.astype(np.int64) << 32) | key, kind="stable")


def merged_intervals(text: np.ndarray, shards: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, whether an interval begins) of the strings of `depth` bytes that occur again, interval by interval. depth must be even."""
    symbol, back, where = transforms(text, shards, depth)
    size = np.diff(np.flatnonzero(text == 0), prepend=-1)
    # what has under `depth` bytes before it in its string ends before it tells anything
    far = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size) >= depth
    entries = np.flatnonzero(far[where]).astype(np.int32)
    two = (symbol[back].astype(np.uint32) << 8) | symbol
    back2 = back[back]
    four, back4 = (two[back2] << 16) | two, back2[back2]
    begins = np.zeros(len(entries), bool)
    begins[:1] = True
    for longer, before in [*[(back4, four)] * (depth // 4), *[(back2, two)] * (depth % 4 // 2)]:
        if not len(entries):
            break
        key = before[entries]
        border = np.ones(len(key), bool)
        np.not_equal(key[1:], key[:-1], out=border[1:])
        inner = border & ~begins
        if inner.any():
            block = np.cumsum(begins, dtype=np.int32) - 1
            mixed = np.zeros(int(block[-1]) + 1, bool)
            mixed[block[inner]] = True
            at = np.flatnonzero(mixed[block])
            own = block[at]
            own = np.cumsum(np.concatenate([[0], own[1:] != own[:-1]]))
            order = at[_sorted_within(own, key[at])]
            entries[at], key[at] = entries[order], key[order]
            np.not_equal(key[1:], key[:-1], out=border[1:])
            begins |= border
        entries = longer[entries]
        again = ~begins
        again[:-1] |= ~begins[1:]
        if not again.all():
            entries, begins = entries[again], begins[again]
    return where[entries], begins


def repeats_of_later(begins: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which entries of blocks have a larger doc than the least of their block. begins: True where a block begins."""
    if not len(docs):
        return np.zeros(0, bool)
    least = np.minimum.reduceat(docs, np.flatnonzero(begins))
    return docs > least[np.cumsum(begins) - 1]
