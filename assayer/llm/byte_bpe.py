"""Byte-level BPE by backtracking over longest matches: exact merges in linear time.

A text is cut by the tokenizer's pattern and each match is encoded by itself. A
match that is a token is that token. In any other, merging by rank gives the one
sequence of tokens in which each two neighbours are compatible: merging just the
bytes of the two gives these two again. So tokens are taken from the left, the
longest that matches first (an Aho-Corasick automaton over bytes as Latin-1
letters); where it doesn't go with the token before, the next shorter token that
is a prefix of it, and where none does, the token before is given up for its own
next shorter one. The sequence that reaches a place is the only one that does, so
a place that leads nowhere is never tried again: each is left once, and the work
is linear however long a match is. Compatibility of two tokens is worked out once
and remembered.

The pattern's classes are those of the tokenizer library's version of Unicode:
for the cutting, letters that only the regex module knows stand as another
character. Matches seen before come from a bounded table. Texts of over PIECES matches are
encoded so many at a time.

Defined results: null text is the empty text, which has no tokens and decodes to
nothing. Special tokens' names are ordinary text. Rows are encoded as they come:
repeated rows and null ids are kept, other columns too, but where `ids` (or
`decoded`) would clash, which is replaced. Decoding gives bytes, those of the
text. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from assayer.llm.common import chunks

PIECES = 1 << 16
CACHE = 400_000
PAIRS = 2_000_000
LONGEST_CACHED = 40
FAR = "\U00010000"
OTHER = "\uffff"  # no letter, number or space in any version


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int], below: float = math.inf) -> list[int]:
    """The definition: of all neighbours that make a token (of a rank under `below`), those of the least rank are joined, the first of them first, until none do."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], math.inf), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def newer_characters() -> str:
    """Letters and numbers that the regex module knows and the tokenizer library's engine doesn't yet: the two follow different versions of Unicode."""
    import regex
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    byte_ranks = {bytes([b]): b for b in range(256)}
    out = []
    for kind in (r"\p{L}", r"\p{N}"):
        known = bytes(tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks=byte_ranks, special_tokens={}).encode_ordinary(every)).decode()
        out += set(regex.findall(kind, every)) - set(known)
    return "".join(sorted(out))


class ByteEncoder:
    """encode(text) gives little-endian signed 32-bit ids as bytes; decode(ids) gives bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.reach = max(map(len, ranks))
        newer = newer_characters()
        self.maybe = re.compile(f"[{re.escape(''.join(c for c in newer if c < FAR))}{FAR}-\U0010ffff]")  # all beyond the first plane: a class of few ranges is quick
        self.newer = frozenset(newer)
        self.plain = dict.fromkeys(map(ord, newer), OTHER)
        self.shorter: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.edges: tuple[dict, dict] = {}, {}
        self.packed = {rank: rank.to_bytes(4, "little") for rank in self.tokens}
        self.seen: dict[str, bytes] = {}

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens of which merging makes this one last; None where it never does."""
        found = merge(self.tokens[token], self.ranks, token)
        return tuple(found) if len(found) == 2 else None

    def edge(self, token: int, last: int) -> list[tuple[bytes, float]] | None:
        """The tokens that the first (last = 0) or last (1) byte is in while the token is made, each with the rank at which it goes into the next."""
        known = self.edges[last].get(token, ())
        if known == ():
            own, end = self.tokens[token], math.inf
            known = [(own, end)]
            while len(own) > 1 and known is not None:
                made = self.parts(self.ranks[own])
                known = None if made is None else [(self.tokens[made[last]], self.ranks[own]), *known]
                own = known[0][0] if known else b""
            self.edges[last][token] = known
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of the two gives the two: no merge across the border comes before the border's tokens go into their own."""
        known = self.pairs.get((a, b))
        if known is None:
            known = self._apart(self.edge(a, 1), self.edge(b, 0))
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def _apart(self, lefts: list | None, rights: list | None) -> bool:
        if lefts is None or rights is None:
            return False
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = lefts[i], rights[j]
            across = self.ranks.get(x + y)
            if across is not None and across < x_ends and across <= y_ends:  # of merges of one rank the first comes first
                return False
            if x_ends == y_ends == math.inf:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix; -1: none."""
        found = self.shorter.get(token)
        if found is None:
            own = self.tokens[token]
            found = next((self.ranks[own[:k]] for k in range(len(own) - 1, 0, -1) if own[:k] in self.ranks), -1)
            self.shorter[token] = found
        return found

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one match."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        letters = piece.decode("latin-1")
        end = len(letters)
        dead = bytearray(end + 1)
        out: list[int] = []
        at = 0
        token = self.longest(letters, 0)
        while True:
            after = at + len(self.tokens[token])
            if not dead[after] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = after
                if at == end:
                    return out
                token = self.longest(letters, at)
                continue
            token = self.prefix(token)
            while token < 0:  # nothing goes on from here
                dead[at] = 1
                last = out.pop()
                at -= len(self.tokens[last])
                token = self.prefix(last)

    def longest(self, letters: str, at: int) -> int:
        return next(self.automaton.iter_long(letters[at : at + self.reach]))[1]  # a slice: the automaton copies what it is given

    def ids(self, piece: str) -> bytes:
        found = b"".join([self.packed[i] for i in self.piece(piece.encode())])
        if len(piece) <= LONGEST_CACHED:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            self.seen[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        odd = not text.isascii() and self.maybe.search(text) and not self.newer.isdisjoint(text)
        if len(text) <= PIECES and not odd:
            return self._encoded(self.pattern.findall(text))
        matches, out = self.pattern.finditer(text.translate(self.plain) if odd else text), bytearray()
        while pieces := [text[m.start() : m.end()] for m in islice(matches, PIECES)]:
            out += self._encoded(pieces)
        return bytes(out)

    def _encoded(self, pieces: list[str]) -> bytes:
        found = list(map(self.seen.get, pieces))
        if None in found:
            found = [x if x is not None else self.seen.get(p) or self.ids(p) for x, p in zip(found, pieces, strict=True)]
        return b"".join(found)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_encoders: dict[tuple[str, str], ByteEncoder] = {}


def encoder(path: str, pattern: str) -> ByteEncoder:
    """One for each worker process, so that its tables last from task to task."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = ByteEncoder(read_ranks(path), pattern)
    return _encoders[path, pattern]


def _defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def _added(df: DataFrame, name: str, kind) -> StructType:
    return StructType([*(f for f in df.schema.fields if f.name != name), StructField(name, kind)])


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, text: str = "text") -> DataFrame:
    """docs with ids: array<int>, the tokens of the text. ranks: path of a file of base64 tokens and ranks."""
    path, pattern = _defaults(ranks, pattern)
    schema = _added(docs, "ids", ArrayType(IntegerType(), False))
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for part, data, at in chunks(batch, "_text"):
                whole = data.tobytes()
                found = [own.encode(whole[a:b].decode()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                ends = np.cumsum([0, *(len(x) // 4 for x in found)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([ids if c == "ids" else part.column(c) for c in names], names=names)

    rows = docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """encoded (ids) with decoded: binary. A null in ids, or for ids, is nothing; an id that isn't a token is an error."""
    path, pattern = _defaults(ranks, pattern)
    schema = _added(encoded, "decoded", BinaryType())
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            column = batch.column("ids")
            texts = [own.decode(row.values.drop_null().to_numpy(zero_copy_only=False)) if row.is_valid else b"" for row in column]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()) if c == "decoded" else batch.column(c) for c in names], names=names)

    return encoded.mapInArrow(run, schema)


def op11_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decode(encode(docs).drop("text"))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
