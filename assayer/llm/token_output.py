"""Token-id output: best-fit-decreasing packing, written as binary matrices.

Each task takes its documents in blocks of a bounded number of tokens. Within a
block, documents longer than a row are cut at row length (nothing is lost);
pieces go, longest first, to the row with the least free space that still
fits. A segment tree over free space, holding how many open rows have each,
finds it in log(row length) steps.

Every block becomes five files of one stem: `.ids` (unsigned ids, rows x size,
16 bits where the vocabulary allows, else 32), `.cu` (int32 cumulative segment
lengths of each row, from 0), `.rows` (int64 place of each row's first number
in .cu), `.pos` (positions of each token, which start at 0 anew with every
segment, 0 in padding; 16 or 32 bits, zstd) and `.seg` (int64 triples doc_id,
piece, start for each segment; flagged by `.seg`'s fourth number where doc_id is
null). Names follow from task and block, files are moved to their names when
complete, and the manifest says which count; each task writes its own lines of
it. A folder that holds anything is refused. Blocks follow the input's
partitions, so other partitions give other files.

Defined results: null text is the empty text. Each document ends with `end_id`,
so an empty one is one token. Repeated rows are written again. Extra columns are
ignored. An empty table gives an empty manifest and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import files
from assayer.llm.common import shared_dir, shuffle_partitions

SIZE = 2048
BLOCK_TOKENS = 4 << 20
END_ID = 50_256
MANIFEST = "stem string, matrix_rows long, segments long, tokens long, checksum long, size long, kind string"
SEGMENTS = "doc_id long, piece int, start long, length long, sequence string, offset long, ids_crc32 long"


class CapacityTree:
    """Counts of open rows by free space, 0 to size, as a segment tree: tightest(length) is the least free space of at least length, or -1."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, free: int, n: int) -> None:
        i = self.leaves + free
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, length: int) -> int:
        i = self.leaves + length
        if self.count[i]:
            return length
        while i > 1:  # up to the first right sibling that holds any, then down to its left-most
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Rows as lists of places in lengths."""
    tree, rows = CapacityTree(size), []
    at: list[list[int]] = [[] for _ in range(size + 1)]
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        free = tree.tightest(lengths[i])
        if free < 0:
            free, row = size, len(rows)
            rows.append([])
        else:
            row = at[free].pop()
            tree.add(free, -1)
        rows[row].append(i)
        at[free - lengths[i]].append(row)
        tree.add(free - lengths[i], 1)
    return rows


_encodings: dict = {}


def byte_encoding(path: str):
    if path not in _encodings:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def block_files(pieces: list[tuple[int | None, int, int, np.ndarray]], size: int, kind: str) -> dict[str, bytes]:
    """The five files of a block of (doc_id, piece, start, ids), and what the manifest says of it."""
    lengths = [len(p[3]) for p in pieces]
    rows = best_fit_decreasing(lengths, size)
    ids = np.zeros((len(rows), size), kind)
    pos = np.zeros((len(rows), size), "<u2" if size <= 1 << 16 else "<u4")
    ramp = np.arange(size, dtype=pos.dtype)
    cu, first, seg = [], [], []
    for r, row in enumerate(rows):
        first.append(len(cu))
        at = 0
        cu.append(0)
        for i in row:
            doc, piece, start, own = pieces[i]
            ids[r, at : at + len(own)] = own
            pos[r, at : at + len(own)] = ramp[: len(own)]
            at += len(own)
            cu.append(at)
            seg.append((0 if doc is None else doc, piece, start, doc is None))
    first.append(len(cu))
    return {"ids": ids.tobytes(), "cu": np.array(cu, "<i4").tobytes(), "rows": np.array(first, "<i8").tobytes(), "pos": zstandard.compress(pos.tobytes(), 1), "seg": np.array(seg, "<i8").tobytes()}


def write(docs: DataFrame, folder: str, size: int = SIZE, tokenizer: str | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Writes docs (doc_id, text) and the manifest, which it returns, under folder, which must be empty or absent."""
    path = tokenizer or default_path()
    kind = "<u2" if max(end_id, byte_encoding(path).max_token_value) < 1 << 16 else "<u4"
    files.refuse_if_used(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        encode = byte_encoding(path).encode_ordinary
        system, base = files.open_fs(folder)
        done: list[tuple] = []
        pieces: list[tuple] = []
        held = 0

        def flush():
            stem = f"part-{task:06d}-{number:05d}"
            made = block_files(pieces, size, kind)
            for name, data in made.items():
                file = files.Pending(system, base, f"{stem}.{name}")
                file.write(data)
                file.commit()
            done.append((stem, len(made["rows"]) // 8 - 1, len(pieces), held, zlib.crc32(made["ids"]), size, kind))

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], kind)
                for i, a in enumerate(range(0, len(ids), size)):
                    pieces.append((doc, i, a, ids[a : a + size]))
                    held += len(pieces[-1][3])
                    if held >= block_tokens:
                        flush()
                        pieces, held, number = [], 0, number + 1
        if pieces:
            flush()
        yield files.as_rows([x.split()[0] for x in MANIFEST.split(", ")], [pa.string(), *[pa.int64()] * 5, pa.string()], done)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    files.write_manifest(rows.mapInArrow(run, MANIFEST), folder)
    return files.read_manifest(docs.sparkSession, folder, MANIFEST)


def read_block(folder: str, stem: str, size: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids and positions (rows x size), cumulative lengths, rows' places in them, segments (doc_id, piece, start, null)."""
    data = {x: files.read_whole(folder, f"{stem}.{x}") for x in ("ids", "cu", "rows", "pos", "seg")}
    pos = np.frombuffer(zstandard.decompress(data["pos"]), "<u2" if size <= 1 << 16 else "<u4").reshape(-1, size)
    return np.frombuffer(data["ids"], kind).reshape(-1, size), pos, np.frombuffer(data["cu"], "<i4"), np.frombuffer(data["rows"], "<i8"), np.frombuffer(data["seg"], "<i8").reshape(-1, 4)


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each segment of the written matrices, its ids read back; checksums and position resets are checked."""
    rows = files.read_manifest(spark, folder, MANIFEST).select("stem", "size", "kind", "checksum")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for x in frame.to_pylist():
                ids, pos, cu, first, seg = read_block(folder, x["stem"], x["size"], x["kind"])
                if zlib.crc32(ids) != x["checksum"]:
                    raise ValueError(f"{x['stem']}: checksum mismatch")
                out, s = [], 0
                for r in range(len(ids)):
                    own = cu[first[r] : first[r + 1]].tolist()
                    for a, b in zip(own[:-1], own[1:], strict=True):
                        doc, piece, start, null = seg[s].tolist()
                        s += 1
                        if pos[r, a] or pos[r, b - 1] != b - a - 1:
                            raise ValueError(f"{x['stem']}: positions do not restart at {r}, {a}")
                        out.append((None if null else doc, piece, start, b - a, f"{x['stem']}/{r}", a, zlib.crc32(ids[r, a:b].astype("<u4").tobytes())))
                yield files.as_rows([c.split()[0] for c in SEGMENTS.split(", ")], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()], out)

    n = max(1, min(rows.count(), 4 * shuffle_partitions(spark)))
    return rows.repartition(n).mapInArrow(run, SEGMENTS)


def op10_token_output(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_segments(spark, folder)
