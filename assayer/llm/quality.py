"""Quality classifier: naive Bayes support vectors.

A text's features are hashed runs that occur in it, each once: of `order` bytes,
of `order` + 2 shapes (upper or lower case, digit, blank, or the sign itself),
and of two words. A feature's ratio is the log of its smoothed share in class 1
over that in class 0, counted by Spark over all labelled training rows. A text is
the vector of its features' ratios at unit length (shorter for very short texts);
a linear model with hinge loss is fitted to such vectors by dual coordinate
descent. The fit uses at most `sample` labelled rows, those of the smallest hash
of doc_id (at ties, of text and label), and of these as many as have at most
`numbers` features together; counts use all rows.

Scores are a logistic curve over the margin, set on the same sample. Labels,
language, source and doc_id are no inputs.

Defined results: null text is the empty text, which has no features; its score
comes from the intercept. Rows with a null or other label than 0 and 1 train
nothing. Repeated rows and several labels of a document each count. With one class or no
labels at all, every score is the share of class 1 (0.5 without labels). Each
row is scored, repeated ones too; extra columns are ignored. A column of df
called `score` that is kept stays, and the score is then called `_score`. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from assayer.llm.common import bytes_of, chunks, staged, word_hashes

BITS = 18
ORDER = 4
SAMPLE = 5_000
NUMBERS = 16 << 20  # 64 MB of features on the driver
COST = 1.0
SMOOTH = 1.0
EPOCHS = 12
PRIOR = 100.0  # squared length that a text's vector has besides its own: short texts stay near the intercept
_MULTIPLIER = np.uint32(0x9E3779B1)
_PAIR = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    weights: np.ndarray  # of features at ratio scale, float32
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float
    bits: int = BITS
    order: int = ORDER


def _shapes() -> np.ndarray:
    """Letters by case, digits and blanks as one each, the rest as it is."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91], table[97:123], table[48:58] = 65, 97, 48
    table[128:] = 97
    table[[9, 11, 12, 32]] = 32
    return table


_SHAPE = _shapes()


def _runs(data: np.ndarray, order: int, salt: int, bits: int) -> np.ndarray:
    """The feature of the run of `order` bytes from each place."""
    codes = np.full(len(data), salt, np.uint32)
    for j in range(order):
        codes[: len(data) - j] = codes[: len(data) - j] * np.uint32(0x01000193) ^ data[j:]
    codes ^= codes >> np.uint32(15)
    return (codes * _MULTIPLIER) >> np.uint32(32 - bits)


def row_features(data: np.ndarray, at: np.ndarray, bits: int, order: int) -> Iterator[np.ndarray]:
    """For each row its features' numbers, each once, ascending: runs of bytes, of shapes of bytes, and of two words."""
    kinds = [(_runs(data, order, 1, bits), order), (_runs(_SHAPE[data], order + 2, 2, bits), order + 2)]
    words, _, bounds = word_hashes(data, at)
    pairs = ((words[:-1] * _PAIR + words[1:]) >> np.uint64(64 - bits)).astype(np.uint32)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        own = np.sort(np.concatenate([*(k[a : max(a, b - n + 1)] for k, n in kinds), pairs[bounds[i] : max(bounds[i], bounds[i + 1] - 1)]]))
        yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def class_counts(rows: DataFrame, bits: int = BITS, order: int = ORDER) -> np.ndarray:
    """2 x 2**bits: in how many rows of each class a feature occurs. rows: (text, label). The result's size is fixed by bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            for part, data, at in chunks(batch):
                for y, x in zip(part.column("label").to_pylist(), row_features(data, at, bits, order), strict=True):
                    total[y, x] += 1
        y, x = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(x, pa.int32()), pa.array(total[y, x], pa.int64())], names=["label", "feature", "n"])

    # fewer, larger tasks: what each sends is bounded by 2**bits rows a class
    found = rows.mapInArrow(count, "label int, feature int, n long").groupBy("label", "feature").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((2, 1 << bits), np.int64)
    total[found["label"].to_numpy(), found["feature"].to_numpy()] = found["n"].to_numpy()
    return total


def fit_hinge(rows: Sequence[np.ndarray], values: Sequence[np.ndarray], labels: np.ndarray, size: int, cost: float = COST, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Linear model of hinge loss by dual coordinate descent, with a constant feature as intercept. labels: +1 or -1; classes weigh alike."""
    w, bias = np.zeros(size), 0.0
    share = {y: max(1, int((labels == y).sum())) for y in (1, -1)}
    upper = np.where(labels == 1, cost * len(labels) / (2 * share[1]), cost * len(labels) / (2 * share[-1]))
    alpha = np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x, v, y = rows[i], values[i], labels[i]
            gradient = y * (float(w[x] @ v) + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), upper[i])
            step = (new - alpha[i]) * y
            if step:
                w[x] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def _scaled(features: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    v = ratios[features]
    return v / np.sqrt(v @ v + PRIOR)


class _Vectors(Sequence):
    """The rows' vectors, each made when it is asked for: together they are as large as the rows."""

    def __init__(self, rows: list[np.ndarray], ratios: np.ndarray, lengths: np.ndarray | None = None):
        self.rows, self.ratios = rows, ratios
        self.lengths = np.array([np.sqrt(ratios[x] @ ratios[x] + PRIOR) for x in rows]) if lengths is None else lengths

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> np.ndarray:
        return (self.ratios[self.rows[i]] / self.lengths[i]).astype(np.float32)

    def part(self, at: np.ndarray) -> _Vectors:
        return _Vectors([self.rows[i] for i in at], self.ratios, self.lengths[at])


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve that fits the labels best, by Newton's steps: scores are shares of class 1."""
    a, b = 1.0, 0.0
    y = (labels > 0).astype(float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([np.sum((p - y) * margins) + 1e-3 * a, np.sum(p - y)])
        h = p * (1 - p) + 1e-9
        hess = np.array([[np.sum(h * margins**2) + 1e-3, np.sum(h * margins)], [np.sum(h * margins), np.sum(h) + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def _sampled(labelled: DataFrame, sample: int) -> DataFrame:
    """The `sample` rows of the smallest (hash of doc_id, hash of text and label). Keys are compared first, without texts."""
    keyed = labelled.withColumns({"_at": F.xxhash64("doc_id"), "_tie": F.xxhash64("text", "label")})
    last = keyed.select("_at").orderBy("_at").limit(sample).agg(F.max("_at"), F.count("*")).first()
    if not last[1]:
        return keyed.limit(0)
    within = keyed.where(F.col("_at") <= F.lit(last[0]))
    below, all_ = within.agg(F.count(F.when(F.col("_at") < F.lit(last[0]), 1)), F.count("*")).first()
    if all_ <= sample:
        return within
    edge = within.where(F.col("_at") == F.lit(last[0])).select("_tie").orderBy("_tie").limit(sample - below).agg(F.max("_tie")).first()[0]
    tied = within.where((F.col("_at") == F.lit(last[0])) & (F.col("_tie") <= F.lit(edge))).orderBy("_tie").limit(sample - below)
    return within.where(F.col("_at") < F.lit(last[0])).unionByName(tied)


def fit(labelled: DataFrame, bits: int = BITS, order: int = ORDER, sample: int = SAMPLE, numbers: int = NUMBERS) -> Model:
    """labelled: (doc_id, text, label). Counts cover every row; the linear model is fitted to at most `sample` of them, with at most `numbers` features together."""
    labelled = labelled.where(F.col("label").isin(0, 1)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    total = class_counts(labelled.select("text", "label"), bits, order)
    share = total.sum(1) + SMOOTH * total.shape[1]
    ratios = np.log((total[1] + SMOOTH) / share[1]) - np.log((total[0] + SMOOTH) / share[0])
    names = ["at", "tie", "label", "n", "features"]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in chunks(batch):
                rows = list(row_features(data, at, bits, order))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("_at", "_tie", "label")), pa.array([len(x) for x in rows], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in rows], pa.binary())], names=names)

    chosen = staged(_sampled(labelled, sample).select("_at", "_tie", "text", "label").mapInArrow(vectors, "at long, tie long, label int, n long, features binary"), "sample")
    sizes = np.array(sorted((r["at"], r["tie"], r["n"]) for r in chosen.select("at", "tie", "n").collect()), np.int64).reshape(-1, 3)
    if not len(sizes):
        return Model(np.zeros(1 << bits, np.float32), ratios, 0.0, 1.0, 0.0, bits, order)
    fits = max(1, int((np.cumsum(sizes[:, 2]) <= numbers).sum()))
    taken = (chosen.where(F.col("at") <= F.lit(int(sizes[fits - 1, 0]))) if fits < len(sizes) else chosen).select("at", "tie", "label", "features").toArrow()
    by = np.lexsort((taken["tie"].to_numpy(), taken["at"].to_numpy()))[:fits]
    y = taken["label"].to_numpy()[by]
    data, at = bytes_of(taken["features"])  # held once, as it came
    rows = [data[at[i] : at[i + 1]].view("<u4") for i in by.tolist()]
    del taken
    pa.default_memory_pool().release_unused()
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << bits, np.float32), ratios, 1.0 if y.all() else -1.0, 30.0, 0.0, bits, order)
    values = _Vectors(rows, ratios)
    signs = np.where(y == 1, 1, -1)
    w, bias = fit_hinge(rows, values, signs, 1 << bits)
    margins = np.empty(len(rows))
    fold = np.arange(len(rows)) % 2  # the curve is set on rows that the model at hand hasn't seen
    for f in (0, 1):
        seen, unseen = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        own, shift = (w, bias) if len(set(signs[seen].tolist())) < 2 else fit_hinge([rows[i] for i in seen], values.part(seen), signs[seen], 1 << bits)
        margins[unseen] = [float(own[rows[i]] @ values[i]) + shift for i in unseen]
    slope, shift = _logistic(margins, signs)
    return Model(w.astype(np.float32), ratios, bias, slope, shift, bits, order)


def _score(m: Model, features: np.ndarray) -> float:
    margin = m.bias + (float(m.weights[features] @ _scaled(features, m.ratios)) if len(features) else 0.0)
    return float(1 / (1 + np.exp(-np.clip(m.slope * margin + m.shift, -700, 700))))


def score(df: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """(keep..., score) for every row of df."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 2**bits numbers, twice
    name, text = "score", "_text"
    while name in keep:
        name = f"_{name}"
    while text in keep:
        text = f"_{text}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, data, at in chunks(batch, text):
                out = np.empty(part.num_rows)
                for i, x in enumerate(row_features(data, at, m.bits, m.order)):
                    out[i] = _score(m, x)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(out)], names=[*keep, name])

    schema = StructType([*(df.schema[c] for c in keep), StructField(name, DoubleType())])
    return df.select(*keep, F.coalesce("text", F.lit("")).alias(text)).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text scores at least 0.5, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, data, at in chunks(batch):
                yield part.filter(pa.array([_score(m, x) >= 0.5 for x in row_features(data, at, m.bits, m.order)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(spark, sf_dir: str, docs: DataFrame | None = None) -> Model:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label")).where(~held_out(F.col("doc_id")))
    return fit(docs.select("doc_id", "text").join(labels.hint("merge"), "doc_id"))  # labels grow with the documents: never broadcast


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, train(spark, sf_dir), ["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
