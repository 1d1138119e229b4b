import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from assayer.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    out = quality.op9_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in zip(out.doc_id, out.held_out))
    test = out[out.held_out]
    rank = test.score.rank()
    pos = test.quality == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    good, bad = (test[pos].predicted == 1).mean(), (test[~pos].predicted == 0).mean()
    print("auc", auc, "kept", good, "rejected", bad)
    assert auc > 0.97 and good > 0.95 and bad > 0.9


def grams(text, bits, order):
    """A text's features, counted by hand: the operator's numbers for its runs of bytes, of shapes and of two words."""
    raw = text.encode()
    shapes = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b > 127 else 48 if 48 <= b <= 57 else 32 if b in (9, 11, 12, 32) else b for b in raw)
    found = set()
    for data, n, salt in ((raw, order, 1), (shapes, order + 2, 2)):
        for i in range(len(data) - n + 1):
            code = salt
            for b in data[i : i + n]:
                code = (code * 0x01000193 & 0xFFFFFFFF) ^ b
            code ^= code >> 15
            found.add((code * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits))
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    for a, b in zip(words, words[1:]):
        (x, y), *_ = quality.word_hashes(np.frombuffer(f"{a} {b}".encode(), np.uint8), np.array([0, len(f"{a} {b}".encode())]))
        found.add((int(x) * 0x9E3779B97F4A7C15 + int(y) & (1 << 64) - 1) >> (64 - bits))
    return found


def sample_rows():
    r = random.Random(3)
    pool = {0: "bad Stuff!! 99 spam é".split(), 1: "good words, here and there".split()}
    return [(i, " ".join(r.choice(pool[y] + pool[r.randrange(2)]) for _ in range(r.randrange(0, 30))), y) for i in range(150) for y in [r.randrange(2)]]


def test_ratios_and_scores_against_plain_python(spark):
    rows = sample_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3)
    bits, order = 10, 4
    model = quality.fit(df, bits, order)
    found = [grams(t, bits, order) for _, t, _ in rows]
    n = [[1.0] * (1 << bits), [1.0] * (1 << bits)]
    for own, (_, _, y) in zip(found, rows):
        for x in own:
            n[y][x] += 1
    total = [sum(n[0]), sum(n[1])]
    ratios = [math.log(b / total[1]) - math.log(a / total[0]) for a, b in zip(*n)]
    assert np.allclose(model.ratios, ratios)
    scores = {r.doc_id: r.score for r in quality.score(df, model, ["doc_id"]).collect()}
    for own, (doc, _, _) in zip(found, rows):
        size = math.sqrt(sum(ratios[x] ** 2 for x in own) + quality.PRIOR)
        margin = model.bias + sum(float(model.weights[x]) * ratios[x] / size for x in own)
        assert abs(scores[doc] - 1 / (1 + math.exp(-(model.slope * margin + model.shift)))) < 1e-5


def test_the_fit_reaches_the_least_hinge_loss():
    r = np.random.default_rng(5)
    x = r.normal(size=(60, 5))
    y = np.where(x @ r.normal(size=5) + 0.7 * r.normal(size=60) > 0.3, 1, -1)
    rows, values = [np.arange(5)] * 60, list(x)
    w, bias = quality.fit_hinge(rows, values, y, 5, epochs=3000)
    upper = np.where(y == 1, 60 / (2 * (y == 1).sum()), 60 / (2 * (y == -1).sum()))

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + float(upper @ np.maximum(0, 1 - y * (x @ w + b)))

    best, point = loss(np.zeros(5), 0.0), np.zeros(6)
    for step in range(60_000):  # a plain subgradient walk
        own = y * (x @ point[:5] + point[5]) < 1
        g = point - np.concatenate([(upper * y * own) @ x, [(upper * y * own).sum()]])
        point = point - g / (step + 20)
        best = min(best, loss(point[:5], point[5]))
    assert loss(w, bias) <= best * 1.0005


def test_the_sample_is_settled_at_ties_and_bounded(spark):
    rows = sample_rows()[:40] + [(7, f"tied text {i}", i % 2) for i in range(60)] + [(7, "tied text 3", 1)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    for sample in (3, 20, 70, 500):
        one, two = ([tuple(r) for r in quality._sampled(df.repartition(n), sample).select("doc_id", "text", "label").collect()] for n in (1, 5))
        assert sorted(one) == sorted(two) and len(one) == min(sample, len(rows))
    a, b = (quality.fit(df.repartition(n), 12, 4, 50, 900) for n in (1, 4))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias and a.slope == b.slope


def test_a_kept_column_may_be_called_score(spark):
    df = spark.createDataFrame([(1, "good words", "kept", "x")], "doc_id long, text string, score string, _text string")
    out = quality.score(df, quality.fit(spark.createDataFrame(sample_rows(), "doc_id long, text string, label int")), ["doc_id", "score", "_text"])
    assert out.columns == ["doc_id", "score", "_text", "_score"] and out.first().score == "kept"


def test_edges(spark):
    schema = "doc_id long, text string, label int"
    rows = [(i, ("good words here " if i % 2 else "bad stuff !! ") * (i + 1), i % 2) for i in range(40)] + [(100, None, 1), (101, "x", None), (102, "y", 7)]
    df = spark.createDataFrame(rows, schema)
    model = quality.fit(df)
    out = {r.doc_id: r.score for r in quality.score(df, model, ["doc_id"]).collect()}
    assert len(out) == len(rows) and all(0 <= s <= 1 for s in out.values()) and out[1] > 0.5 > out[2]
    clash = df.select("doc_id", "text", F.lit(1).alias("score"), F.lit(2).alias("_text"))
    assert quality.accepted(clash, model).columns == clash.columns
    for part, score in ((df.where("label = 1"), 1), (df.where("label = 0"), 0), (df.limit(0), 0.5)):
        m = quality.fit(part)
        assert {round(r.score, 3) for r in quality.score(df, m, ["doc_id"]).collect()} == {score}
    assert quality.score(df.limit(0), model, ["doc_id"]).count() == 0


def test_the_fit_holds_the_features_once(spark, monkeypatch):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(400)]
    rows = [(i, " ".join(r.choice(words) + (" good" if i % 2 else " bad") for _ in range(300)), i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(4)
    made = quality.row_features(*quality.bytes_of(pa.array([t for _, t, _ in rows])), 13, 4)
    size = 4 * sum(len(x) for x in made)  # bytes of the features' numbers, which Arrow holds
    held, fit_hinge = [], quality.fit_hinge
    monkeypatch.setattr(quality, "fit_hinge", lambda *a: (held.append(tracemalloc.get_traced_memory()[0]), fit_hinge(*a))[1])
    tracemalloc.start()
    quality.fit(df, 13)
    tracemalloc.stop()
    assert len(held) == 3 and max(held) < size / 2, (held, size)
