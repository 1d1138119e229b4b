import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from assayer.llm import lexical as x


def plain(rows, items, k=10):
    """The definition in plain Python."""
    own = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    docs = [(d, Counter(own(t)), len(own(t))) for d, t in rows]
    n_docs, total = sum(n > 0 for _, _, n in docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for d, c, n in docs:
            if not n:
                continue
            m = 100 - 75 + (75 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in own(text) if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, f[3], -f[0]) for i, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(out, key=str)


def made(seed, n=300):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["The", "of", "и", "日本", "naïve", "x1"]
    draw = lambda k: " ".join(words[min(len(words) - 1, int(r.paretovariate(0.7)) - 1)] for _ in range(k))
    rows = [(i, draw(r.choice([1, 5, 40, 400]))) for i in range(n)]
    rows += [(n + i, rows[i % 7][1]) for i in range(60)] + [(None, rows[3][1]), (n + 100, None), (n + 101, ""), (n + 102, " .,!"), (5, rows[5][1])]
    items = [(i, draw(r.choice([1, 3, 12, 60]))) for i in range(40)] + [(40, None), (41, "--"), (42, "unknownword"), (43, rows[3][1]), (43, rows[3][1]), (None, rows[1][1])]
    return rows, items


DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def test_against_the_definition(spark):
    for seed in (1, 2):
        rows, items = made(seed)
        docs, bench = spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(items, ITEMS)
        want = plain(rows, items)
        assert len(want) > 300
        for bounds in ({}, {"block_items": 12}):
            got = [tuple(row) for row in x.search(docs, bench, **bounds).select("item_id", "rank", "doc_id", "score").collect()]
            assert sorted(got, key=str) == want


def test_small_buckets_prune_and_lose_nothing(spark, monkeypatch):
    rows, items = made(3, 800)
    _items = x.read_items(list(dict.fromkeys(items)))
    counted = x.counts(spark.createDataFrame(rows, DOCS), _items)
    w = x.weights(counted, _items)
    batch = counted.toArrow().combine_chunks().to_batches()[0]
    best, scored, open_ = x.Best(_items, np.ones(len(_items.ids), np.int64), 10), [0], list(range(len(_items.ids)))
    full = x.Bucket.scores
    monkeypatch.setattr(x.Bucket, "scores", lambda self, rows, dense: scored.__setitem__(0, scored[0] + len(rows)) or full(self, rows, dense))
    visited = 0
    for bucket in x.buckets(batch, w, 16):
        assert bucket.longest == pytest.approx(np.sqrt(np.bincount(np.repeat(np.arange(len(bucket.doc)), np.diff(bucket.first)), bucket.value.astype(float) ** 2)).max())
        open_ = best.search(bucket, open_)
        visited += len(open_)
    got = [(i, d if d != int(x.NO_ID) else None, s) for i, _, d, s in zip(*(c.to_pylist() for c in best.rows().columns), strict=True)]
    assert sorted(map(str, got)) == sorted(str((i, d, s)) for i, _, d, s in plain(rows, items))
    all_pairs = len(rows) * len(_items.ids)
    assert scored[0] < all_pairs / 5
    assert visited < len(_items.ids) * (len(rows) // 16)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b a", 7, 3)], DOCS + ", score int, item_id int")
    none = spark.createDataFrame([], ITEMS)
    assert x.search(docs, none).count() == 0
    bench = spark.createDataFrame([(1, "A zz", 2)], ITEMS + ", doc_id int")
    assert x.search(docs.limit(0), bench).count() == 0
    assert [tuple(r) for r in x.search(docs, bench).collect()] == plain([(1, "a b a")], [(1, "A zz")])
    long = "word " * 600_000 + "needle"
    rows = [(1, long), (2, "needle in hay"), (3, None)]
    assert sorted(tuple(r) for r in x.search(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(9, "needle word")], ITEMS)).collect()) == plain(rows, [(9, "needle word")])
