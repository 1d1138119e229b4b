import hashlib
import os
import random
import time
from pathlib import Path

import numpy as np
import pytest

from assayer.llm import repeats
from assayer.llm import suffixes as s
from assayer.llm import transforms as t


def brute(rows, length):
    first = {}
    for doc, text in rows:
        b = (text or "").encode()
        d = float("inf") if doc is None else doc
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, d), d)
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        d = float("inf") if doc is None else doc
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = True
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((str(doc), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
    return sorted(out)


def corpus(seed, n=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ab", "é", "on", "t ", "x", "ing ", "\x00", "ü"]) for _ in range(r.randrange(1, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(r.choice([8, 15, 40])) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [text(r.randrange(0, 40))]
        for _ in range(r.choice([0, 1, 1, 2])):
            p = r.choice(passages)
            a = r.randrange(len(p) // 2)
            parts += [p[a:] if r.random() < 0.5 else p, text(r.randrange(0, 30))]
        rows.append((i * 3, "".join(parts)))
    rows += [(7, rows[4][1]), (8, rows[4][1]), (7, "a" * 400), (9, "a" * 300), (10, "ab" * 200), (None, rows[6][1]), (11, None), (12, ""), (13, "short"), (6, rows[2][1]), (6, rows[2][1])]
    return rows


@pytest.mark.parametrize("seed,group", [(1, 1 << 20), (2, 2000)])
def test_against_brute_force(spark, seed, group):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "x", 5) for d, t in rows], "doc_id long, text string, mark string, n_chars int")
    want = brute(rows, 50)
    got = sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in s.summary(docs, group_bytes=group).collect())
    assert got == [w[:5] for w in want] and sum(w[2] for w in want) > 3000
    cut = s.dedup(docs, group_bytes=group)
    assert cut.columns == docs.columns
    assert sorted((str(x.doc_id), x.text or "", x.mark) for x in cut.collect()) == sorted((w[0], w[5], "x") for w in want)


def test_merged_intervals_are_the_repeated_strings():
    r = random.Random(3)
    strings = list({"".join(r.choice("ab\x00") for _ in range(r.randrange(5, 40))).encode() for _ in range(80)})
    for depth in (2, 6, 8):
        for shards in (1, 2, 5, 80):
            cuts = [i * len(strings) // shards for i in range(shards + 1)]
            parts = [np.concatenate([np.append(t.encoded(np.frombuffer(x, np.uint8)), np.uint8(0)) for x in strings[a:b]]) for a, b in zip(cuts, cuts[1:]) if a < b]
            text = np.concatenate(parts)
            places, begins = t.merged_intervals(text, np.array([len(x) for x in parts]), depth)
            want, raw = {}, text.tobytes()
            for i in range(len(raw) - depth + 1):
                if 0 not in raw[i : i + depth]:
                    want.setdefault(raw[i : i + depth], []).append(i)
            got = {}
            for p, i in zip(places.tolist(), np.cumsum(begins).tolist()):
                got.setdefault(i, []).append(p)
            assert sorted(sorted(x) for x in got.values()) == sorted(x for x in want.values() if len(x) > 1)


def test_transforms_lead_back_to_the_text():
    r = np.random.default_rng(4)
    text = r.choice(np.frombuffer(b"abc", np.uint8), 400_000)
    text[r.integers(0, len(text), 6000)] = 0
    text[-1] = 0
    ends = np.flatnonzero(text == 0)
    shards = np.diff(ends[[99, 2000, -1]], prepend=-1)
    symbol, back, where = t.transforms(text, shards, 50)
    assert np.array_equal(np.sort(where), np.arange(len(text)))
    live = np.flatnonzero(symbol)
    assert np.array_equal(where[back[live]], where[live] - 1) and np.array_equal(text[where[live] - 1], symbol[live])


def test_passage_twice_in_a_later_document(spark):
    r = random.Random(8)
    text = lambda k: "".join(r.choice("abcdefghij klmnop") for _ in range(k))
    p = text(50)
    rows = [(1, text(90) + p + text(70)), (2, text(300) + p + text(200) + p + text(90)), (3, p)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(3, "doc_id")
    got = sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in s.summary(docs).collect())
    assert got == [w[:5] for w in brute(rows, 50)] and [x[2] for x in got] == [0, 100, 50]


def test_a_passage_in_very_many_contexts(spark):
    r = random.Random(11)
    text = lambda k: "".join(r.choice("abcdefghij klmnop") for _ in range(k))
    passage = text(60)
    rows = [(i, text(40) + passage + text(40)) for i in range(300)] + [(1000 + i, "z" * (60 + i % 7)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for group in (1 << 20, 3_000):  # 3,000 bytes are some 30 strings: several rounds are needed
        got = sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in s.summary(docs, group_bytes=group).collect())
        assert got == [w[:5] for w in brute(rows, 50)]


def test_no_task_holds_more_than_a_group():
    r = random.Random(12)
    text = lambda k: bytes(r.choice(b"abcdefghij klmnop") for _ in range(k))
    passage, keys = text(60), np.arange(1, dtype=np.int32)
    most, add = [], s.Group.add

    def watched(self, *row):
        add(self, *row)
        most.append(self.bytes)

    held = s.Strings(50, 0)
    rows = []
    for i in range(400):
        own = np.frombuffer(text(40) + passage + text(40), np.uint8)
        held.add(own, np.arange(len(own) - 49), np.zeros(1, np.int64), np.array([i]), np.array([7]), np.zeros(1, np.int64))
        if i % 10 == 9:
            rows += [b for b in s._handed_over(held, keys)]
    s.Group.add = watched
    try:
        out = list(s._merge(iter(sorted((b for x in rows for b in (x.slice(i, 1) for i in range(x.num_rows))), key=lambda b: (b.column("part")[0].as_py() is not None, b.column("part")[0].as_py()))), 50, 5_000, 0, keys))
    finally:
        s.Group.add = add
    assert max(most) < 5_000 + 10 * 120 and any(x.column("part").null_count < x.num_rows for x in out)


def test_empty(spark):
    assert s.summary(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_step_begins_with_the_shuffles_of_another_on_disk(spark, monkeypatch):
    def on_disk():
        return set(Path(os.environ.get("SPARK_LOCAL_DIRS", spark.conf.get("spark.local.dir"))).rglob("shuffle_*.data"))

    def left_by_others():
        until = time.time() + 10  # executors delete at once, but by themselves
        while (found := on_disk() - before) and time.time() < until:
            time.sleep(0.1)
        return len(found)

    left, staged = {}, s.staged

    def watched(df, name):
        left[name] = left_by_others()
        return staged(df, name)

    for module in (s, repeats):
        monkeypatch.setattr(module, "staged", watched)
    monkeypatch.setattr(s, "released", lambda spark: None)  # the driver need not collect garbage for it
    rows = corpus(5, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = on_disk()
    out = s.summary(docs)
    left["result"] = left_by_others()
    assert list(left) == ["anchors", "ids", "copies", "merged-0", "result"] and not any(left.values()), left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
    assert sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in out.collect()) == [w[:5] for w in brute(rows, 50)]
