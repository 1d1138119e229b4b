import hashlib
import random
import re
from collections import Counter

import pytest

from assayer.llm import fingerprints as f


def paragraphs(text):
    out = []
    for line in text.split("\n"):
        out += re.split(r"(?<=[.]) +", line) if len(line) > f.LONG else [line]
    return set(Counter(x for x in out if x).items())


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus(seed, n=60):
    r = random.Random(seed)
    line = lambda: " ".join(r.choice(["öne", "two.", "thrée", "four", "a😀b"]) + str(r.randrange(9)) for _ in range(r.choice([1, 3, 10, 120])))
    rows = [(i * 7, "\n".join(line() for _ in range(r.choice([0, 1, 4, 12, 150])))) for i in range(n)]
    rows += [(r.randrange(400) * 7 + 1, "same\nsame\nother") for _ in range(3)] + [(3, None), (4, ""), (5, "x"), (None, rows[8][1]), (5, "y\nz")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, row int").repartition(3)
    order = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    want = []
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        want.append((str(d), len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(paragraphs(t), paragraphs(edited)), 9), round(like(paragraphs(t), paragraphs(nxt)), 9)))
    got = f.fingerprints(docs).collect()
    assert sorted((str(x.doc_id), x.n_chars, x.edited_sha256, round(x.near_edited, 9), round(x.near_next, 9)) for x in got) == sorted(want)
    by_text = {}
    for x in got:
        by_text.setdefault((x.n_chars, x.fingerprint), set()).add(x.doc_id)
    texts = {d: t or "" for d, t in rows}
    assert all(len({texts[d] for d in own}) == 1 for own in by_text.values() if 5 not in own)
    assert len({x.fingerprint for x in got if texts[x.doc_id] == "same\nsame\nother"}) == 1


def test_one_and_none(spark):
    one = f.fingerprints(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a\na").hexdigest()
    assert f.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cut_whatever_the_length(spark):
    short = "One thing. Another thing. A third thing. The fourth."
    same = "".join(f"Sentence number {i} stands here. " for i in range(12))
    rows = [(1, short), (2, f"Zz. {short}"), (3, same + "Only the first has this. " * 10), (4, same + "And this is the second's. ")]
    got = {x.doc_id: x for x in f.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert round(got[1].near_next, 9) == 0.8  # four of five, both lines short
    assert len(rows[2][1]) > 500 > len(rows[3][1]) and round(got[3].near_next, 9) == round(12 / 14, 9)
    assert all(x.near_edited > 0 for x in got.values())


def test_long_texts(spark):
    """Over 2 MiB, and many keys."""
    rows = [(1, "\n".join(f"own {i}" for i in range(1_500))), (2, "\n".join(f"own {i}" for i in range(3, 1_600))), (3, "word " * 500_000 + "end.")]
    out = {x.doc_id: x for x in f.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (doc, text) in enumerate(rows):
        assert out[doc].near_next == pytest.approx(like(paragraphs(text), paragraphs(rows[(i + 1) % 3][1])))
