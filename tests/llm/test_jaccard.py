import random
import re

import numpy as np
import pytest

from assayer.llm import common, jaccard


def brute(rows, k, percent):
    sets = []
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((doc, {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()))
    comp = list(range(len(rows)))
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = comp[i], comp[j]
                comp = [min(x, y) if c in (x, y) else c for c in comp]
    least = {}
    for (doc, _), c in zip(rows, comp):
        least[c] = doc if least.get(c) is None else min(least[c], doc)
    return sorted((doc, len(s), least[c]) for (doc, s), c in zip(sets, comp))


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 30, 80, 200]))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append((i, r.choice([" ", "  ", "\n"]).join(words) if i % 17 else ["", None, " \t "][i % 3]))
    return rows


@pytest.mark.parametrize("blocks", [(1000, 2_000_000), (5, 2_000_000)])
def test_against_brute_force(spark, blocks):
    rows = corpus(3, 240)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string")
    for k, percent in ((3, 90), (5, 80)):
        out = jaccard.near_duplicates(docs, k, percent, *blocks)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == brute(rows, k, percent)


def test_t_occurrence_counts_each_link_once():
    r = np.random.default_rng(1)
    base = np.sort(r.integers(0, 2**60, 120)).astype(np.uint64)
    sets = []
    for _ in range(60):
        s = base.copy()
        s[r.integers(0, 120, r.integers(0, 9))] = r.integers(0, 2**60)
        sets.append(np.unique(s))
    sets += [np.zeros(0, np.uint64), np.array([5], np.uint64), np.array([5], np.uint64)]
    found = {(min(i, j), max(i, j)) for i, p in jaccard.t_occurrence(sets, 90) for j in p}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i]) and len(sets[j]) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))}
    assert found == want


def test_heap_merge_against_counts():
    r = random.Random(2)
    for _ in range(300):
        lists = [sorted(r.sample(range(40), r.randrange(1, 25))) for _ in range(r.randrange(1, 9))]
        flat, heads = [], []
        for own in lists:
            heads.append((len(flat), len(flat) + len(own)))
            flat += own
        least, below = r.randrange(1, len(lists) + 1), r.randrange(1, 45)
        want = [(x, sum(x in own for own in lists)) for x in range(below)]
        assert list(jaccard.merged_by_heap(flat, heads, least, below)) == [(x, c) for x, c in want if c >= least]


def test_a_cluster_of_many_blocks(spark):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    template = [r.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(template)
        for _ in range(r.choice([0, 1, 1, 2, 5, 6])):  # some link to the template's group only through others, some not at all
            words[r.randrange(120)] = r.choice(vocabulary)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (90, 80):
        out = jaccard.near_duplicates(docs, 3, percent, 7)
        want = brute(rows, 3, percent)
        assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in out.collect()) == want
    assert len({c for *_, c in brute(rows, 3, 90)}) > 3


def test_words_that_a_polynomial_cannot_tell_apart(spark):
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    docs = spark.createDataFrame([(1, f"{one} {two} {one}"), (2, f"{two} {one} {two}"), (3, f"{one} {two} {one.upper()}")], "doc_id long, text string")
    out = {x.doc_id: x.component_id for x in jaccard.near_duplicates(docs, 3, 90).collect()}
    assert out == {1: 1, 2: 2, 3: 1}


def test_word_hashes_of_very_long_texts():
    r = np.random.default_rng(3)
    words = [bytes(r.choice(np.frombuffer(b"abXY\xc3\xa9", np.uint8), r.choice([1, 5, 300, 900]))) for _ in range(40)]
    text = b" \n".join([words[i] for i in r.integers(0, 40, 30_000)])  # several chunks
    assert len(text) > 2 * common.CHUNK_BYTES
    data = np.frombuffer(text, np.uint8)
    hashes, starts, bounds = common.word_hashes(data, np.array([0, len(data)]))
    seen = {}
    for h, w in zip(hashes.tolist(), text.lower().split()):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen) and bounds.tolist() == [0, len(starts)]
    apart, *_ = common.word_hashes(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])]))
    assert [seen[w.lower()] for w in words if w.lower() in seen] == [h for h, w in zip(apart.tolist(), words) if w.lower() in seen]


def test_edges(spark):
    schema = "doc_id long, text string"
    assert jaccard.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b"), (1, "a b"), (2, "A  b"), (None, "a b"), (3, None), (None, "x y z q r s"), (4, "y " * 3000)]
    out = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, schema)).collect()}
    assert out == {(1, 1, 1), (2, 1, 1), (None, 1, 1), (3, 0, 3), (None, 2, None), (4, 1, 4)}


def test_one_of_each_keeps_all_columns(spark):
    rows = [(1, "a b c d e f", "k1"), (2, "A b c d e f", "k2"), (2, "A b c d e f", "k2"), (3, None, "k3"), (None, "a b c d e f", "k4"), (None, "other words in here now", "k5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _keep_id string")
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns and sorted(r._keep_id for r in out.collect()) == ["k1", "k3", "k5"]


def test_pages_of_one_template_meet_nowhere(spark, monkeypatch):
    """They agree in bands and don't link: what is searched grows with them, not with their square."""
    searched, rows_of = jaccard._searched, []
    monkeypatch.setattr(jaccard, "_searched", lambda sets, percent: rows_of.append(sets.count()) or searched(sets, percent))
    counts = []
    for n in (400, 800):
        rows_of.clear()
        rows = [(i, " ".join([f"t{j}" for j in range(100)] + [f"p{i}x{j}" for j in range(22)])) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r.component_id for r in jaccard.near_duplicates(docs, 3, 90, 50).collect()} == set(range(n))
        counts.append(sum(rows_of))
    assert counts[0] < 4 * 400 and counts[1] < 2.2 * counts[0]


def test_links_between_sets_that_are_not_settled(spark):
    """Pairs of pages of one template, far from its largest group, each pair alike: every pair is found, in whatever block its ends are."""
    rows = [(i, " ".join([f"t{j}" for j in range(100)] + [f"e{i}"])) for i in range(60)]
    for i in range(60, 160, 2):
        own = [f"t{j}" for j in range(100)] + [f"p{i}x{j}" for j in range(25)]
        rows += [(i, " ".join(own)), (i + 1, " ".join([*own, "more"]))]
    out = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 9)
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in out.collect()) == brute(rows, 3, 90)


def test_prefixes_of_linked_sets_meet():
    r = np.random.default_rng(4)
    for percent in (80, 90):
        for _ in range(300):
            pool = r.integers(0, 2**63, 400).astype(np.uint64)
            common, often = np.unique(r.choice(pool, 60)), None
            often = r.integers(2, 9, len(common))
            a = np.unique(pool[: r.integers(1, 200)])
            b = np.unique(np.concatenate([r.choice(a, max(1, int(len(a) * r.uniform(0.8, 1))), False), pool[300 : 300 + r.integers(0, 12)]]))
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= percent * (len(a) + len(b) - shared):
                assert len(np.intersect1d(jaccard.prefix(a, common, often, percent), jaccard.prefix(b, common, often, percent)))
