import random

from assayer.llm import decontamination as d


def test_against_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([2, 6, 12, 25, 60, 200])))) for i in range(60)]
    items += [(60, None), (61, " "), (62, items[3][1])]
    rows = []
    for i in range(150):
        words = [r.choice(vocabulary) for _ in range(r.choice([1, 30, 900]))]
        for _ in range(r.choice([0, 1, 2])):
            own = items[r.randrange(60)][1].split()
            for _ in range(r.choice([0, 0, 1, 2])):
                own[r.randrange(len(own))] = "zz"
            at = r.randrange(len(words) + 1)
            words[at:at] = [w.upper() for w in own]
        rows.append((i, " ".join(words)))
    rows += [(150, None), (None, items[5][1]), (151, items[0][1])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = []
    for doc, text in rows:
        own = d.shingles(text)
        for item, t in items:
            s = d.shingles(t)
            if s and 100 * len(s & own) >= 80 * len(s):
                want.append((str(doc), item, len(s), len(s & own)))
    for bounds in ({}, {"block_items": 20}):
        got = [(str(x.doc_id), x.item_id, x.n_item_shingles, x.n_shared) for x in d.search(docs, bench, **bounds).collect()]
        assert sorted(got) == sorted(want) and len(want) > 50
        kept = d.decontaminate(docs, bench, **bounds)
        assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(str(x) for x, _ in rows if str(x) not in {w[0] for w in want})


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 3)], "doc_id long, text string, item_id int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.search(docs, none).count() == 0
    assert d.decontaminate(docs, none).count() == 1
    assert d.search(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
    assert [d.size_class(n) for n in (1, 8, 9, 13, 17, 25, 33, 49)] == [8, 8, 12, 16, 24, 32, 48, 64]


def test_small_items_in_long_documents(spark):
    r = random.Random(8)
    items = [(i, " ".join(f"q{i}x{j}" for j in range(5 + i % 8))) for i in range(24)]
    items += [(24, items[0][1]), (25, "q0x0 q0x1 q0x2 q0x3 q0x4 other"), (26, "la " * 40)]
    rows = []
    for i in range(120):
        words = [f"w{r.randrange(5000)}" for _ in range(1500)]
        for item in r.sample(range(26), 4) + [26] * (i % 9 == 0):
            at = r.randrange(len(words) + 1)
            words[at:at] = items[item][1].split()[: 11 if i % 2 else None]
        rows.append((i, " ".join(words)))
    sets = [d.shingles(t) for _, t in items]
    want = [(i, n, len(s), len(s & own)) for i, t in rows for own in [d.shingles(t)] for n, s in enumerate(sets) if 100 * len(s & own) >= 80 * len(s)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [(x.doc_id, x.item_id, x.n_item_shingles, x.n_shared) for x in d.search(docs, bench).collect()]
    assert sorted(got) == want and len(want) > 400
    assert d.decontaminate(docs, bench.where("item_id < 8")).count() == len(rows) - len({x[0] for x in want if x[1] < 8})


def test_items_that_repeat_their_own_shingles():
    """By the thousand: phrases of 1 to 300 different words 1 to 30 times over, whole or at the threshold, in one place or scattered."""
    r = random.Random(6)
    items, texts = [], []
    for n in range(2_400):
        phrase = [f"p{n}x{j}" for j in range(r.choice([1, 2, 4, 5, 8, 9, 12, 16, 30, 60, 120, 300]))]
        words = phrase * (r.choice([1, 2, 10, 20, 30]) if len(phrase) <= 60 else r.choice([1, 2]))
        if n % 3 == 0:  # a part repeats, the rest doesn't
            words = words + [f"q{n}x{j}" for j in range(r.randrange(60))]
        items.append((str(n), " ".join(words)))
    index = d.build(items)
    want, got = set(), set()
    for n in range(0, len(items), 40):
        filler = [f"w{r.randrange(9_000)}" for _ in range(1_500)]
        for m in range(n, n + 40):
            own = items[m][1].split()
            at = r.randrange(len(filler))
            if m % 4 == 1:  # scattered in runs
                runs = [own[i : i + 24] for i in range(0, len(own), 20)]
                for run in runs:
                    at = r.randrange(len(filler))
                    filler[at:at] = run
            else:
                if m % 4 == 2 and len(own) > 20:
                    own[r.randrange(len(own))] = "zz"
                filler[at:at] = own
        texts.append(" ".join(filler))
        have = d.shingles(texts[-1])
        want |= {(len(texts) - 1, m) for m, s in enumerate(index.sets) if m // 40 == n // 40 and 100 * len(s & have) >= 80 * len(s)}
    data, at = d.bytes_of(d.pa.array(texts))
    got = {(row, item) for row, item, _, _ in d.matches(index, d.pa.RecordBatch.from_pydict({"text": texts}), "text", data, at, 80)}
    assert want <= got and len(want) > 1_500
    assert all(row == item // 40 for row, item in got)


def test_sketches_leave_nothing_out():
    for percent in (50, 80, 95, 100):
        for n in range(1, 400):
            size, need = d.sketch_size(n, percent)
            lacks = n - -(-percent * n // 100)
            assert 1 <= need <= max(1, size - lacks) and lacks < size <= n


def test_long_document(spark):
    r = random.Random(7)
    text = " ".join(f"w{r.randrange(10**7)}" for _ in range(300_000))
    item = " ".join(f"i{j}" for j in range(30))
    docs = spark.createDataFrame([(1, text + " " + item), (2, text), (3, item + " " + text), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item), (5, item), (None, "i0 i1 i2 i3 i4 i5")], "item_id long, text string")
    assert len(text) > 2 << 20
    got = sorted((x.doc_id, str(x.item_id)) for x in d.search(docs, bench).collect())
    assert got == [(1, "5"), (1, "5"), (1, "None"), (3, "5"), (3, "5"), (3, "None")]
    assert sorted(str(x.doc_id) for x in d.decontaminate(docs, bench).collect()) == ["2", "None"]
