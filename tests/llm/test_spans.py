import random
import re

from assayer.llm import spans
from assayer.llm.common import bytes_of

import pyarrow as pa


def cut(text):
    data, at = bytes_of(pa.array([text]))
    starts, _ = spans.sentences(data, at)
    raw = text.encode()
    return [raw[a:b].decode() for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(raw)])]


def brute(rows, k, least):
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    result = {}
    for i in order:
        doc, text = rows[i]
        s = cut(text or "") if text else []
        w = [[x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", p)] for p in s]
        gone = set()
        for a in range(max(1, len(s) - k + 1) if s else 0):
            key = tuple(map(tuple, w[a : a + k]))
            if sum(map(len, key)) < least:
                continue
            if seen.setdefault(key, (doc, a)) != (doc, a):
                gone |= set(range(a, min(a + k, len(s))))
        result[i] = (doc, "".join(p for j, p in enumerate(s) if j not in gone), len(s), len(gone))
    return [result[i] for i in range(len(rows))]


def test_sentences():
    assert cut("One two. Three 3.14 x!  Four\nFive... Six?!") == ["One two. ", "Three 3.14 x!  ", "Four\n", "Five... ", "Six?!"]
    assert cut("  \n a b.") == ["  \n a b."] and cut("...") == ["..."]


def test_against_brute_force(spark):
    r = random.Random(2)
    pool = [" ".join(r.choice("aa bb cc dd ee ff gg".split()) + str(r.randrange(40)) for _ in range(r.choice([1, 4, 6]))) for _ in range(80)]
    rows = []
    for i in range(200):
        s = [r.choice(pool) if r.random() < 0.2 else f"u{i}x{j} some own words here" for j in range(r.choice([0, 1, 2, 8]))]
        if r.random() < 0.6:
            a = r.randrange(70)
            s[1:1] = pool[a : a + r.choice([3, 4, 6])]
        rows.append((i, "".join(x + r.choice([". ", "! ", "\n"]) for x in s)))
    rows += [(None, rows[5][1]), (200, None), (201, ""), (202, "One. " * 30)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, mark int")
    got = sorted((str(x.doc_id), x.text, x.n_sentences, x.n_removed) for x in spans.drop_repeated_spans(docs, least=10).collect())
    want = sorted((str(d), t, n, g) for d, t, n, g in brute(rows, 3, 10))
    assert got == want and sum(x[3] for x in want) > 20
    assert spans.drop_repeated_spans(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, rows[9][1] + "more of it. " * 3)] * 2, "doc_id long, text string")
    a, b = spans.drop_repeated_spans(twice).collect()
    assert a == b


def test_query_hashes_short_runs(spark, tmp_path):
    rows = [(1, "Yes. No. Maybe. Some words of its own. And more."), (2, "All else. YES. no.\nMaybe. Differs here."), (3, "Short copy."), (4, "short copy."), (5, " \n"), (6, " \n"), (7, "Go. " * 5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: (x.text, x.n_sentences, x.n_removed) for x in spans.op3_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == {d: (t, n, g) for d, t, n, g in brute(rows, 3, 1)}
    assert got[2] == ("All else. Differs here.", 5, 3) and got[4] == ("", 1, 1) and got[5][0] == got[6][0] == " \n" and got[7][2] == 4


def test_a_text_of_several_chunks(spark):
    shared = "This passage is shared by both. It has three sentences of words. Here is the third of them. "
    long = "".join(f"Sentence number {i} has some words of its own. " for i in range(70_000))
    assert len(long) > 3 << 20
    docs = spark.createDataFrame([(1, shared), (2, long + shared + long[:200])], "doc_id long, text string")
    got = {x.doc_id: x for x in spans.drop_repeated_spans(docs).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed >= 3
    assert shared not in got[2].text and got[2].text.startswith(long)


def test_every_run_counts_by_default(spark):
    docs = spark.createDataFrame([(1, "Aa. Bb. Cc."), (2, "Aa. Bb. Cc."), (3, "今日。明日。")], "doc_id long, text string")
    assert {x.doc_id: (x.n_sentences, x.n_removed) for x in spans.drop_repeated_spans(docs).collect()} == {1: (3, 0), 2: (3, 3), 3: (1, 0)}


def test_passages_are_found_wherever_they_begin(spark, tmp_path):
    r = random.Random(5)
    own = lambda doc, n: " ".join(f"{doc}é{r.randrange(10**9)}" for _ in range(n))
    upper = lambda text: re.sub("[a-z]+", lambda m: m[0].upper(), text)
    rows, planted = [(0, "Start here."), (1, "la " * 300)], {}
    for i in range(2, 60, 2):
        words = own(f"p{i}", r.choice([50, 51, 64, 90])).split()
        if i % 4:
            words[r.randrange(len(words) - 1)] += "."
        rows += [(i, f"{own(i, 30)} {' '.join(words)} {own(i, 9)}. {own(i, 5)}"), (i + 1, f"{own(i + 1, 4)}. {own(i + 1, 8)} {upper(' '.join(words))}\n{own(i + 1, 40)}")]
        planted[i + 1] = upper(" ".join(words)).split()
    rows += [(70, own(70, 60) + " " + own(71, 28)), (71, rows[4][1][:150])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in spans.op3_substring_dedup(spark, str(tmp_path)).collect()}
    text = dict(rows)
    for doc, x in got.items():
        kept, whole = x.text.split(), text[doc].split()
        if doc not in planted:
            assert x.n_removed == 0 and x.text == text[doc]
            continue
        passage = planted[doc]
        assert x.n_removed >= 1 and [w for w in whole if w not in passage] == [w for w in kept if w not in passage]
        left = [w for w in kept if w in passage]
        assert len(left) <= 2 * (spans.GAP - 1) and len(passage) - len(left) >= spans.WORDS - spans.GAP + 1
