import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from assayer.llm import byte_bpe as b

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return b.ByteEncoder(b.read_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=b.read_ranks(PATH), special_tokens={})


def ids(own, text):
    return np.frombuffer(own.encode(text), "<i4").tolist()


def test_every_character_equals_the_library(own, library):
    """Alone and within words, in blocks of characters: where the two differ the block's ids do."""
    planes = [*range(0x40000), *range(0xE0000, 0xE1000)]  # the others hold no letters
    points = [c for c in planes if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 512):
        text = "".join(f"a{chr(c)}a 1{chr(c)} " for c in points[at : at + 512])
        assert ids(own, text) == library.encode_ordinary(text), hex(points[at])


def test_random_texts_equal_the_library(own, library):
    r = random.Random(1)
    alphabets = ["ab", " \n\t", "aeinst ", "0123 a", "的是不我有一", "éàèçüñ'", "мирда ", "'sdlmtrev ", "<|endoftext|>", "😀👍🏽‍", "".join(map(chr, range(32, 127))), "　\xa0\x85\x1c "]
    tokens = list(own.tokens.values())
    for i in range(12_000):
        a = r.choice(alphabets) + r.choice(alphabets)
        text = "".join(r.choice(a) for _ in range(r.choice([1, 5, 30, 300])))
        if i % 3 == 0:
            text = b"".join(r.choice(tokens) for _ in range(r.randrange(1, 30))).decode("utf-8", "replace")
        found = ids(own, text)
        assert found == library.encode_ordinary(text), text
        assert own.decode(np.array(found)) == text.encode()


def test_bytes_equal_merging(own):
    """Against the definition, on matches that no pattern would give: any bytes, cut tokens, few letters."""
    r = random.Random(2)
    tokens = list(own.tokens.values())
    for i in range(4_000):
        piece = bytes(r.choice(b"aab \xc3\xa9") for _ in range(r.randrange(1, 60))) if i % 2 else b"".join(r.choice(tokens)[r.randrange(2) :] for _ in range(8)) or b"x"
        assert own.piece(piece) == ([own.ranks[piece]] if piece in own.ranks else b.merge(piece, own.ranks))


def test_long_matches_take_linear_work(own, library):
    text = "ab" * 300_000 + "的" * 100_000
    calls = []
    longest, own.longest = own.longest, lambda *a: calls.append(1) or longest(*a)
    try:
        found = own.piece(text.encode())
    finally:
        own.longest = longest
    assert len(calls) <= len(text.encode())
    assert own.decode(np.array(found)) == text.encode()
    assert found[:1000] == own.piece(text[:100_000].encode())[:1000]
    mixed = "word wörter 词语 " * 150_000  # over 2 MiB: many matches
    assert ids(own, mixed) == library.encode_ordinary(mixed)


def test_few_ranks(spark, tmp_path):
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"abcabc": 259, b"aa": 260, b"aaa": 261}
    path = tmp_path / "few.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % n for t, n in ranks.items()))
    few = b.ByteEncoder(b.read_ranks(str(path)), r"\S+|\s+")
    r = random.Random(3)
    for _ in range(3_000):
        piece = bytes(r.choice(b"abc") for _ in range(r.randrange(1, 25)))
        assert few.piece(piece) == ([ranks[piece]] if piece in ranks else b.merge(piece, ranks))
    docs = spark.createDataFrame([(1, "abcabcab aaaa")], "doc_id long, text string")
    (x,) = b.decode(b.encode(docs, str(path), r"\S+|\s+"), str(path), r"\S+|\s+").collect()
    assert x.ids == [*b.merge(b"abcabcab", ranks), 32, *b.merge(b"aaaa", ranks)] and bytes(x.decoded) == b"abcabcab aaaa"


def test_operator_and_query(spark, library, tmp_path):
    rows = [(1, "Hello wörld 你好 😀", 3, "x"), (1, "Hello wörld 你好 😀", 3, "x"), (None, None, None, "y"), (2, "", 1, None), (3, "<|endoftext|> " * 3, 2, "z"), (4, "long " * 500_000, 4, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string")
    got = b.decode(b.encode(docs)).collect()
    assert sorted((str(x.doc_id), x.text or "", x.ids, bytes(x.decoded)) for x in got) == sorted((str(d), t or "", library.encode_ordinary(t or ""), (t or "").encode()) for d, t, _, _ in rows)
    assert b.encode(docs.limit(0)).count() == 0
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for doc, text, _, _ in rows:
        found = library.encode_ordinary(text or "")
        want.append((doc, len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, (tuple(x) for x in b.op11_byte_bpe(spark, str(tmp_path)).collect()))) == sorted(map(str, want))
