import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from assayer.llm import packing, tokens


def texts():
    r = random.Random(4)
    words = ["don't", "Straße", "l'été", "a1b2", "3.14", "İ", "Σας", "naïve", "<|endoftext|>", "x" * 300, "日本", "é", "\x1c", " ", "ﬁ", "!!", "--", "Ǆ", "it's", "we'll", "²", "ª"]
    out = [" ".join(r.choice(words) for _ in range(r.randrange(0, 40))) for _ in range(60)]
    plain = [w for w in words if "\x1c" != w and w not in ("İ", "Σας", "<|endoftext|>", "日本", "é", "ﬁ")]
    return out + [r.choice(" \n\t").join(r.choice(plain) for _ in range(r.randrange(1, 60))) for _ in range(200)] + ["", "word " * 5000]


def test_ids_equal_the_tokenizer():
    whole, own = Tokenizer.from_file(tokens.default_path()), tokens.WordEncoder(tokens.default_path(), 50)
    for t in texts():
        assert np.frombuffer(own.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_ids_of_every_latin_character_and_of_random_strings():
    whole, own = Tokenizer.from_file(tokens.default_path()), tokens.WordEncoder(tokens.default_path())
    latin = [chr(c) for c in range(0x250)]
    r = random.Random(9)
    found = [x for c in latin for x in (c, f"a{c}b", f"{c}word", f"word{c}", f"{c}{c}", f"a {c} b")]
    found += ["".join(r.choice(latin) for _ in range(r.randrange(1, 12))) for _ in range(50_000)]
    found += ["".join(r.choice(latin if r.random() < 0.2 else "abc 'sT.9") for _ in range(r.randrange(1, 30))) for _ in range(50_000)]
    want = whole.encode_batch(found, add_special_tokens=False)
    assert not [t for t, w in zip(found, want) if np.frombuffer(own.encode(t), "<u4").tolist() != w.ids]


def check(rows, wanted, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    got = sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert got == sorted(wanted)
    return by


def test_pieces_and_sequences(spark):
    rows = list(enumerate(texts())) + [(None, "null id"), (900, None), (901, "same row"), (901, "same row")]
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, copy string")
    whole, want = Tokenizer.from_file(tokens.default_path()), []
    for d, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        for i, a in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[a : a + 2048], "<u4")
            want.append((str(d), i, a, len(part), zlib.crc32(part.tobytes())))
    out = packing.best_fit(docs).collect()
    by = check(out, want, 2048)
    total = sum(w[3] for w in want)
    assert len(by) <= total / 2048 + 2
    many = packing.best_fit(docs, open_bins=3, pieces_per_task=50).collect()
    check(many, want, 2048)
    assert packing.best_fit(docs.limit(0)).count() == 0


def test_fullest_closes_first():
    bins = packing.BestFit(10, 2)
    assert [bins.place(x) for x in (6, 7, 3, 8, 3)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6)]
    bins = packing.BestFit(10, 2)
    assert [bins.place(x) for x in (6, 7, 9, 1, 4)] == [(0, 0), (1, 0), (2, 0), (1, 7), (0, 6)]
