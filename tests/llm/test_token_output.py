import base64
import random
import zlib

import numpy as np
import pytest

from assayer.llm import token_output as t


def test_tree_against_scan():
    r = random.Random(1)
    tree, have = t.CapacityTree(50), []
    for _ in range(3000):
        if have and r.random() < 0.5:
            x = have.pop(r.randrange(len(have)))
            tree.add(x, -1)
        else:
            x = r.randrange(51)
            have.append(x)
            tree.add(x, 1)
        want = r.randrange(1, 51)
        assert tree.tightest(want) == min((x for x in have if x >= want), default=-1)


def test_round_trip(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["one", "zwei", "trois!", "日本"]) for _ in range(r.randrange(0, 300)))) for i in range(120)]
    rows += [(None, "null"), (500, None), (501, "long " * 2000), (1, "again")]
    docs = spark.createDataFrame([(d, x, "s") for d, x in rows], "doc_id long, text string, stem string").repartition(3)
    folder = str(tmp_path / "t")
    made = t.write(docs, folder, size=256, block_tokens=5000).collect()
    encode, want = t.byte_encoding(t.default_path()).encode_ordinary, []
    for d, x in rows:
        ids = [*encode(x or ""), t.END_ID]
        for i, a in enumerate(range(0, len(ids), 256)):
            part = np.array(ids[a : a + 256], "<u4")
            want.append((str(d), i, a, len(part), zlib.crc32(part.tobytes())))
    out = t.read_segments(spark, folder).collect()
    assert sorted((str(x.doc_id), x.piece, x.start, x.length, x.ids_crc32) for x in out) == sorted(want)
    by = {}
    for x in out:
        by.setdefault(x.sequence, []).append((x.offset, x.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) < 1.1 * sum(w[3] for w in want) / 256 + len(made)
    with pytest.raises(FileExistsError):
        t.write(docs.limit(3), folder)
    assert t.write(docs.limit(0), str(tmp_path / "e")).count() == 0 and t.read_segments(spark, str(tmp_path / "e")).count() == 0
    ids, pos, cu, first, seg = t.read_block(folder, made[0].stem, 256, "<u2")
    for row in range(len(ids)):
        own = cu[first[row] : first[row + 1]]
        assert own[0] == 0 and all(pos[row, a] == 0 for a in own[:-1]) and not pos[row, own[-1] :].any()


def test_rows_are_those_of_plain_best_fit_decreasing():
    r = random.Random(5)
    for size in (10, 256):
        lengths = [r.choice([r.randrange(1, size + 1), r.randrange(1, size // 4 + 1), size]) for _ in range(700)]
        rows: list[list[int]] = []
        free: list[int] = []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fits = [(f, -j) for j, f in enumerate(free) if f >= lengths[i]]
            if fits:
                j = -min(fits)[1]
            else:
                j = len(rows)
                rows.append([])
                free.append(size)
            rows[j].append(i)
            free[j] -= lengths[i]
        made = t.best_fit_decreasing(lengths, size)
        assert sorted(size - sum(lengths[i] for i in row) for row in made) == sorted(free) and sorted(x for row in made for x in row) == list(range(len(lengths)))


def test_ids_over_16_bits_are_written(spark, tmp_path):
    path = tmp_path / "large.tiktoken"
    words = [bytes([b]) for b in range(256)] + [bytes([a, b]) for a in range(256) for b in range(256)]
    path.write_text("".join(f"{base64.b64encode(w).decode()} {i}\n" for i, w in enumerate(words)))
    docs = spark.createDataFrame([(1, "\u00ff\u00fe zz ~~")], "doc_id long, text string")
    made = t.write(docs, str(tmp_path / "out"), tokenizer=str(path), end_id=7).collect()
    assert made[0].kind == "<u4"
    ids, *_ = t.read_block(str(tmp_path / "out"), made[0].stem, made[0].size, made[0].kind)
    assert t.byte_encoding(str(path)).decode(ids[0, : made[0].tokens - 1].tolist()) == "\u00ff\u00fe zz ~~"
