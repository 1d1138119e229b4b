import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from assayer.llm import ranges, warc


def test_round_trip(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>page {i % 7} é</p>" * (i % 5)) for i in range(60)]
    rows += [(100, None, None), (101, "u\r\nv", ""), (None, "n", "<p>alone</p>"), (55, "http://again", rows[55][2]), (55, "http://again", "other"), (102, "crlf", "a\r\n\r\nb" * 999)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, winner string")
    folder = str(tmp_path / "a")
    made = warc.write(pages, folder, roll_bytes=3000, partitions=3).collect()
    assert len(made) > 3 and all(m.bytes <= 3000 or m.records == 1 for m in made)
    out = warc.read(spark, folder).collect()
    top = {}
    for p, _, h in rows:
        top[h or ""] = max([x for x in (top.get(h or ""), p) if x is not None], default=None)
    seen, want = set(), []
    for p, u, h in rows:
        b = (h or "").encode()
        response = top[h or ""] == p and (p, h) not in seen
        seen.add((p, h))
        want.append((str(p), len(b), warc.base32_sha1(b), "response" if response else "revisit", str(None if response else top[h or ""]), b if response else None))
    got = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to), r.payload and bytes(r.payload) if r.record_type == "revisit" else bytes(r.payload)) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    again = str(tmp_path / "b")
    assert sorted(warc.write(pages.repartition(5), again, roll_bytes=3000, partitions=3).collect()) == sorted(made)
    for m in made:
        data = (tmp_path / "a" / m.file).read_bytes()
        assert hashlib.sha256(data).hexdigest() == m.sha256 and gzip.decompress(data).startswith(b"WARC/1.1\r\n")
    assert not [x for x in (tmp_path / "a").iterdir() if x.name.startswith("_tmp")]


def test_the_same_files_however_the_pages_are_partitioned(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    made = []
    for i, rows in enumerate((pages, pages.repartition(7), pages.orderBy(F.desc("page_id")))):
        made.append(sorted(warc.write(rows, str(tmp_path / str(i)), partitions=6).collect()))
    assert made[0] == made[1] == made[2] and sum(m.records for m in made[0]) == pages.count()
    records = [m.records for m in made[0]]
    assert len(made[0]) == 6 and max(records) < 1.5 * min(records)
    with pytest.raises(FileExistsError):
        warc.write(pages.limit(7), str(tmp_path / "0"))
    assert warc.read(spark, str(tmp_path / "0"), payload=False).count() == pages.count()


def test_borders(spark):
    r = random.Random(6)
    for numbers in ([5] * 50, [r.randrange(10**6) for _ in range(500)], [10**15 + r.randrange(99) for _ in range(300)] + [0, 2**62], [-(2**63), 2**63 - 1, *range(100)], [None, 1]):
        df = spark.createDataFrame([(x,) for x in numbers], "x long").repartition(3)
        cuts = ranges.borders(df, "x", 8)
        known = [x for x in numbers if x is not None]
        assert cuts == sorted(set(cuts)) and len(cuts) < 8 and ranges.borders(df.coalesce(1), "x", 8) == cuts
        got = [tuple(x) for x in df.select("x", ranges.range_of(F.col("x"), cuts)).collect()]
        assert all(n == (0 if x is None else sum(c <= x for c in cuts)) for x, n in got)
        share = [sum(1 for _, n in got if n == i) for i in range(len(cuts) + 1)]
        if len(set(known)) > 90:
            assert max(share) <= len(numbers) / 8 * 1.6
    assert ranges.borders(spark.createDataFrame([], "x long"), "x", 8) == []


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write(pages, str(tmp_path / "c")).count() == 0 and warc.read(spark, str(tmp_path / "c")).count() == 0
