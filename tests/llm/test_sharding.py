import hashlib
from collections import Counter

from pyspark.sql import functions as F

from assayer.llm import sharding as s


def brute(names, slots):
    orders = []
    for n in names:
        h = hashlib.sha256(n.encode()).digest()
        o, k = int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:16], "big") % (slots - 1) + 1
        orders.append([(o + j * k) % slots for j in range(slots)])
    table = {}
    while len(table) < slots:
        for i, order in enumerate(orders):
            free = [x for x in order if x not in table]
            if free:
                table[free[0]] = i
    return [table[i] for i in range(slots)]


def test_table():
    names = ["a", "b", "c", "d"]
    assert s.lookup_table(names, 101) == brute(names, 101)
    share = Counter(s.lookup_table(list(s.SHARDS)))
    assert max(share.values()) - min(share.values()) <= 1
    before, after = s.lookup_table(names, 10007), s.lookup_table(names[:3], 10007)
    moved = sum(x != y for x, y in zip(before, after))
    assert moved < 0.4 * 10007


def test_places(spark, tmp_path):
    rows = [(i, "t", "old") for i in range(500)] + [(None, "t", "old"), (3, "t", "old")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    table = brute(["a", "b", "c"], 101)
    out = s.place(df, shards=["a", "b", "c"], slots=101).collect()
    for r in out:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:12], 16) % 101
        assert (r.slot, r.shard) == (slot, "abc"[table[slot]])
    assert len(out) == len(rows) and s.place(df.limit(0)).count() == 0
    s.write(df, str(tmp_path / "x"), shards=["a", "b", "c"], slots=101)
    assert spark.read.parquet(str(tmp_path / "x")).groupBy("shard").count().count() == 3


def test_keys_of_clashing_names(spark):
    df = spark.createDataFrame([("x", "y", 1), (None, "z", 2)], "shard string, slot string, _part int")
    assert sorted(r.slot for r in s.place(df, "shard").collect()) == sorted(x[0] for x in df.select(s.slot_of(F.col("shard"))).collect())
    assert sorted(r.slot for r in s.place(df, "slot").collect()) == sorted(x[0] for x in df.select(s.slot_of(F.col("slot"))).collect())
    assert s.place(df, "shard").columns.count("slot") == 1
